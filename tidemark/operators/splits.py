"""Temporal split, samples and checks (survey B1-B16, D8, D12, D13, A13-A14)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_SECONDS, POSITIVE, day_of, unit


def order_statistic(df: DataFrame, column: str, share: float) -> int | None:
    """The value at index floor(share * (n - 1)) in order. Days are counted first, so only one day's rows are ranked."""
    days = df.where(F.col(column).isNotNull()).groupBy(day_of(F.col(column)).alias("d")).count().orderBy("d").collect()
    n = sum(r["count"] for r in days)
    if not n:
        return None
    at = math.floor(share * (n - 1))
    for r in days:
        if at < r["count"]:
            break
        at -= r["count"]
    lo = r["d"] * DAY_SECONDS
    inside = df.where((F.col(column) >= lo) & (F.col(column) < lo + DAY_SECONDS)).groupBy(column).count()
    run = inside.withColumn("run", F.sum("count").over(Window.orderBy(column)))
    return run.where(F.col("run") > at).agg(F.min(column)).first()[0]


def temporal_split(ratings: DataFrame, validation: float = 0.05, test: float = 0.05) -> DataFrame:
    """``ratings`` plus label and partition: train before t1, val in [t1, t2), test from t2."""
    t1, t2 = order_statistic(ratings, "ts", 1 - test - validation), order_statistic(ratings, "ts", 1 - test)
    part = F.when(F.col("ts") < t1, "train").when(F.col("ts") < t2, "val").otherwise("test")
    return ratings.withColumn("label", label()).withColumn("partition", part)


def label() -> Column:
    return (F.col("rating") >= POSITIVE).cast("tinyint")


def check_no_leakage(split: DataFrame) -> None:
    """Raise unless all partitions have rows, their times don't overlap, and no (user, item) repeats."""
    seen = {r.partition: r for r in partition_bounds(split).collect()}
    if set(seen) != {"train", "val", "test"}:
        raise ValueError(f"empty partitions: {sorted({'train', 'val', 'test'} - set(seen))}")
    if not seen["train"].hi < seen["val"].lo or not seen["val"].hi < seen["test"].lo:
        raise ValueError("partitions overlap in time")
    require_unique(split, ["user_id", "item_id"])


def require_unique(df: DataFrame, keys: list[str]) -> None:
    if repeated := df.groupBy(*keys).count().where("count > 1").limit(1).collect():
        raise ValueError(f"{keys} repeat: {repeated[0]}")


def expectations(df: DataFrame, rules: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """(rule, violations): rows for which a rule, in SQL, is false or null, all in one pass. ``columns`` makes the schema strict."""
    if columns is not None and set(columns) != set(df.columns):
        raise ValueError(f"columns differ: {sorted(set(columns) ^ set(df.columns))}")
    counted = df.agg(*[F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


RATING_RULES = {
    "user_id": "user_id >= 0", "item_id": "item_id >= 0", "ts": "ts >= 0",
    "rating": "rating between 0.5 and 5.0 and rating * 2 = floor(rating * 2)",
}
MOVIE_RULES = {"item_id": "item_id >= 1", "title": "length(title) >= 1", "year": "year is null or year between 1870 and 2030", "genres": "genres is not null"}
TAG_RULES = {"user_id": "user_id >= 1", "item_id": "item_id >= 1", "tag": "length(tag) >= 1", "ts": "ts >= 0"}
LINK_RULES = {"item_id": "item_id >= 1"}


def sample_users(df: DataFrame, percent: int, seed: int = 42) -> DataFrame:
    """A steady share of users by a multiplicative hash of (user, seed); the bucket is taken from the high bits."""
    # The seed and hash multipliers and the modulus.
    seed_multiplier, multiplier, modulus = 0x9E3779B9, 2_654_435_761, 2**32
    offset = seed * seed_multiplier % modulus
    wide = lambda c: c.cast("decimal(20,0)")
    mixed = wide((F.col("user_id") + offset) % modulus) * F.lit(multiplier).cast("decimal(10,0)")
    return df.where(F.floor((mixed % modulus).cast("bigint") / 65536) % 100 < percent)


def fixed_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows, by least hash of all columns; the same rows each time."""
    return df.orderBy(unit(seed, *map(F.col, df.columns)), *df.columns).limit(n)


def split_users(users: DataFrame, excluded: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """(user_id, half): users that aren't excluded; the share of least hash is 'second', the rest 'first'."""
    pool = users.select("user_id").distinct().join(excluded.select("user_id"), "user_id", "left_anti")
    return pool.withColumn("half", F.when(unit(seed, F.col("user_id")) < share, "second").otherwise("first"))


def early_stop_users(evaluation: DataFrame, sample: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Users on whom training is stopped: those of a sample's evaluation rows, else a seeded half of all."""
    users = evaluation.select("user_id").distinct()
    if sample is not None:
        return users.join(sample.select("user_id").distinct(), "user_id", "left_semi")
    return split_users(users, users.limit(0), 0.5, seed).where("half = 'second'").select("user_id")


def partition_bounds(split: DataFrame) -> DataFrame:
    """(partition, n_rows, lo, hi, repeated): its times, and how many of its rows have a (user, item) that occurs elsewhere."""
    n = F.count("*").over(Window.partitionBy("user_id", "item_id"))
    marked = split.select("partition", "ts", (n > 1).alias("again"))
    return marked.groupBy("partition").agg(F.count("*").alias("n_rows"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count_if("again").alias("repeated"))


def lineage_differences(a: dict[str, object], b: dict[str, object]) -> list[str]:
    """Fields in which the lineage of two splits differs: they may be used together only if there is none."""
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))


def check_compatible(a: dict[str, object], b: dict[str, object]) -> None:
    if wrong := lineage_differences(a, b):
        raise ValueError(f"the splits differ in {wrong}")


def split_targets(targets: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets of the users in the set, and of the others."""
    return targets.join(users, "user_id", "left_semi"), targets.join(users, "user_id", "left_anti")


def split_statistics(split: DataFrame) -> DataFrame:
    """Per partition: rows, positives, users, items, first and last time, and how many users and items train doesn't know."""
    train = split.where("partition = 'train'")
    warm, seen = train.select("user_id", F.lit(1).alias("warm")).distinct(), train.select("item_id", F.lit(1).alias("seen")).distinct()
    rows = split.join(warm, "user_id", "left").join(seen, "item_id", "left")
    return rows.groupBy("partition").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("label").cast("bigint")).alias("n_positive"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.countDistinct(F.when(F.col("warm").isNull(), F.col("user_id"))).alias("cold_users"),
        F.countDistinct(F.when(F.col("seen").isNull(), F.col("item_id"))).alias("new_items"), F.count_if(F.col("warm").isNotNull() & (F.col("label") == 1)).alias("warm_positives"),
    )


def drop_orphans(ratings: DataFrame, tags: DataFrame, movies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings and tags of known items, and an audit (table, dropped)."""
    known = movies.select("item_id")
    audit = ratings.join(known, "item_id", "left_anti").agg(F.lit("ratings").alias("table"), F.count("*").alias("dropped"))
    audit = audit.unionByName(tags.join(known, "item_id", "left_anti").agg(F.lit("tags").alias("table"), F.count("*").alias("dropped")))
    return ratings.join(known, "item_id", "left_semi"), tags.join(known, "item_id", "left_semi"), audit


def recommendation_violations(recs: DataFrame, items: DataFrame, excluded: DataFrame) -> DataFrame:
    """(rule, violations) of lists: items outside the catalog, repeats within a list, items to be left out, and rows
    that score higher than the row before them (lists with score and rank)."""
    by = ["user_id", "item_id"]
    count = lambda df, rule, n=F.count("*"): df.agg(F.lit(rule).alias("rule"), F.coalesce(n, F.lit(0)).alias("violations"))
    out = count(recs.join(items, "item_id", "left_anti"), "unknown_item")
    out = out.unionByName(count(recs.groupBy(*by).count().where("count > 1"), "repeated_item", F.sum(F.col("count") - 1)))
    out = out.unionByName(count(recs.join(excluded, by, "left_semi"), "excluded_item"))
    return out.unionByName(count(out_of_order(recs), "score_order")) if {"score", "rank"} <= set(recs.columns) else out


def check_recommendations(recs: DataFrame, items: DataFrame, excluded: DataFrame) -> None:
    """Raise if a list holds an unknown item, an item twice, or one to be left out, or isn't in order of score where it has one."""
    if broken := [r.rule for r in recommendation_violations(recs, items, excluded).where("violations > 0").collect()]:
        raise ValueError(f"lists break {broken}")


def out_of_order(recs: DataFrame) -> DataFrame:
    """Rows that have a higher score than the row before them in rank."""
    before = F.lag("score").over(Window.partitionBy("user_id").orderBy("rank"))
    return recs.withColumn("before", before).where("score > before")


def check_score_order(recs: DataFrame) -> int:
    """How many rows have a higher score than the row before them in rank."""
    return out_of_order(recs).count()


def features_ahead(items: DataFrame, now: int, column: str = "item_last_ts") -> DataFrame:
    """(latest, ahead): the last time in a table of features, and how many rows reach the clock or pass it."""
    return items.agg(F.max(column).alias("latest"), F.count_if(F.col(column) >= now).alias("ahead"))


def check_clock(items: DataFrame, now: int, column: str = "item_last_ts") -> None:
    last = items.agg(F.max(column)).first()[0]
    if last is not None and last >= now:
        raise ValueError(f"features reach {last}, the clock says {now}")
