"""Drift, interleaving and latency analysis (survey D28, D31-D32, K1-K8)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_SECONDS, POSITIVE
from tidemark.operators.evaluation import bootstrap, verdict
from tidemark.operators.features import as_of_join
from tidemark.sources.stages import stage

NUMERIC = ["rating", "hour_utc", "item_log_n_ratings_30d", "item_age_days", "item_year"]
CATEGORICAL = ["positive", "weekday", "item_genre"]


def event_features(events: DataFrame, item_snaps: DataFrame, movies: DataFrame) -> DataFrame:
    """What was known of each event's item at the start of its day, and when the event took place (UTC)."""
    rows = events.withColumn("event_day", F.floor(F.col("ts") / DAY_SECONDS).cast("bigint"))
    joined = as_of_join(rows, item_snaps, "item_id", "event_day", "snapshot_day", ["item_n_ratings_30d", "item_first_ts"])
    at = F.timestamp_seconds("ts")
    return joined.join(movies.select("item_id", "year", "genres"), "item_id", "left").select(
        "user_id", "item_id", "ts", F.col("rating").cast("double").alias("rating"), (F.col("rating") >= POSITIVE).cast("string").alias("positive"),
        F.hour(at).cast("double").alias("hour_utc"), (F.weekday(at) + 1).cast("string").alias("weekday"), F.log1p(F.coalesce("item_n_ratings_30d", F.lit(0)).cast("double")).alias("item_log_n_ratings_30d"),
        ((F.col("ts") - F.col("item_first_ts")) / DAY_SECONDS).alias("item_age_days"), F.col("year").cast("double").alias("item_year"), F.coalesce(F.get("genres", F.lit(0)), F.lit("(unknown)")).alias("item_genre"),
    )


def wasserstein(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(column, score): area between the two distribution functions over the reference's standard deviation.

    Values are counted first and fall into ranges between approximate quantiles; each range adds up its own steps, starting
    from the counts of the ranges before it, and the gap between two ranges is added once. No task sees all values.
    """
    sides = reference.select(F.col(column).alias("x"), F.lit(1).alias("a")).unionByName(current.select(F.col(column).alias("x"), F.lit(0).alias("a"))).where("x is not null and not isnan(x)")
    counts = stage(sides.groupBy("x").agg(F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb")))
    cuts = sorted(set(counts.approxQuantile("x", [i / 32 for i in range(1, 32)], 0.01)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("x"))) if cuts else F.lit(0)
    placed = counts.withColumn("p", part)
    edge = Window.orderBy("p")  # over a row a range
    ranges = placed.groupBy("p").agg(F.min("x").alias("lo"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    total = counts.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    starts = ranges.select("p", F.lead("lo").over(edge).alias("next"), (F.sum("na").over(edge) - F.col("na")).alias("a0"), (F.sum("nb").over(edge) - F.col("nb")).alias("b0")).crossJoin(total)
    w = Window.partitionBy("p").orderBy("x")
    area = F.abs((F.col("a0") + F.sum("na").over(w)) / F.col("ta") - (F.col("b0") + F.sum("nb").over(w)) / F.col("tb")).alias("d")
    steps = placed.join(F.broadcast(starts), "p").select((F.coalesce(F.lead("x").over(w), "next") - F.col("x")).alias("gap"), area)
    spread = reference.agg(F.stddev_pop(column).alias("sd"))
    return steps.agg(F.sum(F.col("gap") * F.col("d")).alias("area")).crossJoin(spread).select(F.lit(column).alias("column"), (F.col("area") / F.greatest("sd", F.lit(0.001))).alias("score"))


def jensen_shannon(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(column, score): square root of the divergence, natural logarithm, of the category shares."""
    def share(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
        return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).select("x", (F.col("n") / F.col("total")).alias(name))

    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    m = (p + q) / 2
    term = lambda a: F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
    both = share(reference, "p").join(share(current, "q"), "x", "full_outer")
    return both.agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(term(p) + term(q)) / 2)).alias("score")).select(F.lit(column).alias("column"), "score")


def drift_summary(reference: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(column, score, drifted, n_drifted, share_drifted) for all columns of ``event_features``."""
    parts = [wasserstein(reference, current, c) for c in NUMERIC] + [jensen_shannon(reference, current, c) for c in CATEGORICAL]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    flagged = out.withColumn("drifted", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    every = flagged.agg(F.count_if("drifted").alias("n_drifted"), F.avg(F.col("drifted").cast("double")).alias("share_drifted"))
    return flagged.crossJoin(F.broadcast(every))


def drift_windows(events: DataFrame, cutoff: int, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Events of the ``days`` before the cutoff, and of the last ``days`` up to the newest event."""
    end = events.agg(F.max("ts")).first()[0] or 0
    span = days * DAY_SECONDS
    return events.where((F.col("ts") >= cutoff - span) & (F.col("ts") < cutoff)), events.where((F.col("ts") > end - span) & (F.col("ts") <= end))


def interleave(impressions: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(impression_id, slot, item_id, team) by team draft from lists ``a`` and ``b``.

    The team with fewer picks goes first, a hash bit of (impression, round) decides when they are level. A row is one
    impression with two short lists, so the draft is a small loop in the task that has the row.
    """

    def draft(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, lists, bits in zip(b["impression_id"], zip(b["a"], b["b"], strict=True), b["bits"], strict=True):
                picks: dict[int, str] = {}
                taken, turn = {"A": 0, "B": 0}, 0
                queues = {"A": list(lists[0]), "B": list(lists[1])}
                while len(picks) < k and (queues["A"] or queues["B"]):
                    first = "A" if taken["A"] < taken["B"] or (taken["A"] == taken["B"] and not bits >> (turn % 62) & 1) else "B"
                    for team in (first, "AB".replace(first, "")):
                        while queues[team] and queues[team][0] in picks:
                            queues[team].pop(0)
                        if queues[team] and len(picks) < k:
                            picks[queues[team].pop(0)] = team
                            taken[team] += 1
                    turn += 1
                out += [(key, slot, item, team) for slot, (item, team) in enumerate(picks.items(), 1)]
            yield pd.DataFrame(out, columns=["impression_id", "slot", "item_id", "team"])

    bits = F.xxhash64(F.lit(seed), "impression_id").bitwiseAND(F.lit((1 << 62) - 1))
    return impressions.select("impression_id", "a", "b", bits.alias("bits")).mapInPandas(draft, "impression_id bigint, slot int, item_id bigint, team string")


def credit(shown: DataFrame, clicks: DataFrame) -> DataFrame:
    """Clicked items of each team per impression; 0 without clicks."""
    hit = shown.join(clicks.select("impression_id", "item_id", F.lit(1).alias("hit")), ["impression_id", "item_id"], "left")
    return hit.groupBy("impression_id").agg(*[F.count_if((F.col("team") == t) & (F.col("hit") == 1)).alias(f"clicks_{t.lower()}") for t in "AB"])


def interleaving_outcome(credits: DataFrame, **options) -> DataFrame:
    """Per-user clicks (user_id, clicks_a, clicks_b) to one row: users, wins of each team, clicks, share of B, and the interval of
    the mean delta (B - A) / (A + B) over users that clicked, with a verdict on B."""
    per_user = credits.groupBy("user_id").agg(F.sum("clicks_a").alias("a"), F.sum("clicks_b").alias("b")).where("a + b > 0")
    per_user = per_user.withColumn("delta", (F.col("b") - F.col("a")) / (F.col("a") + F.col("b")))
    counts = per_user.agg(
        F.count("*").alias("users"), F.count_if(F.col("a") > F.col("b")).alias("wins_a"), F.count_if(F.col("b") > F.col("a")).alias("wins_b"), F.sum("a").alias("clicks_a"), F.sum("b").alias("clicks_b"),
        (F.sum("b") / F.sum(F.col("a") + F.col("b"))).alias("share_b"),
    )
    return counts.crossJoin(bootstrap(per_user, ["delta"], **options).select(F.col("mean").alias("delta"), "low", "high")).withColumn("verdict", verdict())


def capped_impressions(positives: DataFrame, per_user: int = 20) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "item_id")
    return positives.where(F.col("rating") >= POSITIVE).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_user).drop("n")


PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
#: A rank that the sketch gives is off by one in so many rows at most.
SKETCH = 10_000


def latency_percentiles(log: DataFrame, stage_col: str, ms: str) -> DataFrame:
    """(stage, n, p50, p95, p99, max_ms), exact and linear between ranks; nulls don't count.

    A mergeable sketch a stage gives two values around each rank. The second pass counts the rows below and above them and
    keeps the values between, each with its number, so no buffer holds all values and equal ones are one row.
    """
    rows = log.select(F.col(stage_col).alias("stage"), F.col(ms).alias("v")).where("v is not null")
    ends = [min(max(p + side * 2 / SKETCH, 0.0), 1.0) for p in PERCENTILES.values() for side in (-1, 1)]
    sketch = rows.groupBy("stage").agg(F.count("*").alias("n"), F.max("v").alias("max_ms"), F.min("v").alias("min_ms"), F.percentile_approx("v", F.array(*map(F.lit, ends)), F.lit(SKETCH)).alias("e"))
    asked = [
        F.struct(F.lit(name).alias("name"), (p * (F.col("n") - 1)).alias("rank"), (F.col("min_ms") if ends[2 * k] == 0 else F.col("e")[2 * k]).alias("low"), F.col("e")[2 * k + 1].alias("high"))
        for k, (name, p) in enumerate(PERCENTILES.items())
    ]
    brackets = stage(sketch.select("stage", "n", "max_ms", F.explode(F.array(*asked)).alias("a")).select("stage", "n", "max_ms", "a.*"))  # three rows a stage
    side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0).alias("side")
    near = rows.join(F.broadcast(brackets), "stage").select("stage", "name", "v", side)
    counted = near.groupBy("stage", "name", "side", F.when(F.col("side") == 0, F.col("v")).alias("x")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # The nearest value on either side stands for its side: a rank may lie one beyond the two values.
    counted = counted.withColumn("v", F.when(F.col("side") < 0, F.col("hi")).otherwise(F.col("lo")))
    upto = F.sum("m").over(Window.partitionBy("stage", "name").orderBy("side", "v"))
    placed = counted.withColumn("upto", upto).join(F.broadcast(brackets), ["stage", "name"])
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    low, high = F.floor("rank"), F.least(F.floor("rank") + 1, F.col("n") - 1)
    found = placed.groupBy("stage", "name", "n", "max_ms", "rank").agg(at(low).alias("a"), at(high).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    return found.groupBy("stage", "n").agg(*[F.max(F.when(F.col("name") == p, value)).alias(p) for p in PERCENTILES], F.max("max_ms").alias("max_ms"))


def latency_histogram(log: DataFrame, stage_col: str, ms: str, edges: list[float]) -> DataFrame:
    """Per stage and upper edge, how many values don't exceed it; one pass, as many columns as edges."""
    counts: list[Column] = [F.count_if(F.col(ms) <= e).alias(f"le_{i}") for i, e in enumerate(edges)]
    wide = log.groupBy(F.col(stage_col).alias("stage")).agg(*counts)
    pairs = F.array(*[F.struct(F.lit(float(e)).alias("le"), F.col(f"le_{i}").alias("n")) for i, e in enumerate(edges)])
    return wide.select("stage", F.explode(pairs).alias("x")).select("stage", "x.le", "x.n")
