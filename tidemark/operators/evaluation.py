"""Ranking metrics and intervals over users (survey D9-D20, D24-D25, D28, D30, E3, K9)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scores: DataFrame, k: int, by: str = "user_id", score: str = "score", tie: str = "item_id") -> DataFrame:
    """The k best rows of each group, best first, ties to the smaller id, as ``rank``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def per_user_metrics(recs: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (10, 100)) -> DataFrame:
    """recall@K, ndcg@K and mrr of each user with relevant items; users without a list get 0."""
    hits = recs.select("user_id", "item_id", "rank").join(relevant.select("user_id", "item_id"), ["user_id", "item_id"]).groupBy("user_id")
    hits = hits.agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], *[F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"g{k}") for k in ks])
    wanted = relevant.groupBy("user_id").agg(F.count("*").alias("n_relevant"))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant")).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    out = wanted.join(hits, "user_id", "left")
    recall = [(F.coalesce(f"h{k}", F.lit(0)) / F.least(F.lit(k), F.col("n_relevant"))).alias(f"recall_{k}") for k in ks]
    ndcg = [(F.coalesce(f"g{k}", F.lit(0.0)) / ideal(k)).alias(f"ndcg_{k}") for k in ks]
    return out.select("user_id", "n_relevant", *recall, *ndcg, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


#: The cumulative Poisson law of mean 1, from 0 on.
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975080)


def draws(users: list, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, users x replicates. An MD5 of (seed, user, group) gives those of four replicates."""
    groups = range(-(-replicates // 4))
    found = np.empty((len(users), 4 * len(groups)), np.uint8)
    for k, u in enumerate(users):
        numbers = np.frombuffer(b"".join([md5(f"{seed}-{u}-{g}".encode()).digest() for g in groups]), ">u4")
        found[k] = np.searchsorted(POISSON, numbers / 4294967296.0, side="right")
    return found[:, :replicates]


def weight_of(user: Column, replicate: Column, seed: int) -> Column:
    """The weight that ``draws`` gives, as an expression."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), user.cast("string"), F.floor(replicate / 4).cast("string")))
    u = F.conv(digest.substr(1 + 8 * F.pmod(replicate, F.lit(4)), F.lit(8)), 16, 10).cast("bigint") / 4294967296.0
    return sum((F.when(u >= edge, 1).otherwise(0) for edge in POISSON), F.lit(0))


def bootstrap(per_user: DataFrame, metrics: list[str], replicates: int = 1000, level: float = 0.95, seed: int = 42, by: str | None = None, aggregate=None) -> DataFrame:
    """(metric, n, mean, low, high): Poisson bootstrap over users; ``aggregate(value, weight)`` takes the place of the weighted mean.

    A user's weights for all replicates are one vector, drawn from hashes, and a partition adds them up in one product of
    matrices: the shuffle carries partitions x replicates numbers, whatever the number of users. An aggregate of one's
    own gets a row a user and replicate instead, with the same weights. Users without a value don't count for that metric.
    """
    wide = per_user.select("user_id", (F.col(by) if by else F.lit("all")).cast("string").alias("segment"), *[F.col(m).cast("double").alias(m) for m in metrics])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for whole in batches:
            for b in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                weights = draws(b.column(0).to_pylist(), replicates, seed).astype(np.float64)
                values = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], axis=1).astype(np.float64)
                there = ~np.isnan(values)
                segments = b.column(1).to_pylist()
                for s in set(segments):
                    mine = np.array([x == s for x in segments])
                    made = np.stack([np.where(there, values, 0.0)[mine].T @ weights[mine], there[mine].T.astype(np.float64) @ weights[mine]])
                    sums[s] = sums[s] + made if s in sums else made
        for s, (total, weight) in sums.items():
            offsets = pa.array(np.arange(len(metrics) + 1, dtype=np.int32) * replicates)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (total, weight)]
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s] * len(metrics), pa.string()), "metric": metrics, "total": lists[0], "weight": lists[1]})

    long = wide.unpivot(["user_id", "segment"], metrics, "metric", "value").withColumn("w", F.lit(1))
    if aggregate is None:
        parts = wide.mapInArrow(add, "segment string, metric string, total array<double>, weight array<double>")
        each = parts.select("segment", "metric", F.posexplode(F.arrays_zip("total", "weight")).alias("r", "x"))
        runs = each.groupBy("segment", "metric", "r").agg((F.sum("x.total") / F.nullif(F.sum("x.weight"), F.lit(0.0))).alias("m"))
        mean = F.avg("value")
    else:
        drawn = wide.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        drawn = drawn.withColumn("w", weight_of(F.col("user_id"), F.col("r"), seed))
        runs = drawn.groupBy("segment", "r").agg(*[aggregate(F.col(m), F.col("w")).alias(m) for m in metrics]).unpivot(["segment", "r"], metrics, "metric", "m")
        mean = aggregate(F.col("value"), F.col("w"))
    tail = (1 - level) / 2
    ends = runs.groupBy("segment", "metric").agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))  # a row a replicate
    means = long.groupBy("segment", "metric").agg(F.count("value").alias("n"), mean.alias("mean"))
    out = means.join(ends, ["segment", "metric"]).select("segment", "metric", "n", "mean", "low", "high")
    return out.withColumnRenamed("segment", by) if by else out.drop("segment")


def paired_difference(a: DataFrame, b: DataFrame, metric: str, **options) -> DataFrame:
    """Interval of b - a over users; raises if the users differ."""
    both = a.select("user_id", F.col(metric).alias("a")).join(b.select("user_id", F.col(metric).alias("b")), "user_id")
    if not both.count() == a.count() == b.count():
        raise ValueError("the systems have different users")
    return bootstrap(both.select("user_id", (F.col("b") - F.col("a")).alias("difference")), ["difference"], **options).withColumn("verdict", verdict())


def verdict() -> Column:
    return F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("tie")


def coverage(recs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    return recs.where(F.col("rank") <= k).agg(F.countDistinct("item_id").alias("n")).crossJoin(items.agg(F.count("*").alias("catalog"))).select((F.col("n") / F.col("catalog")).alias("coverage"))


def gini(recs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Gini of how often catalog items are recommended, those never recommended included.

    Items with the same count are one weighted row, so the running sum is over different counts, not items.
    """
    counts = items.join(recs.where(F.col("rank") <= k).groupBy("item_id").agg(F.count("*").alias("c")), "item_id", "left").groupBy(F.coalesce("c", F.lit(0)).alias("c")).agg(F.count("*").alias("m"))
    run = counts.withColumn("before", F.sum("m").over(Window.orderBy("c")) - F.col("m"))
    n, total = F.sum("m"), F.sum(F.col("c") * F.col("m"))
    ranked = F.sum(F.col("c") * (F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2))
    return run.agg((2 * ranked / (n * total) - (n + 1) / n).alias("gini"))


def average_popularity(recs: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """Per user, the mean share of all interactions that the top k items have."""
    share = history.groupBy("item_id").agg(F.count("*").alias("c")).crossJoin(history.agg(F.count("*").alias("n"))).select("item_id", (F.col("c") / F.col("n")).alias("share"))
    return recs.where(F.col("rank") <= k).join(share, "item_id", "left").groupBy("user_id").agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("arp"))


def recall_against_exact(found: DataFrame, exact: DataFrame, k: int, by: str = "query_id", item: str = "vec_id") -> DataFrame:
    """Mean overlap of an approximate list with the exact one."""
    truth = exact.where(F.col("rank") <= k).select(by, item)
    hits = truth.join(found.where(F.col("rank") <= k).select(by, item, F.lit(1).alias("hit")), [by, item], "left").groupBy(by).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return hits.agg(F.avg("r").alias("recall"))


def parity(online: DataFrame, offline: DataFrame, key: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(feature, mismatches) of two tables: values that differ beyond a relative and absolute tolerance; NaN equals NaN."""
    both = online.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a")).join(offline.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b")), key, "full_outer")

    def differs(c: str) -> Column:
        a, b = F.col(f"a_{c}").cast("double"), F.col(f"b_{c}").cast("double")
        close = (F.isnan(a) & F.isnan(b)) | (F.abs(a - b) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b))))
        return F.col("_a").isNull() | F.col("_b").isNull() | ~F.coalesce(close, a.isNull() & b.isNull())

    return both.agg(*[F.count_if(differs(c)).alias(c) for c in columns]).unpivot([], columns, "feature", "mismatches")
