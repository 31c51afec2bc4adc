"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, cut, least_hashed, texts_as_bytes
from tidemark.llm.toxicity import logistic

#: Texts of a batch that are copied out of it at once.
TEXTS_AT_ONCE = 500

_PUNCTUATION = [i for i in range(33, 127) if not chr(i).isalnum()]


def features(text: bytes | None) -> np.ndarray:
    """Shares of byte classes and signs, word and line statistics of one whole text; an empty text is all zeros."""
    text = text or b""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    k = max(1, len(words))
    first = len({w.lower() for w in words})
    shares = np.sqrt(counts[_PUNCTUATION] / n)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    return np.r_[
        shares, upper / max(1, upper + lower), digits / n, counts[128:].sum() / n, counts[:33].sum() / n,
        math.log1p(len(words)), len(text) / k / 10, first / k, 1 - len(set(lines)) / max(1, len(lines)),
        np.mean([len(w) > 20 for w in words]) if words else 0.0, float(not words),
    ]


N_FEATURES = len(features(b""))


def feature_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """Features of a column of texts, a few at a time, as arrays of a row a text."""
    for i in range(0, len(texts), TEXTS_AT_ONCE):
        yield np.stack([features(t) for t in texts_as_bytes(texts.slice(i, TEXTS_AT_ONCE))])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -12, 12)


def fit_quality(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", sample_rows: int = 20_000) -> QualityModel:
    """Ridge logistic regression on at most ``sample_rows`` labelled rows, those of least hash of the id.

    Rows without a label are left out. With no row or one class, the model is constant.
    """
    picked = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("y"))
    ids = least_hashed(picked.select("id").distinct(), "id", sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [row for rows in feature_rows(b.column(0)) for row in rows.astype(np.float32)]
            yield batch(y=b.column(1), x=pa.array(x, pa.list_(pa.float32())))

    rows = picked.join(ids, "id", "left_semi").select("text", "y").mapInArrow(run, "y double, x array<float>").toArrow()
    y = rows["y"].to_numpy()
    if not len(y):
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1))
    x = np.stack(rows["x"].to_numpy()).astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    return QualityModel(mean, scale, logistic((x - mean) / scale, (y > 0.5).astype(float), l2=0.1))


def group_posteriors(evidence: DataFrame, strength: float = 20.0) -> DataFrame:
    """(host, path, host_post, path_post, prior) from rows (host, path, p): shares of good documents shrunk level by level.

    The strengths of the priors are moment estimates from the spread of the groups' means beyond what their sizes
    explain, ``strength`` where there is nothing to estimate from. Rows are summed per path, then per host, then over
    all, so a host of any size is a few partial sums. A host or path with few rows stays near the level above.
    """
    paths = cut(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good"), F.sum(F.col("p") * (1 - F.col("p"))).alias("noise")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    top = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good"), F.count("*").alias("k")).first()
    n, good = float(top.n or 0), float(top.good or 0.0)
    prior = (good + 1) / (n + 2)

    def prior_strength(groups: DataFrame, size: str, mean_good: str, above) -> float:
        """Beta strength whose variance between groups is the one seen, weighted by size, less binomial noise."""
        gap = F.pow(F.col(mean_good) / F.col(size) - above, 2)
        r = groups.where(F.col(size) > 1).agg(F.sum(gap * F.col(size)).alias("ss"), F.sum(size).alias("n"), F.count("*").alias("k")).first()
        if not r.n or r.k < 2:
            return strength
        between = max(r.ss / r.n - prior * (1 - prior) * r.k / r.n, 1e-6)
        return min(max(prior * (1 - prior) / between - 1, 1.0), 1e4)

    a = prior_strength(hosts, "host_n", "host_good", F.lit(prior))
    hosts = hosts.select("host", ((F.col("host_good") + a * prior) / (F.col("host_n") + a)).alias("host_post"))
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    b = prior_strength(both, "n", "good", F.col("host_post"))
    return both.select("host", "path", "host_post", ((F.col("good") + b * F.col("host_post")) / (F.col("n") + b)).alias("path_post"), F.lit(prior).alias("prior"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    label_col: str = "quality", threshold: float = 0.5, weight: float = 0.5, broadcast_rows: int = 100_000, sample_rows: int = 20_000,
) -> DataFrame:
    """``docs`` plus (_p_doc, _host_post, _path_post, _quality, _keep), every row kept.

    _quality is the document's log odds moved by ``weight`` times the log odds of its path over the prior; _keep says
    that it is at least ``threshold``. Null hosts and paths are groups of their own; null and empty texts are scored
    as such; several labels of an id count by their mean. Columns of docs that start with _ clash with none of these
    unless they have the same name.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.avg(label_col).alias("_y"))
    model = fit_quality(docs.select(id_col, text_col).join(least_hashed(known, id_col, sample_rows), id_col), text_col, "_y", id_col, sample_rows)

    @F.arrow_udf("double")
    def logit(text: pa.Array) -> pa.Array:
        return pa.array([y for rows in feature_rows(text) for y in model.logits(rows)], pa.float64())

    p = 1 / (1 + F.exp(-logit(F.col(text_col))))
    groups = group_posteriors(docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), p.alias("p")))
    groups = groups.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("host_post").alias("_host_post"), F.col("path_post").alias("_path_post"), F.col("prior").alias("_prior"))
    groups = cut(groups)
    if groups.count() <= broadcast_rows:
        groups = F.broadcast(groups)
    scored = docs.withColumn("_logit", logit(F.col(text_col)))
    scored = scored.join(groups, scored[host_col].eqNullSafe(groups["_host"]) & scored[path_col].eqNullSafe(groups["_path"]), "left")
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    final = F.col("_logit") + weight * (odds("_path_post") - odds("_prior"))
    return (
        scored.withColumn("_p_doc", 1 / (1 + F.exp(-F.col("_logit")))).withColumn("_quality", 1 / (1 + F.exp(-final))).withColumn("_keep", F.col("_quality") >= threshold).drop("_host", "_path", "_prior", "_logit")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their own columns only."""
    return quality_scores(docs, labels, **options).where("_keep").select(*[F.col(f"`{c}`") for c in docs.columns])
