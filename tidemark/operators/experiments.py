"""Evaluation of recommenders: setup, fit and evaluate, tuning, comparisons (survey J1, J3, J10-J12, J24-J33, B9, C16, D7, D25, K10, L1, L4)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import label_bucket, unit
from tidemark.operators import evaluation as E
from tidemark.operators import recommend as R
from tidemark.operators.ridge import ease_lists
from tidemark.sources.stages import stage


@dataclass(frozen=True)
class Setup:
    """What a model may see and what it is measured on: history before the cutoff, relevant and excluded items of warm users, and how many are cold."""

    history: DataFrame
    cutoff: int
    relevant: DataFrame
    excluded: DataFrame
    cold: DataFrame

    @property
    def users(self) -> DataFrame:
        return self.relevant.select("user_id").distinct()

    @property
    def items(self) -> DataFrame:
        return self.history.select("item_id").distinct()


class Model(Protocol):
    """Anything that gives each user of a setup a list (user_id, item_id, score, rank) of up to ``k`` unseen items."""

    name: str

    def lists(self, setup: Setup, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class Scores:
    """A model whose items have one score for all users, as a function of the setup."""

    name: str
    score: Callable[[Setup], DataFrame]

    def lists(self, setup: Setup, k: int) -> DataFrame:
        return R.popular_unseen(self.score(setup), setup.users, setup.excluded, k)


@dataclass(frozen=True)
class Neighbours:
    """Sum of similarities to the items of a user's history."""

    name: str
    similar: Callable[[Setup], DataFrame]

    def lists(self, setup: Setup, k: int) -> DataFrame:
        mine = setup.history.join(setup.users, "user_id", "left_semi")
        return R.score_by_similarity(mine, self.similar(setup), setup.excluded, k)


@dataclass(frozen=True)
class Ridge:
    """Sum of the ridge's weights of the items of a user's history."""

    name: str

    def lists(self, setup: Setup, k: int) -> DataFrame:
        mine = setup.history.join(setup.users, "user_id", "left_semi")
        return ease_lists(setup.history, mine, setup.excluded, k)


def eval_setup(split: DataFrame, partition: str) -> Setup:
    """Validation: train only, up to its first event. Test: train and validation, up to the test's first event."""
    history = split.where("partition = 'train'")
    if partition == "test":
        history = history.unionByName(split.where("partition = 'val'"))
    later = split.where(F.col("partition") == partition)
    cutoff = later.agg(F.min("ts")).first()[0]
    relevant, excluded, cold = R.targets(later, R.train_set(history, cutoff))
    return Setup(history, cutoff, stage(relevant), stage(excluded), cold)


def fit_and_evaluate(model: Model, setup: Setup, k: int = 100) -> DataFrame:
    """One row: model, users, mean metrics, coverage, Gini and mean popularity of its lists."""
    recs = stage(model.lists(setup, k))
    metrics = E.per_user_metrics(recs, setup.relevant, (10, k))
    names = [c for c in metrics.columns if c not in ("user_id", "n_relevant")]
    means = metrics.agg(F.count("*").alias("users"), *[F.avg(c).alias(c) for c in names])
    spread = E.coverage(recs, setup.items, 10).crossJoin(E.gini(recs, setup.items, 10)).crossJoin(E.average_popularity(recs, setup.history, 10).agg(F.avg("arp").alias("arp")))
    return means.crossJoin(spread).select(F.lit(model.name).alias("model"), "*")


def compare_models(models: list[Model], setup: Setup, k: int = 100) -> DataFrame:
    """A row a model: the table of a baseline report."""
    tables = [fit_and_evaluate(m, setup, k) for m in models]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def tune(models: list[Model], setup: Setup, metric: str = "recall_100") -> DataFrame:
    """``compare_models`` plus ``best``: the setting of largest metric, ties to the first name."""
    rows = compare_models(models, setup)
    place = F.row_number().over(Window.orderBy(F.desc(F.round(metric, 9)), "model"))  # a row a setting
    return rows.withColumn("best", place == 1)


def segment_table(per_user: DataFrame, labels: DataFrame, a: str, b: str, least: int = 30, **options) -> DataFrame:
    """(segment, users, mean_a, mean_b, difference, low, high, verdict) of segments with ``least`` users; the rest are left out, as too few to judge."""
    rows = per_user.join(labels.select("user_id", "segment"), "user_id").withColumn("difference", F.col(b) - F.col(a))
    means = rows.groupBy("segment").agg(F.count("*").alias("users"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b")).where(F.col("users") >= least)
    interval = E.bootstrap(rows, ["difference"], by="segment", **options).select("segment", F.col("mean").alias("difference"), "low", "high")
    return means.join(interval, "segment").withColumn("verdict", E.verdict())


def history_segments(history: DataFrame, edges: list[int], labels: list[str]) -> DataFrame:
    """(user_id, segment) by the length of the history."""
    return history.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", label_bucket(F.col("n"), edges, labels).alias("segment"))


def system_table(lists: dict[str, DataFrame], relevant: DataFrame, ks: tuple[int, ...] = (10, 100)) -> DataFrame:
    """(system, users, mean metrics) over all users with relevant items, a row a system."""
    tables = []
    for name, recs in lists.items():
        metrics = E.per_user_metrics(recs, relevant, ks)
        names = [c for c in metrics.columns if c not in ("user_id", "n_relevant")]
        tables.append(metrics.agg(F.count("*").alias("users"), *[F.avg(c).alias(c) for c in names]).select(F.lit(name).alias("system"), "*"))
    return reduce(DataFrame.unionByName, tables)


def paired_systems(lists: dict[str, DataFrame], relevant: DataFrame, metric: str, **options) -> DataFrame:
    """(a, b, interval and verdict of b - a) for each pair of systems, over the same users."""
    k = int(metric.rsplit("_", 1)[1]) if "_" in metric else 100
    per_user = {name: stage(E.per_user_metrics(recs, relevant, (k,))) for name, recs in lists.items()}
    pairs = [(a, b) for n, b in enumerate(per_user) for a in list(per_user)[:n]]
    found = [E.paired_difference(per_user[a], per_user[b], metric, **options).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*") for a, b in pairs]
    return reduce(DataFrame.unionByName, found)


def variants(lists: dict[str, DataFrame], k: int) -> DataFrame:
    """(variant, user_id, item_id, rank): what each system shows each user."""
    shown = [recs.where(F.col("rank") <= k).select(F.lit(name).alias("variant"), "user_id", "item_id", F.col("rank").cast("int").alias("rank")) for name, recs in lists.items()]
    return reduce(DataFrame.unionByName, shown)


def aligned_items(catalog: DataFrame, attributes: DataFrame) -> DataFrame:
    """A row for each catalog item with its attributes, null where absent; raises where an item has several."""
    if attributes.groupBy("item_id").count().where("count > 1").limit(1).collect():
        raise ValueError("attributes repeat an item")
    return catalog.join(attributes, "item_id", "left")


def popularity_tie_break(scores: DataFrame, popularity: DataFrame, weight: float = 1e-6) -> DataFrame:
    """Scores plus ``weight`` times each item's share of the largest popularity, so that equal scores follow popularity."""
    top = popularity.agg(F.max("score").alias("top"))
    share = popularity.crossJoin(F.broadcast(top)).select("item_id", (weight * F.col("score") / F.col("top")).alias("extra"))
    return scores.join(share, "item_id", "left").withColumn("score", F.col("score") + F.coalesce("extra", F.lit(0.0))).drop("extra")


def sample_requests(users: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n users of least hash: those to replay, or to ask for."""
    return users.select("user_id").distinct().orderBy(unit(seed, F.col("user_id")), "user_id").limit(n)
