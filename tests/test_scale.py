"""Operators on keys that hold most rows, in several blocks: the same results as on small ones."""

import random
import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import evaluation as E
from tidemark.operators import features as P
from tidemark.operators import monitoring as M
from tidemark.operators import pairs, recommend, ridge
from tidemark.operators import splits as T
from tidemark.operators.recommend import candidates, item_knn, popular_unseen, score_by_similarity


def brute_pairs(rows):
    by_user = {}
    for u, i in rows:
        by_user.setdefault(u, []).append(i)
    return Counter(p for items in by_user.values() for p in combinations(sorted(items), 2) if p[0] != p[1])


@pytest.mark.parametrize("hot", [1, 10**6])
def test_pairs_of_long_histories(spark, monkeypatch, hot):
    """One user holds a third of all rows, some are long, most are short, one repeats its rows."""
    rng = random.Random(1)
    rows = [(0, i) for i in range(400)] + [(u, rng.randrange(500)) for u in range(1, 60) for _ in range(rng.choice([1, 5, 30]))] + [(99, 5), (99, 5), (99, 7)]
    monkeypatch.setattr(pairs, "HOT", hot)
    df = spark.createDataFrame(rows, "user_id long, item_id long")
    got = {(r.i, r.j): r.n for r in pairs.co_occurrence(df, block=16).collect()}
    assert got == brute_pairs(rows)
    keys = pairs.dealt(df, 16).groupBy("user_id", "part").count().agg(F.max("count")).first()[0]
    assert keys <= 3 * 16


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_pairs_are_made_where_they_are_counted(spark, monkeypatch, hot_rows):
    """No pair of an ordinary item is shuffled by both its items, and none again for the nearest; items of many rows give the same."""
    rng = random.Random(6)
    rows = [(u, rng.randrange(25)) for u in range(40) for _ in range(rng.choice([1, 4, 9]))]
    monkeypatch.setattr(pairs, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(pairs, "PAIRS_PER_TASK", 100)
    df = spark.createDataFrame(rows, "user_id long, item_id long")
    both, near = pairs.co_occurrence(df, block=4), item_knn(df, 3)
    want = brute_pairs(rows)
    assert {(r.i, r.j): r.n for r in both.collect()} == want
    size, similar = Counter(i for _, i in rows), {}
    for (i, j), n in want.items():
        for a, b in ((i, j), (j, i)):
            similar.setdefault(a, []).append((-round(n / ((size[i] * size[j]) ** 0.5 + 10), 9), b))
    assert sorted((r.item_id, r.other) for r in near.collect()) == sorted((a, b) for a, x in similar.items() for _, b in sorted(x)[:3])
    for df in (both, near):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        by_both = re.findall(r"Exchange hashpartitioning\((?:i|item_id)#\d+L, [^)]*(?:j|other)#", plan)
        assert bool(by_both) == (hot_rows == 3)
        assert hot_rows == 3 or len(re.findall(r"Exchange hashpartitioning\(item_id#\d+L, \d+\), REPARTITION_BY_NUM", plan)) == 1


def test_pairs_of_latest_rows_and_of_none(spark):
    rows = [(1, i, 100 - i) for i in range(20)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, ts long")
    assert {(r.i, r.j) for r in pairs.co_occurrence(df, max_history=3).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert pairs.co_occurrence(df.limit(0)).collect() == []
    assert item_knn(df.limit(0)).collect() == []


@pytest.mark.parametrize("k", [1, 4, 50])
def test_popular_lists_shuffle_histories_only(spark, monkeypatch, k):
    """Users who have seen nothing, all, the first, the last, some twice, or what isn't scored; others' rows count nothing. No row of a list is shuffled."""
    rng = random.Random(2)
    scores = [(i, float(rng.randrange(6))) for i in range(30)]
    seen = [(1, i) for i in range(30)] + [(2, i) for i, s in scores if s == 5] + [(3, 7), (3, 7), (3, 8), (3, 99)] + [(4, rng.randrange(30)) for _ in range(12)] + [(9, 1)]
    seen += [(5, min(scores, key=lambda x: (x[1], -x[0]))[0])]
    best = [i for i, _ in sorted(scores, key=lambda x: (-x[1], x[0]))]
    users = spark.createDataFrame([(u,) for u in range(6)], "user_id long")
    args = spark.createDataFrame(scores, "item_id long, score double"), users, spark.createDataFrame(seen, "user_id long, item_id long"), k
    got = popular_unseen(*args)
    want = sorted((u, n + 1, i, dict(scores)[i]) for u in range(6) for n, i in enumerate([i for i in best if (u, i) not in seen][:k]))
    assert sorted((r.user_id, r["rank"], r.item_id, r.score) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Generate explode" in plan and "Exchange hashpartitioning" not in plan.split("Generate explode")[0]
    monkeypatch.setattr(recommend, "TOP", 0)
    assert sorted((r.user_id, r["rank"], r.item_id, r.score) for r in popular_unseen(*args).collect()) == want
    marked = candidates(got, spark.createDataFrame([(0, best[0]), (0, 99), (4, best[-1]), (8, 1)], "user_id long, item_id long"))
    assert {r.user_id for r in marked.collect()} == {0, 4} and {r.n_relevant for r in marked.where("user_id = 0").collect()} == {2}
    assert [r.item_id for r in marked.where("label = 1 and user_id = 0").collect()] == [best[0]]


@pytest.mark.parametrize("small", [True, False])
def test_inverse_of_several_blocks(spark, monkeypatch, small):
    rng = np.random.default_rng(3)
    x = (rng.random((60, 23)) < 0.3).astype(float)
    x[0] = 1
    rows = [(u, 10 * i, 5.0, u) for u in range(60) for i in range(23) if x[u, i]]
    if not small:
        monkeypatch.setattr(ridge, "PANEL_BYTES", 0)
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long")
    p = np.linalg.inv(x.T @ x + 2 * np.eye(23))
    want = -p / np.diag(p)
    for block in (8, 1024) if small else (8,):
        got = {(r.item_id // 10, r.other // 10): r.similarity for r in ridge.ease(df, 100, 2.0, block).collect()}
        assert all(got.get((i, j), 0.0) == pytest.approx(want[i, j], abs=1e-10) for i in range(23) for j in range(23) if i != j)
        assert not any(i == j for i, j in got)


@pytest.mark.parametrize("panel", [0, 1 << 20])
def test_lists_of_the_ridge_are_sums_of_its_weights(spark, monkeypatch, panel):
    """Lists by columns of the matrix equal those of weights as rows; no step of the inverse passes blocks through the driver."""
    rng = random.Random(8)
    rows = sorted({(u, 10 * rng.randrange(12) + (200 if u % 2 else 0)) for u in range(40) for _ in range(5)})
    monkeypatch.setattr(ridge, "PANEL_BYTES", panel)
    monkeypatch.setattr(ridge, "USERS_PER_COPY", 15)
    monkeypatch.setattr(ridge, "SLAB_BYTES", 8 * 7 * 3)
    df = spark.createDataFrame(rows, "user_id long, item_id long")
    mine, seen = df.where("user_id < 30"), df.where("user_id < 20")
    want = {}
    for r in score_by_similarity(mine, ridge.ease(df, 100, 2.0, 7), seen, 4).collect():
        want.setdefault(r.user_id, []).append((r["rank"], r.item_id, r.score))
    got = {}
    lists = ridge.ease_lists(df, mine, seen, 4, 100, 2.0, 7)
    for r in lists.collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.item_id, r.score))
    assert set(got) == set(want) == set(range(30))
    for u, x in want.items():
        assert [r[:2] for r in sorted(got[u])] == [r[:2] for r in sorted(x)]
        assert [r[2] for r in sorted(got[u])] == pytest.approx([r[2] for r in sorted(x)], abs=1e-12)
    assert ridge.ease_lists(df.limit(0), mine.limit(0), seen.limit(0), 4).collect() == []


def test_blocks_of_the_ridge_are_not_broadcast(spark, monkeypatch):
    """A join by broadcast takes blocks through the driver: none holds the matrix."""
    plans, write = [], ridge._write
    monkeypatch.setattr(ridge, "_write", lambda df, *rest: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *rest))[1])
    df = spark.createDataFrame([(u, i) for u in range(9) for i in range(u + 1)], "user_id long, item_id long")
    ridge.ease(df, 100, 1.0, 4).count()
    assert len(plans) == 1 + 3 * 3 + 1
    assert not any("BroadcastExchange" in p and "m#" in p for p in plans[1:])


def test_only_the_most_popular_items_and_empty_history(spark):
    rows = [(u, i) for u in range(8) for i in range(u + 1)]
    df = spark.createDataFrame(rows, "user_id long, item_id long")
    assert {r.item_id for r in ridge.ease(df, 3, 1.0).collect()} == {0, 1, 2}
    assert ridge.ease(df.limit(0)).collect() == []


def brute_as_of(left, right):
    out = []
    for n, (k, t) in enumerate(left):
        seen = [(b, v) for a, b, v in right if None not in (k, t, b) and a == k and b <= t]
        out.append((n, max(seen)[1] if seen else None))
    return sorted(out)


@pytest.mark.parametrize("segment_rows", [1, 50, 10**6])
def test_as_of_of_one_key_in_many_ranges(spark, segment_rows):
    """All rows but a few are of one key; a range may hold rows of one side only."""
    rng = random.Random(4)
    left = [(7, rng.randrange(1000)) for _ in range(600)] + [(7, t) for t in range(1990, 2000)] + [(8, 5), (9, 5), (None, 5), (7, None), (7, -5)]
    right = [(7, t, f"v{t}") for t in rng.sample(range(1000), 300)] + [(8, 5, "x"), (8, 6, "y"), (None, 1, "z"), (7, None, "n")]
    ours = spark.createDataFrame([(n, *r) for n, r in enumerate(left)], "n long, k long, t long").repartition(4)
    theirs = spark.createDataFrame(right, "k long, s long, v string")
    got = P.as_of_join(ours, theirs, "k", "t", "s", ["v"], segment_rows)
    assert got.columns == ["n", "k", "t", "v"]
    assert sorted((r.n, r.v) for r in got.collect()) == brute_as_of(left, right)


def test_as_of_deals_a_long_key_to_many_ranges(spark):
    rows = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    cuts = P.time_ranges(rows, "k", "t", 100).first().cuts
    assert len(cuts) > 200 and cuts == sorted(cuts)
    assert P.time_ranges(rows, "k", "t", 5000) is None


def test_as_of_of_empty_sides(spark):
    some = spark.createDataFrame([(1, 2)], "k long, t long")
    none = spark.createDataFrame([], "k long, s long, v string")
    assert [r.v for r in P.as_of_join(some, none, "k", "t", "s", ["v"]).collect()] == [None]
    assert P.as_of_join(some.limit(0), none, "k", "t", "s", ["v"]).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 101, 201, 4000])
def test_percentiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    values = {"a": rng.normal(size=n).tolist(), "b": np.round(rng.exponential(size=n), 1).tolist(), "c": [4.0] * n}
    rows = spark.createDataFrame([(s, float(v)) for s, x in values.items() for v in x] + [("a", None)], "stage string, ms double").repartition(3)
    for r in M.latency_percentiles(rows, "stage", "ms").collect():
        want = np.percentile(values[r.stage], [50, 95, 99])
        assert (r.n, r.max_ms) == (n, max(values[r.stage])) and [r.p50, r.p95, r.p99] == pytest.approx(want.tolist(), abs=1e-12)


def test_percentiles_with_a_coarse_sketch(spark, monkeypatch):
    monkeypatch.setattr(M, "SKETCH", 50)
    values = np.random.default_rng(1).normal(size=5000)
    r = M.latency_percentiles(spark.createDataFrame([("x", float(v)) for v in values], "stage string, ms double"), "stage", "ms").first()
    assert [r.p50, r.p95, r.p99] == pytest.approx(np.percentile(values, [50, 95, 99]).tolist(), abs=1e-12)


def test_bootstrap_draws_the_same_by_vectors_and_by_rows(spark):
    rows = [(u, float(u % 7), None if u % 5 == 0 else u / 10.0, "even" if u % 2 == 0 else "odd") for u in range(60)]
    df = spark.createDataFrame(rows, "user_id long, a double, b double, segment string").repartition(3)
    mean = lambda value, w: F.sum(w * value) / F.nullif(F.sum(F.when(value.isNotNull(), w)), F.lit(0))
    key = lambda r: (r.metric, r["segment"] if "segment" in r else "")
    for by in (None, "segment"):
        one, other = (sorted(E.bootstrap(df, ["a", "b"], 200, by=by, aggregate=f).collect(), key=key) for f in (None, mean))
        for x, y in zip(one, other, strict=True):
            assert (x.metric, x.n) == (y.metric, y.n) and [x.mean, x.low, x.high] == pytest.approx([y.mean, y.low, y.high], abs=1e-12)
    weights = E.draws(list(range(2000)), 40, 1)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.03


def test_bootstrap_takes_an_aggregate(spark):
    df = spark.createDataFrame([(u, float(u)) for u in range(50)], "user_id long, a double")
    r = E.bootstrap(df, ["a"], 100, aggregate=lambda value, w: F.max(F.when(w > 0, value))).first()
    assert r["mean"] == 49.0 and r.low < 49.0 and r.high == 49.0


@pytest.mark.parametrize("from_day", [None, 15])
def test_snapshots_of_every_kind_of_feature(spark, from_day):
    rng = random.Random(9)
    events = [(k, float(rng.randint(1, 5)), rng.randrange(30) * 86400 + rng.randrange(86400)) for k in range(3) for _ in range(25)]
    kinds = [("count", None), ("sum", "rating"), ("min", "rating"), ("max", "ts")]
    made = tuple(P.Feature(f"{kind}_{days}_{pos}", kind, c, days, pos) for kind, c in kinds for days in (None, 4, 9) for pos in (False, True))
    df = spark.createDataFrame(events, "k long, rating double, ts long")
    got = {(r.k, r.snapshot_day): r for r in P.snapshots(df, P.FeatureTable("k", made), from_day).collect()}
    due = {(k, t // 86400 + 1 + w) for k, _, t in events for w in (0, 4, 9)}
    if from_day is not None:
        due = {(k, d) for k, d in due if d >= from_day} | {(k, from_day) for k, d in due if d < from_day}
    assert set(got) == due
    for (k, day), row in got.items():
        for f in made:
            inside = [(r, t) for a, r, t in events if a == k and t // 86400 < day and (f.days is None or t // 86400 >= day - f.days) and (r >= 4 or not f.positives)]
            values = [t if f.column == "ts" else r for r, t in inside]
            want = len(inside) if f.kind == "count" else sum(values) if f.kind == "sum" else None if not values else min(values) if f.kind == "min" else max(values)
            assert row[f.name] == want, (f.name, k, day)


def test_tasks_of_snapshots_and_as_of_joins_follow_the_rows(spark, monkeypatch):
    """Twice the rows are twice the tasks, so a task's memory stays; ordered snapshots hold ranges of the key, in order."""
    monkeypatch.setattr(P, "ROWS_PER_TASK", 100)
    spec = P.FeatureTable("k", (P.Feature("n", "count"), P.Feature("n_7d", "count", days=7)))
    made = {}
    for n in (1000, 2000):
        events = spark.createDataFrame([(i % 97, i * 5000, 4.0) for i in range(n)], "k long, ts long, rating double")
        plain, ordered = P.snapshots(events, spec), P.snapshots(events, spec, ordered=True)
        assert plain.rdd.getNumPartitions() == 2 * n // 100
        rows = ordered.withColumn("p", F.spark_partition_id()).collect()
        assert [(r.k, r.snapshot_day) for r in rows] == sorted((r.k, r.snapshot_day) for r in rows)
        assert len({(r.k, r.p) for r in rows}) == len({r.k for r in rows}) and len({r.p for r in rows}) > 4
        assert sorted((r.k, r.snapshot_day, r.n, r.n_7d) for r in rows) == sorted((r.k, r.snapshot_day, r.n, r.n_7d) for r in plain.collect())
        joined = P.as_of_join(events, events.select("k", F.col("ts").alias("s")), "k", "ts", "s", ["s"])
        assert joined.where("s = ts").count() == n
        made[n] = joined.rdd.getNumPartitions()
    assert made == {1000: 20, 2000: 40}


def test_cut_points_are_found_in_a_written_table(spark, monkeypatch):
    """Four passes look for two cut points; none of them makes the ratings again."""
    seen, found = [], T.order_statistic
    monkeypatch.setattr(T, "order_statistic", lambda df, *a: (seen.append(df), found(df, *a))[1])
    assert catalog.QUERIES["d13_cut_points"](spark, DATA).count() == 1
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert len(plans) == 2 and not any("Join" in p or "Window" in p for p in plans)


def test_shuffles_of_a_factorization_are_deleted_while_it_runs(spark, monkeypatch):
    """Twenty iterations write forty shuffles; when the lists are made, most of their files are gone."""
    rng = random.Random(5)
    rows = spark.createDataFrame(sorted({(rng.randrange(80), rng.randrange(60)) for _ in range(900)}), "user_id long, item_id long")
    top = spark.conf.get("spark.local.dir")
    files = lambda: {p.name.split("_")[1] for p in Path(top).rglob("shuffle_*.data")}
    there, cleaned, lists, seen = files(), recommend.shuffles_cleaned, recommend.vector_lists, []
    monkeypatch.setattr(recommend, "shuffles_cleaned", lambda s: cleaned(s, 0.2))
    monkeypatch.setattr(recommend, "vector_lists", lambda *a: seen.append(len(files() - there)) or lists(*a))
    found = recommend.implicit_als(rows, rows.select("user_id").distinct(), 5, rank=4, maxIter=20)
    assert found.count() == 5 * 80 and seen[0] < 25


def test_personal_lists_are_made_once(spark):
    """Who has no personal list is asked in several steps; the lists behind it aren't made again for each."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    schema = "user_id long, item_id long, score double, rank int"
    personal = spark.createDataFrame([(u, 7, 0.5, 1) for u in range(6)], schema).mapInArrow(count, schema)
    requests, popular = spark.createDataFrame([(u,) for u in range(9)], "user_id long"), spark.createDataFrame([(3, 9.0), (4, 8.0)], "item_id long, score double")
    found = recommend.recommend_with_fallback(requests, personal, popular, spark.createDataFrame([(8, 3)], "user_id long, item_id long"), 1)
    assert {(r.user_id, r.item_id) for r in found.collect()} == {(u, 7) for u in range(6)} | {(6, 3), (7, 3), (8, 4)}
    assert made.value == 6
