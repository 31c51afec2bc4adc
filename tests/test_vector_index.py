"""Inverted lists of compressed vectors against exact search, and lists by blocks against brute force."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import recommend as R
from tidemark.operators import vector_index as I


@pytest.fixture(scope="module")
def tables(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    vectors = e.where("vec_id % 10 <> 0").select("vec_id", "embedding").cache()
    return vectors, e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).cache()


def brute_force(vectors, queries, k, excluded=frozenset()):
    ids, x = (np.array(c) for c in zip(*[(r.vec_id, r.embedding) for r in vectors.orderBy("vec_id").collect()], strict=True))
    out = {}
    for r in queries.collect():
        scores = np.round(x.astype(float) @ np.array(r.q, dtype=float), 9)
        order = [j for j in np.argsort(-scores, kind="stable") if (r.query_id, ids[j]) not in excluded][:k]
        out[r.query_id] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def lists_of(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score, abs=1e-6)))
    return out


def test_recall_grows_with_probes_and_all_lists_are_exact(spark, tables):
    vectors, queries = tables
    index = I.build_index(vectors, lists=16, block_rows=20)
    assert index.bytes_per_vector == 24 and index.cells.count() > 20
    assert index.cells.agg(F.sum("n")).first()[0] == vectors.count()
    want = brute_force(vectors, queries, 10)
    exact = spark.createDataFrame([(q, v, s, n + 1) for q, found in want.items() for n, (v, s) in enumerate(found)], "query_id long, vec_id long, score double, rank int")
    recall = [E.recall_against_exact(I.search(index, queries, 10, p, fall_back=False), exact, 10).first()[0] for p in (1, None)]
    assert recall[1] >= 0.9 and recall[0] <= recall[1]
    assert lists_of(I.search(index, queries, 10, probes=16, fetch=10**4)) == want


def test_capped_fetch_falls_back_to_all_vectors(spark, tables):
    vectors, queries = tables
    near = brute_force(vectors, queries, 300)
    gone = {(q, v) for q, found in near.items() for v, _ in found if q % 20 == 0}
    excluded = spark.createDataFrame(sorted(gone), "query_id long, vec_id long")
    index = I.build_index(vectors, lists=8)
    found = I.search(index, queries, 10, probes=3, fetch=30, excluded=excluded)
    want, got = brute_force(vectors, queries, 10, gone), lists_of(found)
    sources = {r.query_id: r.source for r in found.select("query_id", "source").distinct().collect()}
    assert set(sources.values()) == {"lists", "all"} and {sources[q] for q in got if q % 20} == {"lists"}
    assert all(got[q] == want[q] for q, s in sources.items() if s == "all")
    assert all(len(got[q]) == 10 for q in got) and not {(q, v) for q, x in got.items() for v, _ in x} & gone
    short = I.search(index, queries, 10, probes=3, fetch=30, excluded=excluded, fall_back=False)
    enough = {r.query_id for r in short.groupBy("query_id").count().where("count >= 10").collect()}
    assert enough == {q for q, s in sources.items() if s == "lists"}


@pytest.mark.parametrize("segment", [40, 10**6])
def test_search_in_segments_gives_the_same(spark, tables, monkeypatch, segment):
    """Several copies and segments change nothing, and no more leaves a segment than its best."""
    vectors, queries = tables
    gone = {(q, v) for q, found in brute_force(vectors, queries, 300).items() for v, _ in found[:5] if q % 20 == 0}
    excluded = spark.createDataFrame(sorted(gone), "query_id long, vec_id long")
    index = I.build_index(vectors, lists=8, block_rows=20)
    same = lists_of(I.search(index, queries, 10, probes=3, fetch=30, excluded=excluded, fall_back=False))
    monkeypatch.setattr(I, "SEGMENT_ROWS", segment)
    monkeypatch.setattr(I, "QUERIES_PER_COPY", 6)
    left = []
    monkeypatch.setattr(I, "top_k", lambda df, n, *rest: (left.append(df.count()), E.top_k(df, n, *rest))[1])
    assert lists_of(I.search(index, queries, 10, probes=3, fetch=30, excluded=excluded, fall_back=False)) == same
    assert left[-1] <= queries.count() * 30
    left.clear()
    assert lists_of(I.search(index, queries, 10, probes=8, fetch=10**4, excluded=excluded)) == brute_force(vectors, queries, 10, gone)
    assert left[0] <= queries.count() * 10 * (1 if segment > 40 else -(-vectors.count() // 40))


def test_more_asked_than_there_are_and_no_queries(spark, tables):
    vectors, queries = tables
    few = vectors.orderBy("vec_id").limit(7)
    index = I.build_index(few, lists=2, codes=4)
    assert lists_of(I.search(index, queries.limit(3), 10)) == brute_force(few, queries.limit(3), 10)
    assert I.search(index, queries.limit(0), 10).count() == 0


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_vector_lists_by_blocks(spark, block_rows):
    rng = np.random.default_rng(2)
    users, items = rng.integers(-2, 3, (30, 4)).astype(float), rng.integers(-2, 3, (50, 4)).astype(float)
    seen = {(int(u), int(i)) for u, i in rng.integers(0, 50, (200, 2))} | {(3, i) for i in range(50)}
    frames = (
        spark.createDataFrame([(u, users[u].tolist()) for u in range(30)], "user_id long, vector array<double>"),
        spark.createDataFrame([(i, items[i].tolist()) for i in range(50)], "item_id long, embedding array<double>"),
        spark.createDataFrame(sorted(seen), "user_id long, item_id long"),
    )
    got = sorted((r.user_id, r["rank"], r.item_id, r.score) for r in R.vector_lists(*frames, 6, block_rows).collect())
    want = []
    for u in range(30):
        best = sorted((-float(users[u] @ items[i]), i) for i in range(50) if (u, i) not in seen)[:6]
        want += [(u, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_vector_lists_shuffle_k_rows_a_user_and_segment(spark):
    """What leaves a task is a user's k best of all its blocks of items, not of each block."""
    rng = np.random.default_rng(3)
    users, items = rng.normal(size=(6, 4)), rng.normal(size=(300, 4))
    frames = (
        spark.createDataFrame([(u, users[u].tolist()) for u in range(6)], "user_id long, vector array<double>"),
        spark.createDataFrame([(i, items[i].tolist()) for i in range(300)] + [(300, [float("nan"), 0.0, 0.0, 0.0]), (301, [float("inf"), 0.0, 0.0, 0.0])], "item_id long, embedding array<double>"),
        spark.createDataFrame([(u, i) for u in range(6) for i in range(0, 300, 3)], "user_id long, item_id long"),
    )
    made = []
    top_k, R.top_k = R.top_k, lambda scores, k: made.append(scores) or top_k(scores, k)
    try:
        got = sorted((r.user_id, r["rank"], r.item_id, r.score) for r in R.vector_lists(*frames, 5, block_rows=4).collect())
    finally:
        R.top_k = top_k
    scores = np.round(users @ items.T, 9)
    scores[:, ::3] = -np.inf
    assert got == sorted((u, n + 1, int(i), scores[u, i]) for u in range(6) for n, i in enumerate(np.lexsort((np.arange(300), -scores[u]))[:5]))
    tasks = 3 * spark.sparkContext.defaultParallelism
    assert made[0].count() <= 6 * 5 * tasks < 6 * 5 * 300 // 4  # a segment is several blocks


def test_best_items_of_large_small_and_equal_numbers():
    rng = np.random.default_rng(4)
    for scale in (1.0, 1e-7, 1e25, 1e80):
        users, items = rng.normal(size=(40, 8)), scale * np.repeat(rng.normal(size=(30, 8)), 3, axis=0)
        row, seen = np.repeat(np.arange(40), 20), rng.integers(0, 95, 800)
        best = R.BestItems(np.arange(40), users, row, seen, 7, rows=16)
        order = rng.permutation(90)
        for at in range(0, 90, 11):
            some = order[at : at + 11]
            best.add(some, items[some])
        scores = np.round(np.array([[np.einsum("j,j", u, i) for i in items] for u in users]), 9)
        scores[row[seen < 90], seen[seen < 90]] = -np.inf
        for u in range(40):
            want = np.lexsort((np.arange(90), -scores[u]))[:7]
            assert best.item[u].tolist() == want.tolist(), (scale, u)


def test_own_group_is_left_out_without_pairs(spark, tables):
    """Groups give what the pairs of queries and vectors of one group give, also in the answers from all vectors; a null is no group."""
    vectors, queries = tables
    group = lambda c: F.when(F.col(c) % 7 != 0, F.col(c) % 3).alias("group")
    items, asked = vectors.withColumn("group", group("vec_id")), queries.withColumn("group", group("query_id"))
    pairs = asked.select("query_id", "group").join(items.select("vec_id", "group"), "group").select("query_id", "vec_id")
    index, grouped = I.build_index(vectors), I.build_index(items)
    for options in ({"probes": 2, "fetch": 14}, {"probes": 8, "fetch": 10**4}, {"probes": 2, "fetch": 14, "fall_back": False}):
        want = I.search(index, queries, 10, excluded=pairs, **options).select("query_id", "vec_id", "rank", "source").collect()
        got = I.search(grouped, asked, 10, **options).select("query_id", "vec_id", "rank", "source").collect()
        assert sorted(got) == sorted(want) and len(got) > 0


def test_a_query_with_groups_makes_no_pairs(spark, monkeypatch):
    from tidemark import catalog

    seen, search = [], I.search
    monkeypatch.setattr(I, "search", lambda *a, **o: (seen.append(o.get("excluded")), search(*a, **o))[1])
    assert catalog.QUERIES["j17_capped_with_fallback"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [None]
