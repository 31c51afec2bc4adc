"""Ranked search against a brute-force version that scores every document for every item, and the query against its SQL."""

import glob
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
from conftest import DATA
from pyspark.sql import functions as F
from test_queries import rows

from tidemark.llm import lexical as X
from tidemark.llm import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(found[:k], 1)]
    return out


def got(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(120)] + ["É", "été", "日本", "a1", "x"]
    pick = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 30, 125])]) for _ in range(n))
    docs = [(i, pick(rng.choice([0, 1, 3, 20, 80]))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "--- !"), (5, docs[5][1]), (403, "W1,w2;W3\x00w4_w5 É"), (404, " ".join(["w7"] * 5000))]
    items = [(i, pick(rng.choice([1, 2, 10, 60]))) for i in range(30)] + [(90, None), (91, ""), (92, "absent"), (93, "w1 w1 W1"), (94, " ".join(vocabulary))]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_force(docs, items, 7))
    assert got(X.lexical_search(*frames, k=7, block=64)) == want
    assert got(X.lexical_search(*frames, k=7, item_bytes=500)) == want  # several blocks of items


def test_query_matches_its_sql(spark):
    duck = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    ours = queries.op12_lexical_search(spark, DATA)
    theirs = duck.execute(queries.ORACLES["op12_lexical_search"]).df()
    assert rows(ours.toPandas()) == rows(theirs)


def test_null_ids_repeated_rows_clashing_columns_and_empty_tables(spark):
    docs = [(None, "one two"), (3, "one two"), (3, "one two"), (2, "one two"), (1, "three")]
    items = [(None, "one"), (1, "two one"), (1, "two one"), (2, "four")]
    frame = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, score int").withColumn("rank", F.lit(1)).withColumn("item_id", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    found = X.lexical_search(frame, asked).collect()
    assert [(r["rank"], r.doc_id) for r in sorted(found, key=lambda r: r["rank"]) if r.item_id == 1] == [(1, 2), (2, 3), (3, 3), (4, None)]
    assert [(r["rank"], r.doc_id) for r in sorted(found, key=lambda r: r["rank"]) if r.item_id is None] == [(1, 2), (2, 3), (3, 3), (4, None)]
    assert X.lexical_search(frame.limit(0), asked).collect() == [] == X.lexical_search(frame, asked.limit(0)).collect()


def test_masks_group_documents_of_equal_terms():
    rng = np.random.default_rng(4)
    for n_terms in (1, 8, 63, 64, 65, 200):
        present = rng.random((n_terms, 300)) < 2 / n_terms
        masks, order, starts = X.masks_of(present)
        assert sorted(order.tolist()) == list(range(300)) and len({m.tobytes() for m in masks}) == len(masks)
        for mask, docs in zip(masks, np.split(order, starts[1:]), strict=True):
            assert (present[:, docs].T == mask).all()


def test_search_stops_early_and_safely():
    rng = np.random.default_rng(6)
    share = np.sort(rng.integers(1, 1000, (3, 5000)))
    present = rng.random((3, 5000)) < np.array([[0.001], [0.3], [0.9]])
    spans = [np.flatnonzero(p) for p in present]
    begin = np.r_[0, np.cumsum([len(s) for s in spans])]
    values = np.concatenate([share[t][s] for t, s in enumerate(spans)])
    worth = np.array([10_000, 100, 1])
    best = X.Best(3)
    postings = (begin, np.concatenate(spans), values, np.array([share[t][s].max() for t, s in enumerate(spans)]))
    scored = X.search_block(best, np.arange(3), worth, postings, np.arange(5000), np.zeros(5000, bool), group=4)
    scores = (worth[:, None] * share * present).sum(axis=0)
    assert best.score.tolist() == np.sort(scores)[::-1][:3].tolist() and scored < 100
