"""Token alignment against a brute-force version that compares all byte ranges."""

import random
from bisect import bisect_left
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment as A
from tidemark.llm import queries

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
ODD = [
    None, "", " ", "  ", "a ", "a\n  b", " a", "\n", "a\n", "▁x", " ▁ y z", "<|endoftext|> <s> x", "\x00", "x　 y", "\x1c a", "word " * 50,
    "é ñ 😀 日本語 テスト", "a" * 3000, "日本" * 400, "same words", "same words",
]


@pytest.fixture(scope="module")
def files(spark):
    return A.Tokenizers.load(spark, queries.BYTE_LEVEL, queries.PIECES)


def brute_force(texts, files):
    a_coder, b_coder = Tokenizer.from_str(files.a.decode()), sentencepiece.SentencePieceProcessor(model_proto=files.b)
    a_coder.encode_special_tokens = True
    tables = A.Aligner(files)
    found, counts = [], Counter()
    for t in texts:
        found.append(None)
        if not t:
            continue
        a, b = a_coder.encode(" " + t, add_special_tokens=False).ids, b_coder.encode(t)
        pieces = [tables.bytes_a[i] for i in a], [tables.bytes_b[i] for i in b]
        if any(b"".join(p) != (" " + t).encode() for p in pieces):
            continue
        sa, sb = ([(e - len(x), e) for x, e in zip(p, np.cumsum([len(x) for x in p]).tolist(), strict=True)] for p in pieces)
        shared = sorted({e for _, e in sa} & {e for _, e in sb})
        members = [([], []) for _ in shared]
        for side, (ids, spans) in enumerate(((a, sa), (b, sb))):
            for i, (_, e) in zip(ids, spans, strict=True):
                members[bisect_left(shared, e)][side].append(str(i))
        groups = [f"{','.join(one)}|{','.join(other)}" for one, other in members]
        owner_a, owner_b = ([k for k, (s, e) in enumerate(spans) for _ in range(s, e)] for spans in (sa, sb))  # of each byte
        links = Counter((a[i], b[j]) for i, j in set(zip(owner_a, owner_b, strict=True)))
        counts += links
        found[-1] = (len(a), len(b), groups, links)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for x in found:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        n_best = sum(n for k, n in links.items() if counts[k] == best[k[1]])
        out.append((n_a, n_b, len(groups), sum(links.values()), n_best, sum(n * counts[k] for k, n in links.items()), ";".join(groups)))
    return out


def texts_of(rows, columns=COLUMNS):
    return [tuple(r[c] for c in columns) for r in rows]


def test_odd_texts(spark, files):
    random.seed(3)
    letters = lambda: random.choice([32, 32, 10, 9, 0x1C, 0x85, 0xA0, 39, 115, 0x2581, random.randrange(33, 0x2FFF), random.randrange(0x10000, 0x1FFFF), random.randrange(33, 127)])
    texts = ODD + ["".join(chr(letters()) for _ in range(25)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = A.alignment(docs, files, whole=True).orderBy("doc_id").collect()
    assert texts_of(got) == brute_force(texts, files)


def test_query_over_its_whole_table(spark, files):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = queries.op11_token_alignment(spark, DATA).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in docs]
    want = [(*w[:-1], sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in brute_force([r.text for r in docs], files)]
    assert texts_of(got, [*COLUMNS[:-1], "groups_sha256"]) == want


def test_rare_pairs_are_joined(spark, files, monkeypatch):
    texts = ["the cat and the hat", "the other", "unusual words thinly spread", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_force(texts, files)
    for often in (1, 8, 10**9):  # no pair, some and all pairs go to every task
        monkeypatch.setattr(A, "FREQUENT", often)
        assert texts_of(A.alignment(docs, files, whole=True).orderBy("doc_id").collect()) == want


def test_null_ids_repeated_rows_clashing_columns_and_empty_table(spark, files):
    rows = [(None, "one two", 1), (7, "one two", 2), (7, "one two", 2), (8, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int").withColumn("links", F.lit("x")).withColumn("_row", F.lit(0)).withColumn("n_best", F.lit(0))
    got = A.alignment(docs, files, whole=True).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [None, 7, 7, 8]
    assert sorted(texts_of(got)) == sorted(brute_force([r[1] for r in rows], files))
    assert A.alignment(docs.limit(0), files).collect() == []


def test_very_long_text(spark, files):
    text = "".join(random.Random(5).choice(["word ", "Ünïcödé", "xyzzy\n", "  ", "42"]) for _ in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "x" * 100_000)], "doc_id long, text string")
    for r in A.aligned(docs, files).collect():
        assert r.n_links == r.n_a + r.n_b - r.n_groups and sum(x.times for x in r.links) == r.n_links
        assert r.n_groups == r.groups.count(";") + 1


def test_one_text_and_many_give_the_same_cuts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        ends = []
        for _ in range(20):
            size = int(rng.integers(1, 40))
            ends.append([np.array(sorted({*rng.choice(size, rng.integers(0, size + 1)).tolist(), size}) or [size]) for _ in range(2)])
            ends[-1] = [e[e > 0] for e in ends[-1]]
        first = [np.r_[0, np.cumsum([len(e[k]) for e in ends])] for k in range(2)]
        many = A.cut_many(*(np.concatenate([e[k] for e in ends]) for k in range(2)), *first)
        ones = [A.cut_one(a.tolist(), b.tolist()) for a, b in ends]
        for name, k in (("after_a", 0), ("after_b", 1), ("link_a", 0), ("link_b", 1)):
            assert getattr(many, name).tolist() == np.concatenate([getattr(c, name) + first[k][w] for w, c in enumerate(ones)]).tolist()


def test_fast_encoder_gives_the_ids_of_the_files_own(spark, files):
    own = Tokenizer.from_str(files.a.decode())
    own.encode_special_tokens = True
    texts = [" " + r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(100).collect()] + [" it's  we'LL\t x y <|endoftext|>"]
    fast = A.byte_level_encoder(files.a, A.Aligner(files).bytes_a)
    assert fast(texts) == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
