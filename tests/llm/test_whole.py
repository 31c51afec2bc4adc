"""Whole-job tests: results against brute force without the candidate rules."""

import random

import numpy as np
from conftest import DATA
from test_corpus import groups_of, odd, slow_edits

from tidemark.llm import lines as L
from tidemark.llm import shingles as J
from tidemark.llm import sentencepieces as SP


def test_lines_cover_the_similarity(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "Of.\nAnd  ornd.\n\n", "of.\n  \nand ornd.\nOf. In", "Of. in"]
    for n in (5, 9, 12, 20, 40, 100, 300):
        base = [rng.choice(words) for _ in range(n)]
        for edits in (0, 1, 2, n // 10, n // 6, n // 5, n // 4):
            line = list(base)
            for _ in range(edits):
                at, kind = rng.randrange(len(line)), rng.random()
                line[at : at + 1] = [] if kind < 0.2 else [rng.choice(words)] if kind < 0.8 else [line[at], "the"]
            texts.append("\n".join([" ".join(line), " ".join(rng.choice(words) for _ in range(8))]))
    docs = odd(spark, *texts)
    got = {(r.id, r.pos): r.keep for r in L.line_groups(docs, block_rows=4, **L.WHOLE).collect()}
    rows = [(i, p, L.normalise(x.encode())) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if x.split()]
    link = [(i, j) for i in range(len(rows)) for j in range(i) if slow_edits(rows[i][2], rows[j][2]) <= 0.2 * max(len(rows[i][2]), len(rows[j][2])) + 1e-9]
    first: dict = {}
    root = groups_of(len(rows), link)
    for g, (i, p, _) in zip(root, rows, strict=True):
        first[g] = min((i, p), first.get(g, (i, p)))
    assert got == {(i, p): first[g] == (i, p) for g, (i, p, _) in zip(root, rows, strict=True)}
    out = {r.doc_id: r.text for r in L.line_dedup(docs).collect()}
    assert out[2] == "Of.\nAnd  ornd.\n\n" and out[3] == "  \nOf. In" and out[4] == ""


def test_similar_pairs_share_a_bucket(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(200)
    distinct = {L.line_hash(w): w for r in docs.collect() for x in (r.text or "").encode().split(b"\n") if len(w := L.normalise(x)) >= 5}
    h, ws = list(distinct), [np.array([hash(w) for w in x]) for x in distinct.values()]
    true = [(h[i], h[j]) for i in range(len(h)) for j in range(i) if L.similar(ws[i], ws[j], 0.8)]
    edges = [(r.a % 2**64, r.b % 2**64) for r in L.similar_candidates(L._lines(docs, "doc_id", "text"), 0.8).collect()]
    at = {x: i for i, x in enumerate(h)}
    root = groups_of(len(h), [(at[a], at[b]) for a, b in edges])
    assert true and all(root[at[a]] == root[at[b]] for a, b in true)


def test_pieces_across_runs_of_spaces(spark):
    pieces = SP.Pieces.load(spark, "file:///opt/tokenizers/piece_bpe_32k.model")
    coder, names = SP.Encoder(pieces), {i: s for s, (i, _) in pieces.scores.items()}
    longest = max(map(len, pieces.scores))

    def best(text):
        score = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            score[end] = score[end - 1] + coder.unknown
            for start in range(max(0, end - longest), end):
                if text[start:end] in pieces.scores:
                    score[end] = max(score[end], score[start] + pieces.scores[text[start:end]][1])
        return score[-1]

    for n in (1, 2, *range(3, 41)):
        for text in (f"x{' ' * n}y", " " * n, f"{' ' * n}if a:\n{' ' * n}return b{' ' * n}", f"a{' ' * n}b{' ' * (n // 2)}c"):
            ids = coder.encode(text)
            score = sum(pieces.scores[names[i]][1] if i in names else 0.0 for i in ids) + coder.unknown * text.count("\n") * ("\n" not in pieces.scores)
            assert abs(score - best((SP.SPACE + text).replace(" ", SP.SPACE))) < 1e-3 and coder.decode(ids) == text
    assert coder.encode("x   y") == [pieces.scores[s][0] for s in ("▁x", "▁▁", "▁y")]


def test_near_copies_by_jaccard(spark):
    import corpus_pipeline

    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    texts = [None, " ", "one two", "One  two", "one two three"]
    for n in (6, 30, 80, 250):
        base = [rng.choice(words) for _ in range(n)]
        for edits in (0, 1, 1, 2, 3, 4, 6):
            line = list(base)
            for _ in range(edits):
                line[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(line))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s", len(texts[5])), (5, "other text under a used id", "en", "s", 26), (5, "Other text under a used id", "en", "s", 26), (None, "one two", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    tokens = [(r[1] or "").lower().split() for r in rows]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in tokens]
    link = [(i, j) for i in range(len(rows)) for j in range(i) if tokens[i] == tokens[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    members: dict = {}
    for g, r in zip(groups_of(len(rows), link), rows, strict=True):
        members.setdefault(g, []).append(r)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    want = sorted(min(r[0] for r in m if r[0] is not None) for m in members.values())
    assert sorted(r.doc_id for r in got) == want and len(got) == len(members) < len(rows) - 10
    assert all(sum(tuple(r) in m for r in got) == 1 for m in members.values())
