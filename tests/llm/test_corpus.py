"""The corpus operators against brute-force versions, on small inputs with odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.llm import lines as L
from tidemark.llm import mixing as X
from tidemark.llm import sentencepieces as SP
from tidemark.llm import vectors as V
from tidemark.llm.common import connected_components, hamming_links
from tidemark.llm.html_text import Page, main_text
from tidemark.llm.quality import keep_good, quality_scores
from tidemark.llm.sharding import communication_matrix, shard_documents
from tidemark.llm.simhash import covering_masks, fingerprint, simhash_dedup, simhash_groups
from tidemark.llm.toxicity import fold, toxicity
from tidemark.llm.words import split_lines, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def groups_of(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def odd(spark, *texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


def test_fingerprint_by_definition():
    words = "The quick brown FOX jumps é over".split()
    hs = [xxhash.xxh64_intdigest(" ".join(w.lower() if w.isascii() else w for w in words[i : i + 4]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > 4)
    assert fingerprint("\tThe quick\x0bbrown FOX  jumps\né over".encode()) == want
    assert fingerprint(None) == fingerprint(b" \n") == 0
    assert fingerprint(b"One two") == xxhash.xxh64_intdigest("one two", 42)


def test_masks_cover_every_pair():
    rng = random.Random(0)
    for radius, masks in ((4, covering_masks(4)), (4, L.pigeonhole_masks(4, 6))):
        for _ in range(3000):
            d = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & d == 0 for m in masks)


def test_simhash_groups_match_all_pairs(spark):
    base = documents(spark).select("doc_id", "text")
    docs = base.union(odd(spark, None, "", "x").select(F.col("doc_id") + 100_000, "text"))
    got = simhash_groups(docs).toPandas().sort_values("doc_id")
    fps = [int(h, 16) for h in got.fingerprint]
    want = groups_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for g, d in zip(want, got.doc_id, strict=True):
        least[g] = min(d, least.get(g, d))
    assert [least[g] for g in want] == got.component_id.tolist()
    assert simhash_groups(docs.limit(0)).count() == 0
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got.component_id)


def test_large_buckets_stay_exact():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3)
    fps = np.unique([int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(60)]).astype(np.uint64)
    masks = covering_masks(4)
    rows = sorted((t, int(np.int64(np.uint64(m) & f)), int(f.view(np.int64))) for t, m in enumerate(masks) for f in fps)
    col = lambda i, kind: pa.array([r[i] for r in rows], kind)
    whole = pa.RecordBatch.from_arrays([col(0, pa.int32()), col(1, pa.int64()), col(2, pa.int64())], names=["t", "key", "fp"])
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4]
    want = groups_of(len(fps), pairs)
    for limit in (1_000, 8):
        batches = [whole.slice(k, 300) for k in range(0, whole.num_rows, 300)]
        edges = [e for b in hamming_links(iter(batches), 4, masks, limit) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        names = {n: k for k, n in enumerate({int(f.view(np.int64)) for f in fps} | {x for e in edges for x in e})}
        got = groups_of(len(names), [(names[a], names[b]) for a, b in edges])
        mine = [got[names[int(f.view(np.int64))]] for f in fps]
        assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i != 20] + [(100, 90), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 21 for i in range(21, 41)} | {100: 90, 90: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>m</a></nav>
<main><article><header><h1>A &amp; b</h1><p>by me</p></header><p>One<br>two <b>three</b>.<p>Four &#169;&nbsp;x <!-- c --><ul><li>a<li>b</ul>
<div class="ad-slot">BUY</div><section id="comments"><p>lol</p></section><form>f</form><p>&lt;tag&gt;<span class="hidden">no</span></article></main><aside>s</aside><footer>f</footer></body></html>"""


def test_main_text(spark):
    assert Page(PAGE).text(set()) == "A & b\n\nOne two three.\n\nFour © x\n\na\n\nb\n\n<tag>"
    own = lambda i: f"<body><div><p>Welcome to our site</p></div><div><p>story {i} is here</p></div></body>"
    rows = [(i, f"https://h.example/{i}", own(i)) for i in range(8)] + [(8, None, None), (9, "x", ""), (10, "https://other.example", own(1))] + [(20 + i, "https://copy.example/a", own(3)) for i in range(9)]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "story 3 is here" and got[3].n_chars == 15 and got[3].n_template_blocks == 1
    assert got[8].text == got[9].text == "" and "Welcome" in got[10].text
    assert "story 3" in got[25].text and len(got) == 20


def test_what_stays_in_an_article():
    text = lambda source: Page(source).text(set())
    two = "<main><article><p>First story.</p></article><article><h2>B</h2><p>Second.</p></article></main><article><p>Teaser</p></article>"
    assert text(two) == "First story.\n\nB\n\nSecond."
    assert text("<article><p>One</p></article><div><article><p>Two</p><article class='comment'><p>lol</p></article></article></div>") == "One\n\nTwo"
    inner = "<section class='social-history'><p>S</p></section><div class='related-work'>R</div><div class='social share-bar'>x</div><div class='related'>x</div><p class='legal-history'>L</p>"
    assert text(f"<article><p>a</p>{inner}<div class='ad-slot-3'>x</div><div class='promo-summer'>x</div><noscript>N</noscript><object>O</object></article>") == "a\n\nS\n\nR\n\nL\n\nNO"
    assert text("<body><noscript>Enable scripts</noscript><p><a href=a>One linked paragraph</a></p><p><a href=b>Another</a></p><ul><li><a href=c>menu</a></ul></body>") == "One linked paragraph\n\nAnother"
    assert text("<article class='post comments-open'>kept</article>") == "kept"


def test_shapes_recur(spark):
    """Menus whose words change on each page are templates by their shape; one like them on another host, and the articles, stay."""
    box = lambda i: f"<div class=m{i}><p><a href=/{i}>go {i}</a></p><p><a href=/x{i}>see {i}</a></p></div>"
    rows = [(i, f"https://h.example/{i}", f"<body>{box(i)}<div><p>Story {i} is told here.</p><p>And ends {i}.</p></div></body>") for i in range(12)]
    rows += [(20, "https://other.example/", f"<body>{box(20)}<p>Alone.</p></body>"), (21, "https://h.example/m", "<nav>x 21</nav><article><p>Plain 21.</p></article>")]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"Story {i} is told here.\n\nAnd ends {i}." and got[i].n_template_blocks == 2 for i in range(12))
    assert got[20].text == "go 20\n\nsee 20\n\nAlone." and got[21].text == "Plain 21."


def slow_article(source):
    """Main text of a page of the test tables by Python's own parser: what lies in <article>, split at block tags."""
    from html.parser import HTMLParser

    blocks, line, depth, skip = [], [], 0, []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            nonlocal depth
            if tag in ("p", "h1", "h2", "h3", "div", "li", "ul", "ol", "section", "article", "blockquote", "aside", "form", "nav", "footer", "header", "table", "tr", "td"):
                blocks.append(" ".join("".join(line).split()))
                line.clear()
            if tag == "br":
                line.append(" ")
            if skip and tag == skip[0]:
                skip.append(tag)
            elif not skip and (tag in ("nav", "footer", "aside", "form", "script", "style") or {"ad", "comments"} & set((dict(attrs).get("class") or "").split())):
                skip.append(tag)
            depth += tag == "article"

        def handle_endtag(self, tag):
            nonlocal depth
            if tag in ("p", "h1", "h2", "h3", "div", "li", "ul", "ol", "section", "article", "blockquote", "aside", "form", "nav", "footer", "header", "table", "tr", "td"):
                blocks.append(" ".join("".join(line).split()))
                line.clear()
            if skip and tag == skip[-1]:
                skip.pop()
            depth -= tag == "article"

        def handle_data(self, data):
            if depth > 0 and not skip:
                line.append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(source or "")
    reader.close()
    return "\n\n".join(x for x in [*blocks, " ".join("".join(line).split())] if x)


def test_main_text_of_the_tables(spark):
    pages = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = main_text(pages).collect()
    assert len(got) == len(source) and all(r.text == slow_article(source[r.page_id]) for r in got)
    # Menus and footers of these tables differ from page to page; their shapes recur, on hosts with enough pages to tell.
    host = lambda r: (r.url or "").split("/")[2:3]
    many = [r for r in got if sum(host(r) == host(x) for x in got) >= 10]
    assert len(many) > 50 and sum(r.n_template_blocks > 0 for r in many) > 0.9 * len(many)
    menu = "<nav><ul><li>Home</li><li>News</li></ul></nav><div><p>Read all our stories</p></div>"
    planted = [(i, f"https://h.example/{i}", f"<body>{menu}{(s or '')[(s or '').find('<article'):]}") for i, s in list(source.items())[:40]]
    again = main_text(spark.createDataFrame(planted, "page_id long, url string, html string")).collect()
    assert all(r.text == slow_article(source[r.page_id]) and r.n_template_blocks >= 3 for r in again if "<article" in source[r.page_id])


def test_lines(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    base = [make(60) for _ in range(6)]
    texts = [None, "", "short one\nshort one"]
    for _ in range(30):
        picked = [list(rng.choice(base)) for _ in range(3)] + [make(20)]
        for line in picked:
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = "changed"
        texts.append("\n".join("  ".join(x).upper() if rng.random() < 0.3 else " ".join(x) for x in picked))
    docs = odd(spark, *texts)
    got = {(r.id, r.pos): r.keep for r in L.line_groups(docs, radius=4, min_words=5, block_rows=4).collect()}
    all_lines = [(i, p, L.normalise(x.encode())) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if len(x.split()) >= 5]
    hashed = [words_of([b" ".join(w)]) for _, _, w in all_lines]
    sims = [int(L.line_simhashes(x.words, x.sizes)[0]) for x in hashed]
    n = len(all_lines)
    link = [(i, j) for i in range(n) for j in range(i) if all_lines[i][2] == all_lines[j][2] or (sims[i] ^ sims[j]).bit_count() <= 4 and slow_edits(all_lines[i][2], all_lines[j][2]) <= 0.2 * max(len(all_lines[i][2]), len(all_lines[j][2]))]
    root = groups_of(n, link)
    first = {}
    for g, (i, p, _) in zip(root, all_lines, strict=True):
        first[g] = min((i, p), first.get(g, (i, p)))
    assert got == {(i, p): first[g] == (i, p) for g, (i, p, _) in zip(root, all_lines, strict=True)}
    out = {r.doc_id: r for r in L.line_dedup(docs, radius=4, min_words=5).collect()}
    assert len(out) == len(texts) and out[0].text is None and out[2].text == texts[2]
    assert sum(r._n_removed for r in out.values()) == sum(not k for k in got.values()) > 10


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_and_words_by_definition(monkeypatch):
    texts = ["A b  c\n\nd E\x0bf", None, "", "  \n é x", "a\tB c", "d e F\nd\r\n", "long " * 400]
    want = [(i, p, tuple(w)) for i, t in enumerate(texts) for p, x in enumerate((t or "").encode().split(b"\n")) if (w := x.lower().split())]
    for size in (1 << 20, 4, 1):
        monkeypatch.setattr("tidemark.llm.words.CHUNK_BYTES", size)
        got = words_of(texts)
        assert list(zip(got.row.tolist(), got.pos.tolist(), got.sizes.tolist(), strict=True)) == [(i, p, len(w)) for i, p, w in want]
        names = {}
        for (_, _, w), h, span in zip(want, got.h.tolist(), got.spans(), strict=True):
            assert names.setdefault(w, h) == h and len(set(span.tolist())) == len(set(w))
        assert len(set(names.values())) == len(names)
        assert [x.row.tolist() for x in split_lines(pa.array(texts).slice(3, 3), by_line=False)][0][0] == 0


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in "ab")
        assert L.edit_distance(a, b) == slow_edits(a, b)
        assert L.similar(np.array(a), np.array(b), 0.6) == (slow_edits(a, b) <= int(0.4 * max(len(a), len(b)) + 1e-9))


def test_quality(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{DATA}/labels.parquet")
    both = docs.unionByName(odd(spark, None, "").withColumn("doc_id", F.col("doc_id") + 10**6))
    got = quality_scores(both, labels).join(labels, "doc_id", "left").select("doc_id", "_quality", "_keep", "quality").toPandas()
    known = got[got.quality.notna()]
    assert (known._keep == (known.quality == 1)).mean() > 0.95 and len(got) == both.count() and got._quality.notna().all()
    kept = keep_good(both, labels)
    assert kept.columns == both.columns
    assert quality_scores(docs, labels.limit(0)).where("_keep is null").count() == 0
    assert keep_good(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    assert fold("Ｉd10t ıdıоt pa$$é 2024 a1") == ["idiot", "idiot", "passe", "2024", "ai"]
    rng = random.Random(5)
    filler = [f"word{c}" for c in "abcdefghijklmnop"]
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        text = [rng.choice(filler) for _ in range(30)]
        if bad:
            text[rng.randrange(30)] = rng.choice(["grumbleface", "zorkling", "z0rkling", "zorkly"])
        elif i % 50 == 1:
            text[7:9] = ["saint", "zorkling"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, "filler zorkst"), (None, "worda")]
    got = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    truth = dict(labels)
    held = got[got.held_out & got.doc_id.isin(truth)]
    assert len(held) > 100 and (held.predicted == held.doc_id.map(truth)).mean() > 0.97
    assert len(got) == len(rows) and got.score.between(0, 1).all() and got[got.doc_id == 5002].predicted.iloc[0] == 1


def brute(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return [ids[i] for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:900] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0])]
    got = V.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).toPandas()
    ids, hit = np.arange(1500), 0
    assert set(got.query_id) == set(range(0, 1500, 100)) and (got.groupby("query_id").size() == 10).all()
    for q in range(0, 1500, 100):
        mine = got[got.query_id == q].sort_values("rank")
        hit += len(set(mine.vec_id) & set(brute(x.astype(float), ids, q, 10)))
        assert np.allclose(mine.score, [np.linalg.norm(x[q].astype(float) - x[v]) for v in mine.vec_id])
    assert hit >= 0.9 * 150
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == list(range(700, 710))
    assert V.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_neighbour_lists_are_whole(spark):
    """Clusters whose lists hold fewer than k, repeated rows, two vectors of one id, and a null id."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        n = 100 + 40 * seed
        x = (rng.normal(size=(12, 16))[rng.integers(0, 12, n)] * 5 + rng.normal(size=(n, 16))).astype(np.float32)
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        rows += rows[:60] + [(0, x[5].tolist()), (None, x[0].tolist())]
        got = V.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), F.col("vec_id") % 25 == 0, recall=0.5).toPandas()
        assert sorted(got.groupby("query_id").size().to_dict().items()) == [(0, 20)] + [(q, 10) for q in range(25, n, 25)]
        assert not got[got.query_id != 0].duplicated(["query_id", "vec_id"]).any() and (got.query_id != got.vec_id).all()
    few = spark.createDataFrame(rows[:4] * 2, "vec_id long, embedding array<float>")
    assert V.nearest_neighbours(few, F.col("vec_id") == 0).select("vec_id").distinct().count() == 3 == V.nearest_neighbours(few, F.col("vec_id") == 0).count()


@pytest.mark.parametrize("block_rows", [1024, 4, 1])
def test_vector_duplicates(spark, block_rows):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 32))
    x = np.concatenate([c + rng.normal(size=(40, 32)) * s for c, s in zip(centre, (0.05, 0.2, 0.25, 0.3, 1.0), strict=True)]).astype(np.float32)
    x[10:15] = x[9]
    label = [int(v) for v in rng.integers(0, 2, len(x))]
    rows = [(i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, label, strict=True))] + [(900, None, 1), (901, [0.0] * 32, 1), (902, x[0].tolist(), None)]
    # Few rows a block make many cells (3 and 12), so the pruning of cells is at work.
    got = V.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block_rows=block_rows).toPandas().set_index("vec_id")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    ok = (y @ y.T >= 0.93) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(ok, False)
    assert got.loc[range(len(x))].n_links.tolist() == ok.sum(axis=1).tolist() and ok.sum() > 1000
    root = groups_of(len(x), zip(*np.nonzero(ok), strict=True))
    least = {}
    for i, g in enumerate(root):
        least[g] = min(i, least.get(g, i))
    assert got.loc[range(len(x))].component_id.tolist() == [least[g] for g in root]
    assert got.loc[[900, 901, 902]].n_links.sum() == 0 and got.loc[900].kept


def test_sharding(spark):
    counts = [100, 0, 37, 8, 1]
    m = np.array(communication_matrix(counts, 8, 1))
    assert m.sum(axis=1).tolist() == counts and np.ptp(m.sum(axis=0)) <= 1
    docs = documents(spark).unionByName(odd(spark, None, "é").withColumn("doc_id", F.lit(None).cast("long")))
    got = shard_documents(docs).toPandas()
    sizes = got.groupby("shard").slot.agg(["size", "min", "max", "nunique"])
    assert len(got) == docs.count() and np.ptp(sizes["size"]) <= 1 and len(sizes) == 8
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["size"] - 1).all() and (sizes["nunique"] == sizes["size"]).all()
    assert sorted(got[got.doc_id.isna()]["size"]) == [1, 3]
    assert shard_documents(docs.limit(0)).count() == 0


def test_mixing(spark):
    docs = documents(spark).unionByName(odd(spark, None, "").withColumn("doc_id", F.col("doc_id") + 10**6))
    targets = {"en": 0.25, "fr": 0.25, "de": 0.25, "es": 0.25}
    plan = X.mixing_rates(docs, documents(spark), "lang", targets).toPandas()
    p = plan[[c for c in plan if c.startswith("p") and c[1:].isdigit()]].to_numpy()
    mass = (plan.rows * plan.tokens).to_numpy()
    assert np.allclose((mass * plan.rate) @ p / mass.sum(), 0.25, atol=1e-4) and (plan.rate >= 0).all() and len(plan) == docs.count()
    mixed = X.mix(docs, documents(spark), "lang", targets=targets)
    assert mixed.columns == docs.columns and mixed.count() == (plan.copies * plan.rows).sum()
    assert X.mix(docs, documents(spark).limit(0), "lang").count() == docs.count()


def test_pieces(spark):
    pieces = SP.Pieces.load(spark, "file:///opt/tokenizers/piece_bpe_32k.model")
    coder = SP.Encoder(pieces)

    def slow(text):
        best = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 20), end):
                if text[start:end] in pieces.scores:
                    best[end] = max(best[end], best[start] + pieces.scores[text[start:end]][1])
            best[end] = max(best[end], best[end - 1] + coder.unknown)
        return best[-1]

    names = {i: s for s, (i, _) in pieces.scores.items()}
    for word in ("▁hello", "▁internationalisation", "▁éèêaux", "☃", "▁a☃b", "x" * 70, "▁"):
        ids = coder.word(word)
        unknown = len({c for c in word if c not in pieces.scores}) and sum(c not in pieces.scores for c in word)
        assert sum(pieces.scores[names[i]][1] for i in ids if i in names) + unknown * coder.unknown == pytest.approx(slow(word))
    texts = [None, "", " ", "  two  spaces ", "a\n\nb\t☃ ▁ literal", "日本語", *[r.text for r in documents(spark).limit(20).collect()]]
    docs = odd(spark, *texts)
    got = SP.encode(docs.withColumn("round_trip", F.lit(0)), pieces)
    assert got.where("not round_trip").count() == 0 and got.count() == len(texts)
    back = {r.doc_id: r.text for r in SP.decode(got.drop("text"), pieces).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]


def test_pipeline_runs(spark):
    import corpus_pipeline

    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA)
        assert docs.columns == before.columns
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.where("not round_trip").count() == 0
