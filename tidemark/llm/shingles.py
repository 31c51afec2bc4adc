"""Near copies by exact Jaccard similarity of word shingles.

Candidates are the pairs of the SimHash operator's covering tables and those that agree in a band of minimum hashes: two
texts of similarity 0.8 differ in some 10 of 64 bits, which no covering of so few bits reaches with selective tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, connected_components, cut
from tidemark.llm.lines import TEXTS_PER_BATCH, _bitmap, _differ, _in_bitmap, _may_be_similar, first_seen, line_sketches, shared
from tidemark.llm.simhash import near_links
from tidemark.llm.vectors import block_pairs, blocks, small_batches
from tidemark.llm.words import Lines, bit_majorities, mixed, split_lines


def runs(texts: Lines, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` words, repeats included, text by text, and how many each has; a shorter text is one run."""
    w, n = texts.words, len(texts.words)
    rolled = np.zeros(n, np.uint64)
    for i in range(words):
        rolled[: max(0, n - i)] = mixed(rolled[: max(0, n - i)] ^ w[i:])
    first = np.cumsum(texts.sizes) - texts.sizes
    short = texts.sizes <= words
    rolled[first[short]] = texts.h[short]
    counts = np.maximum(texts.sizes - words + 1, 1)
    return rolled[np.arange(n) - np.repeat(first, texts.sizes) < np.repeat(counts, texts.sizes)], counts


def shingles(texts: Lines, words: int) -> list[np.ndarray]:
    """Of each text the different hashes of its runs of words, sorted."""
    if not len(texts.sizes):
        return []
    hashes, counts = runs(texts, words)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]


def simhash_links(rows: DataFrame, words: int) -> DataFrame:
    """Edges (a, b) of text hashes that connect what fingerprints within the SimHash operator's radius connect."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for texts in split_lines(b.column(2), by_line=False):
                texts = texts.take(first_seen(texts.h, seen))
                if len(texts.h):
                    yield batch(h=texts.h.view(np.int64), fp=bit_majorities(*runs(texts, words)).view(np.int64))

    prints = cut(rows.mapInArrow(read, "h bigint, fp bigint").distinct())
    near = connected_components(near_links(prints.select("fp").distinct()))
    named = prints.join(near, prints["fp"] == near["node"], "left").select("h", F.coalesce("component", "fp").alias("c"))
    return named.join(named.groupBy("c").agg(F.min("h").alias("least")), "c").where("h <> least").select(F.col("h").alias("a"), F.col("least").alias("b"))


def band_links(rows: DataFrame, words: int, bands: int = 25, depth: int = 5) -> DataFrame:
    """Edges (a, b) of text hashes that connect texts which agree in all ``depth`` minimum hashes of one of ``bands`` bands.

    A pair of similarity s is missed with a chance of (1 - s^depth)^bands: 5e-5 at 0.8, less above.
    """
    turns = np.random.default_rng(11).integers(1 << 62, 1 << 63, bands * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for texts in split_lines(b.column(2), by_line=False):
                texts = texts.take(first_seen(texts.h, seen))
                if not len(texts.h):
                    continue
                hashes, counts = runs(texts, words)
                starts, keys = np.cumsum(counts) - counts, []
                for band in range(bands):
                    key = np.full(len(counts), band, np.uint64)
                    for turn in turns[band * depth : (band + 1) * depth]:
                        key = mixed(key ^ np.minimum.reduceat(hashes * turn, starts))
                    keys.append(key.view(np.int64))
                yield batch(key=np.concatenate(keys), h=np.tile(texts.h.view(np.int64), bands))

    keyed = cut(rows.mapInArrow(read, "key bigint, h bigint"))
    least = keyed.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("key", "least")
    return keyed.join(least, "key").where("h <> least").select(F.col("h").alias("a"), F.col("least").alias("b")).distinct()


def _verified(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Edges that connect what pairs of Jaccard similarity ``least`` connect; sets reached leave the rest at once."""
    n = np.array([len(x) for x in sets])
    sketch = line_sketches(np.concatenate(sets), n)
    left, right, rest = [], [], np.arange(len(sets))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.flatnonzero(_may_be_similar(n, _differ(sketch, rest, x), rest, x, least, True))
            both = [shared(sets[x], sets[i]) for i in rest[near]]
            hits = near[[b >= least * (n[x] + n[i] - b) - 1e-9 for b, i in zip(both, rest[near], strict=True)]] if len(near) else near
            left += [x] * len(hits)
            right += rest[hits].tolist()
            queue += rest[hits].tolist()
            rest = np.delete(rest, hits)
    return left, right


def text_groups(docs: DataFrame, text_col: str = "text", words: int = 5, least: float = 0.8, block_rows: int = 128) -> DataFrame:
    """(h, g) of each normalised text's hash that Jaccard similarity at least ``least`` connects to another; g names the component."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.lit(0).alias("id"), F.xxhash64(text).alias("doc"), text.alias("text"))
    candidates = simhash_links(rows, words).unionByName(band_links(rows, words))
    cluster = connected_components(candidates).select(F.col("node").alias("h"), F.col("component").alias("cluster"))
    suspects = cut(cluster)
    seen = _bitmap(suspects, "h")

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in split_lines(b.column(2), by_line=False):
                texts = texts.take(_in_bitmap(seen, texts.h.view(np.int64)))
                yield batch(h=texts.h.view(np.int64), words=pa.array([x.tobytes() for x in shingles(texts, words)], pa.binary()))

    texts = rows.mapInArrow(payload, "h bigint, words binary").groupBy("h").agg(F.first("words").alias("words"))
    packed = cut(blocks(suspects.join(texts, "h"), ["cluster"], "h", ["h", "words"], block_rows))
    alone, cross = packed.select(F.col("members").alias("m1"), F.slice("members", 1, 0).alias("m2")), block_pairs(packed, "cluster")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                members = [x.values for x in (b.column(0)[i], b.column(1)[i])]
                h = np.concatenate([m.field(0).to_numpy() for m in members])
                sets = [np.frombuffer(w, np.uint64) for m in members for w in m.field(1).to_pylist()]
                left, right = _verified(sets, least)
                yield batch(a=h[np.array(left, int)], b=h[np.array(right, int)])

    with small_batches(docs.sparkSession):
        edges = cut(alone.unionByName(cross).mapInArrow(verify, "a bigint, b bigint"))
    return connected_components(edges).select(F.col("node").alias("h"), F.col("component").alias("g"))


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near copies: that of least id (nulls last), of repeated ids that of least row hash.

    Texts are near copies if the sets of their ``words``-word shingles have at least Jaccard similarity ``least``;
    groups are the connected components. Texts of equal words are one text; null and blank ones are all equal.
    Rows equal in all columns count once; no row gives no row; extra columns stay as they are.
    """
    with small_batches(docs.sparkSession, TEXTS_PER_BATCH):
        group = text_groups(docs, text_col, words, least)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.zeros(b.num_rows, np.int64)  # blank texts
            for texts in split_lines(b.column(2), by_line=False):
                h[texts.row] = texts.h.view(np.int64)
            yield batch(id=b.column(0), row=b.column(1), h=h)

    kind = docs.schema[id_col].dataType.simpleString()
    row = F.xxhash64(*docs.columns)
    keyed = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = cut(keyed.mapInArrow(read, f"id {kind}, row bigint, h bigint"))
    # Equal rows are counted first, so the copies of a hot text meet as partial sums.
    least_of = keyed.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("kept"))
    kept = least_of.join(group, "h", "left").groupBy(F.coalesce("g", "h").alias("g")).agg(F.min("kept").alias("kept")).select("kept.id", "kept.row")
    repeats = keyed.groupBy("id", "row").agg(F.count("*").alias("n")).select(F.col("id").alias("_id"), F.col("row").alias("_r"), "n")
    chosen = cut(kept.join(repeats, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_r"))).select("_r", "n"))
    marked = docs.withColumn("_row", row)
    once = marked.join(chosen.where("n = 1"), F.col("_row") == F.col("_r"), "left_semi").select(*docs.columns)
    # Rows equal in all columns: one of them stays.
    again = marked.join(chosen.where("n > 1"), F.col("_row") == F.col("_r"), "left_semi").select(*docs.columns).distinct()
    return once.unionByName(again)
