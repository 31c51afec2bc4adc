"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BUCKET_ROWS, batch, connected_components, cut, hamming_links, texts_as_bytes

BITS = 64
CHUNK = 65_536


def covering_masks(radius: int) -> list[int]:
    """Masks such that for any ``radius`` bit positions some mask avoids them all.

    Position i gets a nonzero vector m(i) of radius + 1 bits; the mask of vector v holds the positions with an odd
    inner product of m(i) and v. ``radius`` positions give as many equations in radius + 1 unknowns, so a nonzero v
    solves them, and fingerprints that differ there only agree on all of its mask: 2^(radius + 1) - 1 tables miss no pair.
    """
    n = (1 << radius + 1) - 1
    m = [1 + i % n for i in range(BITS)]
    return [sum(((m[i] & v).bit_count() & 1) << i for i in range(BITS)) for v in range(1, n + 1)]


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """SimHash of the word shingles of a text, repeats included; a bit is set if over half of the hashes have it.

    A-Z is lower-cased, words are split at ASCII white space; a shorter text is one shingle; no word gives 0.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    line = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens])
    starts = np.r_[0, ends[:-1]]
    n = len(tokens) - words + 1
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        k = min(n, i + CHUNK)
        spans = zip(starts[i:k].tolist(), (ends[i + words - 1 : k + words - 1] - 1).tolist(), strict=True)
        hashes = np.fromiter((digest(line[s:e], 42) for s, e in spans), dtype="<u8", count=k - i)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = [fingerprint(x, words) for x in texts_as_bytes(rows.column(1))]
            yield batch(id=rows.column(0), fp=np.array(fps, dtype=np.uint64).view(np.int64))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def near_links(distinct: DataFrame, radius: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within ``radius`` bits."""
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])
    tables = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    return (
        tables.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(lambda b: hamming_links(b, radius, masks, bucket_rows), "a bigint, b bigint")
    )


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs``: (id_col, fingerprint hex, component_id).

    component_id is the smallest id whose fingerprint is reachable by steps of at most ``radius`` bits. Null and
    blank texts have fingerprint 0 and link like any other. Repeated rows stay; a null id never becomes a component
    id unless its whole group has none. Extra columns are left out. Fingerprints, not rows, are linked, so copies
    of a text cost one entry.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words))
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    found = connected_components(near_links(distinct.select("fp"), radius, bucket_rows))
    home = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = home.join(home.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group: one document of each group stays.

    Rows that repeat that id all stay, whatever their texts; ids are taken to be unique.
    Rows with a null id are one group by fingerprint like others and stay only if no other id is in it.
    """
    groups = simhash_groups(docs, id_col, text_col, radius, words)
    keep = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_keep"]), "left_semi")
