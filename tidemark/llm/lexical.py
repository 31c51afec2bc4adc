"""Ranked lexical search: the best documents of each item by weighted terms, found through groups of equal presence masks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batch, cut, texts_as_bytes

#: A-Z to a-z; digits, letters and all bytes beyond ASCII as they are; any other byte separates terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SLICE_BYTES = 1 << 21


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and characters beyond ASCII, A-Z as a-z."""
    return text.translate(TERMS).split() if text else []


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, the places of their distinct terms in ``vocabulary`` and how often each has them."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        terms, times = [], []
        for _, text in rows:
            places = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text.encode() if text else None)], np.int64)
            found = np.unique(places, return_counts=True)
            terms.append(found[0])
            times.append(found[1])
        return cls([i for i, _ in rows], vocabulary, terms, times)


def term_table(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: n counts all its terms, the lists hold those of the items, by place."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = shared.value.get, max(len(shared.value), 1)
        for rows in batches:
            texts = texts_as_bytes(rows.column(1))
            start = 0
            while start < len(texts):
                held, stop = 0, start
                while stop < len(texts) and (stop == start or held < SLICE_BYTES):
                    held += len(texts[stop] or b"")
                    stop += 1
                found = [terms_of(t) for t in texts[start:stop]]
                n = np.array([len(f) for f in found], np.int64)
                flat = list(chain.from_iterable(found))
                places = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
                keys, tfs = np.unique((np.repeat(np.arange(len(n)), n) * size + places)[places >= 0], return_counts=True)
                any_ = np.flatnonzero(n)
                offsets = np.searchsorted(keys, np.r_[any_, len(n)] * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (keys % size, tfs)]
                yield batch(id=rows.column(0).slice(start, stop - start).take(pa.array(any_)), n=pa.array(n[any_]), terms=lists[0], tfs=lists[1])
                start = stop

    chosen = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(count, "id bigint, n bigint, terms array<int>, tfs array<int>")


def masks_of(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a bitmap a term (terms x documents, booleans): the distinct masks of terms (masks x terms) and, ordered by
    mask, the documents and where each mask's begin. A document's mask is its column of the bitmaps, packed into words."""
    packed = np.packbits(present, axis=0)
    words = np.zeros((present.shape[1], -(-max(len(packed), 1) // 8) * 8), np.uint8)
    words[:, : len(packed)] = packed.T
    words = words.view(np.uint64)
    order = np.argsort(words[:, 0], kind="stable") if words.shape[1] == 1 else np.lexsort(words.T)
    ordered = words[order]
    starts = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)])
    return present[:, order[starts]].T, order, starts


class Best:
    """The k best documents of an item so far: largest score, ties to the smaller id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a document has to reach to be among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        enough = score >= self.least
        score, ids, null = (np.r_[a, b[enough]] for a, b in ((self.score, score), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def search_block(best: Best, terms: np.ndarray, worth: np.ndarray, postings: tuple[np.ndarray, ...], ids: np.ndarray, null: np.ndarray, group: int = 256) -> int:
    """Add a block's documents to the best of an item; returns how many were scored.

    The item's ``terms`` have ``worth`` (weight times repeats). ``postings`` are, by term: where its documents begin,
    its documents, and what one occurrence is worth there, the share of its weight that tf and length give. Documents of
    one mask of terms can reach the sum of worth times each term's largest share. Masks are taken from the highest such
    sum down, and the rest is left out once it is below the k-th best score.
    """
    begin, where, share, most = postings
    spans = [slice(begin[t], begin[t + 1]) for t in terms.tolist()]
    shares = np.zeros((len(terms), len(ids)), np.int64)
    present = np.zeros((len(terms), len(ids)), bool)
    for k, s in enumerate(spans):
        shares[k, where[s]] = share[s]
        present[k, where[s]] = True
    masks, order, starts = masks_of(present)
    reach = masks @ (worth * most[terms])
    ends, by_reach = np.r_[starts[1:], len(order)], np.argsort(-reach, kind="stable")
    sizes = (ends - starts)[by_reach]
    upto, scored, at = np.cumsum(sizes), 0, 0
    while at < len(by_reach) and reach[by_reach[at]] >= best.least:
        stop = max(at + 1, int(np.searchsorted(upto, scored + group)))
        chosen, n = by_reach[at:stop], sizes[at:stop]
        docs = order[np.repeat(starts[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        best.add(worth @ shares[:, docs], ids[docs], null[docs])
        scored, at = scored + len(docs), stop
    return scored


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = 4 << 20, block: int = 8192) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, ties to the smaller id, null ids last.

    N documents have a term and L terms in all; a document's m is 75 + 25 n N div L with its n terms; a term that df of
    them hold weighs floor(1000 ln((2 N + 2) / (2 df + 1))), and gives weight times (10^9 tf div (1000 tf + 12 m)).
    All rows of ``docs`` count, repeated ones each; a null or empty text has no terms. Items equal in id and text are
    ranked once; two texts of one id are ranked apart; an item without terms has no rows, nor has an empty table.
    Other columns are not read. Items are taken in blocks of about ``item_bytes``; each task of a block holds the
    items' postings in ``block`` documents at once and sends on its k best of each item.
    """
    spark = docs.sparkSession
    asked = cut(items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text")).distinct())
    n_blocks = 1 + (asked.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0] // item_bytes)
    found = None
    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b)  # about item_bytes
        mine = Items.of([(r.item, r.text) for r in part.collect()])
        table = cut(term_table(docs, mine, id_col, text_col))
        n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = table.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # as many as the block has terms
        weights = np.zeros(len(mine.vocabulary), np.int64)
        for r in held:
            weights[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
        shared = spark.sparkContext.broadcast((mine.ids, mine.terms, [weights[t] * n for t, n in zip(mine.terms, mine.times, strict=True)], len(weights)))
        best = table.mapInArrow(lambda batches, s=shared, n=n_docs, all_=n_terms: _search(batches, s.value, n, all_, k, block), "item int, item_id bigint, doc_id bigint, score bigint")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        ranked = best.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found = ranked if found is None else found.unionByName(ranked)
    return found


def _search(batches: Iterator[pa.RecordBatch], items: tuple, n_docs: int, n_terms: int, k: int, block: int) -> Iterator[pa.RecordBatch]:
    item_ids, terms, worth, n_vocabulary = items
    best = [Best(k) for _ in item_ids]

    def blocks() -> Iterator[pa.Table]:
        held, n = [], 0
        for rows in batches:
            for at in range(0, rows.num_rows, block):
                held.append(rows.slice(at, block))
                n += held[-1].num_rows
                if n >= block:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    for rows in blocks():
        rows = rows.combine_chunks()
        ids, null = rows["id"].fill_null(0).to_numpy(), rows["id"].is_null().to_numpy(zero_copy_only=False)
        m = 75 + (25 * rows["n"].to_numpy() * n_docs) // n_terms
        lists = rows["terms"].combine_chunks()
        doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        share = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        begin = np.searchsorted(term, np.arange(n_vocabulary + 1))
        most = np.zeros(n_vocabulary, np.int64)
        np.maximum.at(most, term, share)
        for b, t, w in zip(best, terms, worth, strict=True):
            here = begin[t] < begin[t + 1]
            if here.any():
                search_block(b, t[here], w[here], (begin, doc, share, most), ids, null)
    for i, b in enumerate(best):
        if len(b.score):
            yield batch(item=pa.array(np.full(len(b.score), i, np.int32)), item_id=pa.array([item_ids[i]] * len(b.score), pa.int64()), doc_id=pa.array(b.ids, mask=b.null), score=pa.array(b.score))
