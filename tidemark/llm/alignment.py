"""Alignment of the tokens of two tokenizers by the bytes that they cover, and how often token pairs meet over a corpus."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain, pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batch, cut
from tidemark.llm.sentencepieces import SPACE

#: Longest word kept in memory, and the number of words; a word longer than ``LONG`` is aligned by itself.
WORD_CHARS, WORDS, LONG = 64, 400_000, 256
UNKNOWN = -2
#: Fixed value: how byte-level tokenizers of the usual kind split a text before they merge bytes.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of more than one in so many of all links count as frequent. There are fewer of them than this number, whatever the corpus.
FREQUENT = 500_000
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Cut(NamedTuple):
    """How many tokens of A and of B lie before the end of each group, and the places of A and B tokens that overlap."""

    after_a: np.ndarray
    after_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def cut_one(ends_a: list[int], ends_b: list[int]) -> Cut:
    """Groups and links of one text from the byte offsets where its tokens end.

    Both lists rise and have the same last offset; they are cut wherever an offset is in both. At a shift j - i the
    lists are compared in stretches of 1, 2, 4, ... tokens, so long stretches of one token to one are jumped over; the
    stretch that fails is halved until it is found where the lists part. That group is walked through token by token,
    and the shift behind it is the next one.
    """
    i = j = 0
    n, m = len(ends_a), len(ends_b)
    after_a, after_b, link_a, link_b = [], [], [], []
    while i < n and j < m:
        step, growing = 1, True
        while step:
            if i + step <= n and j + step <= m and ends_a[i : i + step] == ends_b[j : j + step]:
                after_a += range(i + 1, i + step + 1)
                after_b += range(j + 1, j + step + 1)
                link_a += range(i, i + step)
                link_b += range(j, j + step)
                i += step
                j += step
                step = 2 * step if growing else step // 2
            else:
                growing = False
                step //= 2
        while i < n and j < m:
            link_a.append(i)
            link_b.append(j)
            a, b = ends_a[i], ends_b[j]
            i += a <= b
            j += b <= a
            if a == b:
                after_a.append(i)
                after_b.append(j)
                break
    return Cut(*(np.array(x, np.int64) for x in (after_a, after_b, link_a, link_b)))


def cut_many(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> Cut:
    """``cut_one`` for many texts side by side: tokens of text w are those from ``first[w]`` to ``first[w + 1]``, places count over all texts.

    In each round every text that isn't done compares a stretch at its own shift, twice as long as its last; where that
    fails, the text jumps to the failing token, walks through the group there, and begins anew at its new shift.
    """
    i, j, stop_a, stop_b = first_a[:-1].copy(), first_b[:-1].copy(), first_a[1:], first_b[1:]
    width = np.ones(len(i), np.int64)
    active = np.flatnonzero((i < stop_a) & (j < stop_b))
    cut_a, cut_b, link_a, link_b = [], [], [], []
    while len(active):
        at_a, at_b = i[active], j[active]
        w = np.minimum(width[active], np.minimum(stop_a[active] - at_a, stop_b[active] - at_b))
        text = np.repeat(np.arange(len(active)), w)
        off = np.arange(len(text)) - np.repeat(np.cumsum(w) - w, w)
        one, other = at_a[text] + off, at_b[text] + off
        parted = np.flatnonzero(ends_a[one] != ends_b[other])
        run = w.copy()
        np.minimum.at(run, text[parted], off[parted])
        jumped = off < run[text]
        link_a.append(one[jumped])
        link_b.append(other[jumped])
        cut_a.append(one[jumped] + 1)
        cut_b.append(other[jumped] + 1)
        at_a, at_b = at_a + run, at_b + run
        whole = run == w
        width[active] = np.where(whole, 2 * w, 1)
        walk = np.flatnonzero(~whole)
        while len(walk):
            x, y = at_a[walk], at_b[walk]
            link_a.append(x)
            link_b.append(y)
            a, b = ends_a[x], ends_b[y]
            at_a[walk] += a <= b
            at_b[walk] += b <= a
            done = walk[a == b]
            cut_a.append(at_a[done])
            cut_b.append(at_b[done])
            walk = walk[a != b]
        i[active], j[active] = at_a, at_b
        active = active[(at_a < stop_a[active]) & (at_b < stop_b[active])]
    none = [np.zeros(0, np.int64)]
    cut_a, cut_b, link_a, link_b = (np.concatenate(none + x) for x in (cut_a, cut_b, link_a, link_b))
    groups, links = np.argsort(cut_a), np.argsort(link_a + link_b)  # both rise along all texts
    return Cut(cut_a[groups], cut_b[groups], link_a[links], link_b[links])


@dataclass(frozen=True)
class Tokenizers:
    """A byte-level tokenizer (A, a JSON file) and a sentence-piece one (B, a model file), as the contents of their files."""

    a: bytes
    b: bytes

    @classmethod
    def load(cls, spark: SparkSession, a: str, b: str) -> Tokenizers:
        """Read by Spark, so that the files may lie in any store. Their sizes are the vocabularies', not the data's."""
        return cls(*(bytes(spark.read.format("binaryFile").load(p).select("content").first()[0]) for p in (a, b)))


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def byte_level_encoder(content: bytes, token_bytes: list[bytes]) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of texts by a byte-level tokenizer's file, without special tokens.

    Where the file numbers its tokens in the order of its merges, and splits texts by the usual pattern, the ids are the
    ranks of another library's encoder, which is three times as fast and gives the same ids (tested).
    """
    spec = json.loads(content)
    vocabulary = spec["model"]["vocab"]
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    plain = spec.get("normalizer") is None and spec["pre_tokenizer"] == {**spec["pre_tokenizer"], "type": "ByteLevel", "add_prefix_space": False} and spec["pre_tokenizer"].get("use_regex", True)
    if plain and all(x < y for x, y in pairwise(merged)) and sorted(vocabulary.values())[256 : 256 + len(merged)] == merged:
        import tiktoken

        special = {t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        ranks = {t: i for i, t in enumerate(token_bytes) if t and i not in special}
        coder = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [coder.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer

    other = Tokenizer.from_str(content.decode())
    other.encode_special_tokens = True
    other.no_truncation()
    other.no_padding()
    return lambda texts: [e.ids for e in other.encode_batch_fast(texts, add_special_tokens=False)]


class Words(NamedTuple):
    """What some texts align to: of each n_a, n_b, n_groups, n_links and the written groups; pairs of ids of all links in order."""

    sizes: np.ndarray
    written: list[str]
    pairs: np.ndarray


class Aligner:
    """Groups and links of texts. What a word aligns to is remembered: no token of either tokenizer crosses the space before a word.

    A text is cut into words at each space that follows a character other than white space. The words of a batch that
    aren't known are encoded together and aligned side by side.
    """

    def __init__(self, tokenizers: Tokenizers, words: int = WORDS):
        import sentencepiece

        self.coder_b = sentencepiece.SentencePieceProcessor(model_proto=tokenizers.b)
        byte_of, vocabulary = _byte_of(), json.loads(tokenizers.a)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte_of for c in token):
                self.bytes_a[i] = bytes(byte_of[c] for c in token)
        self.encode_a = byte_level_encoder(tokenizers.a, self.bytes_a)
        b, size = self.coder_b, self.coder_b.get_piece_size()
        pieces = [b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        inner = [p for p in pieces if SPACE in p.lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces with a space mark inside: {inner[:3]}")
        self.size_a, self.size_b = (np.array([len(x) for x in y]) for y in (self.bytes_a, self.bytes_b))
        ids_a, ids_b = (list(map(str, range(len(x)))) for x in (self.bytes_a, self.bytes_b))
        #: Ids as written inside a group and at its end, A before B.
        self.signs = [*[i + "," for i in ids_a], *[i + "|" for i in ids_a], *[i + "," for i in ids_b], *[i + ";" for i in ids_b]]
        self.words = words
        self._forget()

    def _forget(self) -> None:
        #: word -> its place below; -1 for a word whose tokens don't give its bytes.
        self.place: dict[str, int] = {}
        self.written: list[str] = []
        self.sizes, self.pairs, self.first = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def align(self, words: list[str]) -> tuple[Words, list[bool]]:
        """What words align to, a space put before each, and which of them have tokens that give their bytes; the others align to nothing."""
        ids_a = self.encode_a([" " + w for w in words])
        ids_b = self.coder_b.encode(words, num_threads=1)
        whole = [b" " + w.encode() for w in words]
        good = self._give_back(whole, ids_a, ids_b)
        for k in [k for k, ok in enumerate(good) if not ok]:
            ids_a[k], ids_b[k] = [], []
        first_a, first_b = (np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64) for ids in (ids_a, ids_b))
        a, b = (np.array(list(chain.from_iterable(ids)), np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        if len(words) == 1:
            found = cut_one(ends_a.tolist(), ends_b.tolist())
        else:
            found = cut_many(ends_a, ends_b, first_a, first_b)
        return self._gathered(found, a, b, first_a, first_b), good

    def _give_back(self, whole: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[bool]:
        """Which words are the bytes of their tokens, by both tokenizers: all at once, and one by one where any isn't."""
        good = [True] * len(whole)
        joined, ends = b"".join(whole), np.cumsum([len(w) for w in whole])
        for ids, texts, sizes in ((ids_a, self.bytes_a, self.size_a), (ids_b, self.bytes_b, self.size_b)):
            flat, n = list(chain.from_iterable(ids)), np.cumsum([len(x) for x in ids])
            until = np.r_[0, np.cumsum(sizes[flat])][n] if flat else np.zeros(len(ids), np.int64)
            if (until != ends).any() or b"".join([texts[i] for i in flat]) != joined:
                good = [g and b"".join([texts[i] for i in x]) == w for g, x, w in zip(good, ids, whole, strict=True)]
        return good

    def _gathered(self, found: Cut, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> Words:
        groups, links = np.searchsorted(found.after_a, first_a, "right"), np.searchsorted(found.link_a, first_a)
        sizes = np.stack([np.diff(x) for x in (first_a, first_b, groups, links)], axis=1)
        # In writing, A tokens stand behind the B tokens of all groups before theirs, B tokens behind the A tokens of theirs.
        mine_a, mine_b = (np.searchsorted(x, np.arange(len(y)), "right") for x, y in ((found.after_a, a), (found.after_b, b)))
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        signs = np.zeros(len(a) + len(b), np.int64)
        last_a, last_b = (np.isin(np.arange(1, len(y) + 1), x) for x, y in ((found.after_a, a), (found.after_b, b)))
        signs[np.arange(len(a)) + np.r_[0, found.after_b][mine_a]] = a + np.where(last_a, n_a, 0)
        if len(b):
            signs[np.arange(len(b)) + found.after_a[mine_b]] = b + 2 * n_a + np.where(last_b, n_b, 0)
        marks = [self.signs[s] for s in signs.tolist()]
        at = (first_a + first_b).tolist()
        written = ["".join(marks[s:e]) for s, e in pairwise(at)]  # each ends in a sign that the last of a text loses
        return Words(sizes, written, a[found.link_a] << 32 | b[found.link_b])

    def _learn(self, words: list[str]) -> None:
        long = [w for w in words if len(w) > LONG]
        for part in ([w for w in words if len(w) <= LONG], *([w] for w in long)):
            if part:
                found, good = self.align(part)
                self.place.update(zip(part, range(len(self.written), len(self.written) + len(part)), strict=True))
                self.place.update((w, -1) for w, ok in zip(part, good, strict=True) if not ok)
                self._add(found)

    def _add(self, found: Words) -> None:
        self.written += found.written
        self.sizes, self.pairs = np.concatenate([self.sizes, found.sizes]), np.concatenate([self.pairs, found.pairs])
        self.first = np.r_[0, np.cumsum(self.sizes[:, 3])]

    @staticmethod
    def split(text: str) -> list[str]:
        """Words of a text without the space in front; one that holds spaces begins or ends with white space."""
        out, open_ = [], []
        for p in text.split(" "):
            open_.append(p)
            if p and not p[-1].isspace():
                out.append(" ".join(open_))
                open_ = []
        if open_:  # spaces at the end belong to the last word
            out[-1:] = [" ".join([*out[-1:], *open_])]
        return out

    def _places(self, words: list[list[str]]) -> tuple[np.ndarray, set[str]]:
        flat = list(chain.from_iterable(words))
        places = np.fromiter(map(self.place.get, flat, repeat(UNKNOWN)), np.int64, len(flat))
        return places, {flat[k] for k in np.flatnonzero(places == UNKNOWN).tolist()}

    def rows(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its written groups (none without tokens) and n_a, n_b, n_groups, n_links; and (row, pair, times) of links, sorted, pairs distinct in a row."""
        if len(self.written) > self.words:
            self._forget()
        place = self.place
        words = [t.split(" ") if t else [] for t in texts]
        flat, unknown = self._places(words)
        unclean = {w for w in unknown if not w or w[-1].isspace()}
        if unclean:
            words = [self.split(t) if not unclean.isdisjoint(w) else w for t, w in zip(texts, words, strict=True)]
            flat, unknown = self._places(words)
        self._learn(list(unknown))
        missing = np.flatnonzero(flat == UNKNOWN)
        every = list(chain.from_iterable(words))
        flat[missing] = [place[every[k]] for k in missing.tolist()]
        row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        bad = np.unique(row[flat < 0])
        for r in bad.tolist():  # a whole text may still give its bytes; it isn't remembered as a word
            found, good = self.align([texts[r]])
            flat, row = flat[row != r], row[row != r]
            if good[0]:
                at = np.searchsorted(row, r)
                flat, row = np.insert(flat, at, len(self.written)), np.insert(row, at, r)
            self._add(found)
        ends = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        signs = [self.written[k] for k in flat.tolist()]
        written = ["".join(signs[s:e])[:-1] if s < e else None for s, e in pairwise(ends)]
        counts = np.zeros((len(texts), 4), np.int64)
        links = (np.zeros(0, np.int64),) * 3
        if len(flat):
            seen, times = np.unique(row << 32 | flat, return_counts=True)
            row, flat = seen >> 32, seen & 0xFFFFFFFF
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            counts[row[starts]] = np.add.reduceat(self.sizes[flat] * times[:, None], starts)
            n = self.sizes[flat, 3]
            where = np.repeat(self.first[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pair, row, times = self.pairs[where], np.repeat(row, n), np.repeat(times, n)
            order = np.argsort(row << 48 | pair)
            pair, row, times = pair[order], row[order], times[order]
            new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])])
            links = (row[new], pair[new], np.add.reduceat(times, new))
        for w in unknown:
            if len(w) > WORD_CHARS:
                del place[w]
        return written, counts, *links


_ALIGNERS: dict[bytes, Aligner] = {}


def _aligner(tokenizers: Tokenizers) -> Aligner:
    """The worker's aligner for these files; it keeps one, with the words it knows, from task to task."""
    key = sha256(tokenizers.a + tokenizers.b).digest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(tokenizers)
    return _ALIGNERS[key]


def _slices(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` characters; a longer text is alone."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, k
            start, size = k, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def aligned(docs: DataFrame, tokenizers: Tokenizers, text_col: str = "text", whole: bool = True, keep: list[str] | None = None, chars: int = 2_000_000) -> DataFrame:
    """``docs`` (of its columns those in ``keep``, if given) plus n_a, n_b, n_groups, n_links (longs), ``links`` and ``groups``; columns of these names are replaced.

    ``links`` has each pair of ids whose occurrences overlap, a in the upper and b in the lower 32 bits, and how many
    times it does in the text. ``groups`` is the alignment ``a1,a2|b1;a3|b2,b3`` in order, or with ``whole=False`` the
    hexadecimal SHA-256 of it; it is empty for a text without tokens. A null or empty text has none, nor has one whose
    tokens don't give back a space and its bytes. Equal rows give equal results. Texts of any length are taken whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokenizers.a, tokenizers.b))
    docs = docs.drop("n_a", "n_b", "n_groups", "n_links", "links", "groups")
    link = T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.IntegerType())])
    kept = [c for c in docs.columns if keep is None or c in keep]
    new = [*[T.StructField(c, T.LongType()) for c in COLUMNS[:4]], T.StructField("links", T.ArrayType(link)), T.StructField("groups", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _aligner(Tokenizers(*shared.value))
        for rows in batches:
            texts = rows.column(rows.schema.get_field_index(text_col)).to_pylist()
            for start, stop in _slices(texts, chars):
                written, counts, row, pair, times = coder.rows(texts[start:stop])
                offsets = np.searchsorted(row, np.arange(stop - start + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(pair), pa.array(times.astype(np.int32))], names=["pair", "times"])
                if whole:
                    groups = [w or "" for w in written]
                else:
                    groups = [sha256(w.encode()).hexdigest() if w else "" for w in written]
                made = [*[pa.array(counts[:, c]) for c in range(4)], pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(groups, pa.string())]
                part = rows.slice(start, stop - start).select(kept)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*kept, *[f.name for f in new]])

    return docs.mapInArrow(run, T.StructType([*[f for f in docs.schema.fields if f.name in kept], *new]))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each pair, and whether no other pair of its B id has more (ties are all best)."""
    counts = cut(rows.select(F.explode("links").alias("x")).groupBy("x.pair").agg(F.sum("x.times").alias("n")))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))  # a row a B id: as many as the vocabulary at most
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, tokenizers: Tokenizers, text_col: str = "text", whole: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``aligned`` plus n_best, the links whose pair is among the most frequent of its B id over all rows, and count_sum,
    the sum over links of how often their pair is linked over all rows; without ``links``.

    Pairs that hold more than one in 500,000 of all links, fewer than 500,000 whatever the corpus, go to every task; the links of all other
    pairs are joined by a shuffle, in which no key can be frequent. An empty table gives no rows; repeated rows each count.
    """
    drop = [c for c in docs.columns if c in ("_row", "n_best", "count_sum")]
    rows = cut(aligned(docs.drop(*drop), tokenizers, text_col, whole, keep).withColumn("_row", F.monotonically_increasing_id()))
    pairs = cut(pair_counts(rows))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = pairs.where(F.col("n") * FREQUENT > total)
    table = often.orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "n", "best")])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for b in batches:
            for x in (b.slice(k, 2000) for k in range(0, b.num_rows, 2000)):
                links = x.column(1)
                offsets = links.offsets.to_numpy()
                flat = links.values.slice(offsets[0], offsets[-1] - offsets[0])
                mine, times = flat.field("pair").to_numpy(), flat.field("times").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(x.num_rows), np.diff(offsets))
                at = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
                hit = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
                sums = np.zeros((2, x.num_rows), np.int64)
                np.add.at(sums[0], row[hit], times[hit] * best[at[hit]])
                np.add.at(sums[1], row[hit], times[hit] * n[at[hit]])
                rest = np.r_[0, np.cumsum(np.bincount(row[~hit], minlength=x.num_rows))].astype(np.int32)
                left = pa.StructArray.from_arrays([pa.array(mine[~hit]), pa.array(times[~hit])], names=["pair", "times"])
                yield batch(_row=x.column(0), n_best=pa.array(sums[0]), count_sum=pa.array(sums[1]), rest=pa.ListArray.from_arrays(pa.array(rest), left))

    found = rows.select("_row", "links").mapInArrow(look_up, "_row bigint, n_best bigint, count_sum bigint, rest array<struct<pair bigint, times bigint>>")
    found = cut(found)
    rare = found.select("_row", F.explode("rest").alias("x")).select("_row", "x.pair", "x.times").join(pairs, "pair")
    added = rare.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = found.select("_row", "n_best", "count_sum").unionByName(added).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("links").join(sums, "_row").drop("_row")
