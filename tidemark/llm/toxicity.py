"""Toxicity: a weighted lexicon learned from labels, matched by Aho-Corasick over folded texts."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, cut, least_hashed

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = dict(zip("абвгеёкморстухіјѕԁԛԝһɡıοαενρτυχικβ", "abbreekmopctyxijsdqwhgioaevptuxikb", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SIGNS = {"@": "a", "$": "s", "!": "i"}


def _fold_table() -> dict[int, str]:
    """Lower case without accents for Latin letters and full-width forms, by Unicode's decompositions, plus LOOKALIKES."""
    table = {}
    for code in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x530), *range(0xFF01, 0xFF5F)]:
        low = unicodedata.normalize("NFKD", chr(code)).lower()
        table[code] = "".join(LOOKALIKES.get(c, c) for c in low if not unicodedata.combining(c))
    return table | {ord(c): x for c, x in LOOKALIKES.items()} | {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


FOLD = _fold_table()
LEET_WORD = re.compile(r"(?=\w*[^\W\d])(?=\w*\d)\w+")
INNER_SIGN = re.compile(r"(?<=[^\W\d_])[@$!]+(?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")
_DIGIT_TABLE = {ord(d): x for d, x in DIGITS.items()}


def fold(text: str) -> list[str]:
    """Words of a text: lower case, accents and lookalikes folded, digits and signs inside words read as letters."""
    text = text.lower() if text.isascii() else text.translate(FOLD).lower()
    if "@" in text or "$" in text or "!" in text:
        text = INNER_SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    words = WORD.findall(text)
    return [w.translate(_DIGIT_TABLE) if not w.isalpha() and LEET_WORD.fullmatch(w) else w for w in words]


@dataclass
class ToxicityModel:
    """Terms are whole words (' word ') or word beginnings (' wor'); exceptions are two-word phrases."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    coefficients: tuple[float, ...] = (-3.0, 0.0, 0.0, 1.0)

    def matcher(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        for term, weight in self.weights.items():
            machine.add_word(term, (len(term), weight))
        machine.make_automaton()
        return machine

    def features(self, text: str | None, machine) -> tuple[float, float, float]:
        """Summed weight, summed weight a word, largest weight; a word counts once, by its heaviest term outside exceptions."""
        words = fold(text or "")
        if machine is None or not words:
            return 0.0, 0.0, 0.0
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in machine.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight:
                hits[start] = max(weight, hits.get(start, 0.0))
            else:
                spared.append((start, end))
        if spared:
            hits = {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spared)}
        total = sum(hits.values())
        return math.log1p(total), math.log1p(100 * total / (len(words) + 20)), max(hits.values(), default=0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, *w = self.coefficients
        return 1 / (1 + np.exp(-np.clip(b + x @ np.array(w), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * l2 * len(x) / 100
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def is_held_out(id_col: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text is divisible by ``folds``; never null."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _terms(words: list[str], prefixes: tuple[int, ...]) -> set[str]:
    whole = {w for w in words if 2 < len(w) <= 40}
    return {f" {w} " for w in whole} | {f" {w[:n]}" for w in whole for n in prefixes if len(w) > n}


def fit_toxicity(
    labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sample_rows: int = 20_000,
    prefixes: tuple[int, ...] = (4, 5, 6), min_docs: int = 5, min_weight: float = 2.5, max_terms: int = 20_000, exceptions: set[str] = frozenset(),
) -> ToxicityModel:
    """Learn terms, exception phrases and calibration from at most ``sample_rows`` labelled rows, by least hash of the id.

    A term's weight is the log ratio of the shares of toxic and other documents that hold it. Word beginnings stand
    in for families of inflected words. A phrase around a term is an exception if it is common in other documents
    and not in toxic ones. Rows without label are left out; no row, or one class only, gives an empty lexicon.
    """
    sample = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(label_col) > 0).cast("int").alias("y"))
    sample = cut(sample.join(least_hashed(sample.select("id").distinct(), "id", sample_rows), "id", "left_semi").select("text", "y").repartition(16))

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: dict[str, list[int]]) -> pa.RecordBatch:
            return batch(term=pa.array(seen, pa.string()), tox=pa.array([v[1] for v in seen.values()], pa.int64()), other=pa.array([v[0] for v in seen.values()], pa.int64()))

        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in ("", *_terms(fold(text or ""), prefixes)):
                    seen.setdefault(t, [0, 0])[y] += 1
                if len(seen) > 300_000:
                    yield out(seen)
                    seen = {}
        yield out(seen)

    counts = sample.mapInArrow(count_terms, "term string, tox bigint, other bigint").groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("other").alias("other"))
    counts = counts.where((F.col("tox") >= min_docs) | (F.col("term") == ""))
    total = counts.where("term = ''").first()
    if total is None or not total.tox or not total.other:
        p = (total.tox if total else 0) + 1, (total.other if total else 0) + 1
        return ToxicityModel({}, set(exceptions), (math.log(p[0] / p[1]), 0.0, 0.0, 0.0))
    weight = F.log((F.col("tox") + 0.5) / (total.tox + 1)) - F.log((F.col("other") + 0.5) / (total.other + 1))
    best = counts.where("term <> ''").select("term", weight.alias("w")).where(F.col("w") >= min_weight).orderBy(F.desc("w"), "term").limit(max_terms).collect()
    weights = {r.term: r.w for r in best}
    model = ToxicityModel(weights, set(exceptions))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ToxicityModel(weights).matcher()
        for b in batches:
            phrases: dict[str, list[int]] = {}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = fold(text or "")
                line = f" {' '.join(words)} "
                found = set()
                for end, (length, _) in machine.iter(line) if machine and words else ():
                    at = line.count(" ", 0, end - length + 2) - 1
                    found |= {" ".join(words[at - 1 : at + 1])} if at else set()
                    found |= {" ".join(words[at : at + 2])} if at + 1 < len(words) else set()
                for p in found:
                    phrases.setdefault(p, [0, 0])[y] += 1
            yield batch(term=pa.array(phrases, pa.string()), tox=pa.array([v[1] for v in phrases.values()], pa.int64()), other=pa.array([v[0] for v in phrases.values()], pa.int64()))

    if weights:
        phrases = sample.mapInArrow(look, "term string, tox bigint, other bigint").groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("other").alias("other"))
        safe = phrases.where(F.col("other") >= F.greatest(F.lit(min_docs), 4 * F.col("tox"))).orderBy(F.desc("other"), "term").limit(max_terms)
        model.exceptions |= {r.term for r in safe.collect()}

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.matcher()
        for b in batches:
            x = [model.features(t, machine) for t in b.column(0).to_pylist()]
            yield batch(y=b.column(1).cast(pa.int64()), **{f"x{i}": pa.array([r[i] for r in x], pa.float64()) for i in range(3)})

    rows = sample.mapInArrow(featurise, "y bigint, x0 double, x1 double, x2 double").toPandas()
    model.coefficients = tuple(logistic(rows[["x0", "x1", "x2"]].to_numpy(), rows["y"].to_numpy()).tolist())
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, score, predicted, n_words). Null and empty texts get the score of no match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.matcher()
        for b in batches:
            x = np.array([model.features(t, machine) for t in b.column(1).to_pylist()]).reshape(-1, 3)
            p = model.score(x)
            yield batch(id=b.column(0), score=p, predicted=(p >= 0.5).astype(np.int32))

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return found.select(F.col("id").alias(id_col), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, sample_rows: int = 20_000) -> DataFrame:
    """Fit on at most ``sample_rows`` labelled ids outside the held-out fold, those of least hash, then score every document.

    Returns (id_col, held_out, score, predicted). Several labels of an id count as toxic if any is. A null id isn't held out.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~is_held_out(id_col, folds)).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    train = docs.select(id_col, text_col).join(least_hashed(known, id_col, sample_rows), id_col).withColumnRenamed("_y", label_col)
    model = fit_toxicity(train, text_col, label_col, id_col, sample_rows)
    return score_toxicity(docs, model, id_col, text_col).select(id_col, is_held_out(id_col, folds).alias("held_out"), "score", "predicted")
