"""SentencePiece encoding by an Aho-Corasick automaton that drives a single-pass Viterbi search, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batch

SPACE = "▁"
#: A word is a whole run of space marks and what follows up to the next mark; a piece of more than marks holds one only in front.
WORD = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
UNKNOWN_PENALTY = 10.0


@dataclass
class Pieces:
    """The piece table: texts with scores, and the ids of the 256 byte pieces."""

    scores: dict[str, tuple[int, float]]
    byte_ids: list[int]
    texts: list[bytes]
    add_dummy_prefix: bool = True

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Pieces:
        """Read a model file by Spark, so that it may lie in any store. Its size is the vocabulary's, not the data's."""
        import sentencepiece

        content = spark.read.format("binaryFile").load(path).select("content").first()[0]
        model = sentencepiece.SentencePieceProcessor(model_proto=bytes(content))
        scores, byte_ids, texts = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                byte_ids[value] = i
                texts.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                scores[piece] = (i, model.get_score(i))
                texts.append(piece.replace(SPACE, " ").encode())
        inner = [p for p in scores if SPACE in p[1:] and p.strip(SPACE)]
        if inner:
            raise ValueError(f"pieces with a space mark inside: {inner[:3]}")
        return cls(scores, byte_ids, texts)


class Encoder:
    """Best-scored segmentation. Words are searched one by one and remembered, since no chosen piece crosses them."""

    def __init__(self, pieces: Pieces, remembered: int = 300_000):
        self.pieces, self.remembered, self.memory = pieces, remembered, {}
        self.machine = ahocorasick.Automaton()
        for text, (i, score) in pieces.scores.items():
            self.machine.add_word(text, (len(text), i, score))
        self.machine.make_automaton()
        self.unknown = min(score for _, score in pieces.scores.values()) - UNKNOWN_PENALTY
        self.byte_text = {SPACE: [pieces.byte_ids[b] for b in SPACE.encode()]}

    def word(self, text: str) -> list[int]:
        """One pass over the text: at each position the automaton's output links give the pieces that end there.

        A position no piece reaches falls back to the bytes of its character. Of equal scores the longer last piece wins.
        """
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0  # positions up to here have their final score
        for end, (length, i, score) in self.machine.iter(text):
            end += 1
            while done < end - 1:
                done += 1
                self._fall_back(best, back, done)
            start = end - length
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, i)
        while done < n:
            done += 1
            self._fall_back(best, back, done)
        ids: list[int] = []
        while n:
            start, i = back[n]
            ids += [i] if i >= 0 else [self.pieces.byte_ids[b] for b in reversed(text[start:n].encode())]
            n = start
        return ids[::-1]

    def _fall_back(self, best: list[float], back: list[tuple[int, int]], at: int) -> None:
        if best[at - 1] + self.unknown > best[at]:
            best[at], back[at] = best[at - 1] + self.unknown, (at - 1, -1)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for a null or empty one. A space mark in the text itself is written as bytes."""
        if not text:
            return []
        if SPACE in text:
            parts = text.split(SPACE)
            out = self._marked((SPACE if self.pieces.add_dummy_prefix else "") + parts[0].replace(" ", SPACE))
            for part in parts[1:]:
                out += self.byte_text[SPACE]
                out += self._marked(part.replace(" ", SPACE))
            return out
        return self._marked((SPACE if self.pieces.add_dummy_prefix else "") + text.replace(" ", SPACE))

    def _marked(self, text: str) -> list[int]:
        out: list[int] = []
        memory = self.memory
        for word in WORD.findall(text):
            ids = memory.get(word)
            if ids is None:
                ids = self.word(word)
                if len(word) <= 64:
                    if len(memory) >= self.remembered:
                        memory.clear()
                    memory[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text whose ids these are: pieces joined, the prefix mark dropped, bytes read as UTF-8."""
        texts = self.pieces.texts
        joined = b"".join([texts[i] for i in ids])
        if self.pieces.add_dummy_prefix and joined[:1] == b" ":
            joined = joined[1:]
        return joined.decode("utf-8", "replace")


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", ids_col: str = "piece_ids", checked_col: str = "round_trip", batch_rows: int = 500) -> DataFrame:
    """``docs`` plus the ids of each whole text and whether they decode to it (true for a null text, whose ids are empty).

    A column of ``docs`` with one of the new names is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(pieces))
    docs = docs.drop(ids_col, checked_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(Pieces(**shared.value))
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                rows = whole.slice(at, batch_rows)
                texts = rows.column(rows.schema.get_field_index(text_col)).to_pylist()
                ids = [coder.encode(t) for t in texts]
                exact = [coder.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
                offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
                values = pa.array(np.concatenate([np.array(i, dtype=np.int32) for i in ids]))
                arrays = [*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(exact)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, ids_col, checked_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(checked_col, T.BooleanType())])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with a text column made from the ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vars(pieces))

    def texts(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Encoder(Pieces(**shared.value))
        for column in ids:
            yield pa.array([None if i is None else coder.decode(i) for i in column.to_pylist()], pa.string())

    return encoded.withColumn(text_col, F.arrow_udf(texts, "string")(F.col(ids_col)))
