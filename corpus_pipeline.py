"""A corpus pipeline of five stages: what each decides takes effect for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.lines import WHOLE, line_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import PIECES, labelled_languages, table
from tidemark.llm.sentencepieces import Pieces, encode
from tidemark.llm.shingles import jaccard_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with repeated lines taken out of its text."""
    return line_dedup(docs, **WHOLE).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles of Jaccard similarity 0.8."""
    return jaccard_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the languages' shares of words meet the targets."""
    return mix(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), "lang")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids."""
    found = encode(docs, Pieces.load(spark, PIECES))
    return found.select("doc_id", "lang", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids", "round_trip")


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("mixing", mixture), ("sentencepiece", pieces)]

#: SQL can't express the classifier and the hashes. Tests check the stages' columns and the round trip; a brute-force version of
#: the whole pipeline is still to be written.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
