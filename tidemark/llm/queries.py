"""Queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.alignment import Tokenizers, alignment
from tidemark.llm.common import least_hashed
from tidemark.llm.html_text import main_text
from tidemark.llm.lexical import lexical_search
from tidemark.llm.lines import WHOLE, line_dedup
from tidemark.llm.mixing import mixing_rates
from tidemark.llm.quality import quality_scores
from tidemark.llm.sentencepieces import Pieces, encode
from tidemark.llm.sharding import shard_documents
from tidemark.llm.simhash import simhash_groups
from tidemark.llm.toxicity import toxicity
from tidemark.llm.vectors import near_duplicate_vectors, nearest_neighbours
from tidemark.llm.warc import archived

#: Where the public piece table lies; set TIDEMARK_PIECES for another place.
PIECES = os.environ.get("TIDEMARK_PIECES", "file:///opt/tokenizers/piece_bpe_32k.model")

#: The tokenizers to align: the byte-level one.
BYTE_LEVEL = os.environ.get("TIDEMARK_BYTE_LEVEL", "file:///opt/tokenizers/byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_languages(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """Documents of at most ``rows`` ids that the labels table covers, those of least hash; their language is the domain."""
    return docs.join(least_hashed(labels.select("doc_id").distinct(), "doc_id", rows), "doc_id", "left_semi")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"), **WHOLE)
    return found.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = {"_p_doc": "p_document", "_host_post": "p_host", "_path_post": "p_path", "_quality": "score", "_keep": "keep"}
    return scored.select("doc_id", "source", "lang", *[F.col(a).alias(b) for a, b in names.items()])


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, Pieces.load(spark, PIECES)).select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", "round_trip")


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan = mixing_rates(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), "lang")
    return plan.withColumnRenamed("id", "doc_id").drop("digest")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment(table(spark, sf_dir, "documents"), Tokenizers.load(spark, BYTE_LEVEL, PIECES), keep=["doc_id"])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_html_text, op3_line_dedup, op4_quality, op5_nearest_neighbours,
        op6_sharding, op7_sentencepiece, op8_vector_dedup, op9_toxicity, op10_mixing, op11_token_alignment,
        op12_lexical_search, op13_warc,
    )
}

TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The first ten and the alignment can't be said in SQL of another engine; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op12_lexical_search": f"""WITH d AS (SELECT doc_id, {TERMS_SQL} AS t FROM documents), n AS (SELECT doc_id, CAST(len(t) AS bigint) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS bigint) AS terms FROM n), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) u GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS double))) AS bigint) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) f, s),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark) u GROUP BY ALL),
scores AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS bigint) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), s GROUP BY ALL)
SELECT item_id, CAST(rank AS integer) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) r WHERE rank <= 20""",
    "op13_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS held FROM p)
SELECT page_id, CAST(strlen(html) AS bigint) AS payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS integer) >> (15 - 5 * (i % 4))) & 31), 1) for i in range(32)], '') AS payload_digest,
 CASE WHEN page_id = held THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> held THEN held END AS refers_to FROM m""",
}
