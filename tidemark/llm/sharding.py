"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix; DataFrame functions only."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one local permutation, and the most partitions; the matrix has at most MAX_PARTITIONS x shards numbers.
ROWS_PER_PARTITION, MAX_PARTITIONS = 50_000, 8192
#: Rows whose shard counts are drawn jointly; more are dealt in rounds of this many, each filling the shards evenly.
ROUND_ROWS = 500_000_000


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """How many rows each partition sends to each shard, as if all rows had been permuted and cut into equal shards.

    Row sums are ``counts``; column sums differ by one at most. Each row is a multivariate hypergeometric draw from
    the room that is left.
    """
    rng = np.random.default_rng(seed)
    extra = rng.permutation(shards)  # which shards are filled up first
    quota = lambda n: (n + extra) // shards
    out, done, at = [], 0, 0
    while at < len(counts):
        size, stop = 0, at
        while stop < len(counts) and (stop == at or size + counts[stop] <= ROUND_ROWS):
            size, stop = size + counts[stop], stop + 1
        room = quota(done + size) - quota(done)
        for n in counts[at:stop]:
            drawn = rng.multivariate_hypergeometric(room, n, method="marginals")
            room = room - drawn
            out.append(drawn.tolist())
        done, at = done + size, stop
    return out


def shard_uniformly(df: DataFrame, key: list[Column], shards: int = 8, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``df`` plus (shard, slot): shard counts differ by one at most, slots of a shard run from 0 without gaps.

    Rows are placed by hashes of ``key``, so a lost task is redone alike. Rows with the same key are interchangeable.
    Partition p sends its rows, in hash order, to the shards by row p of the matrix; each shard then orders what
    it got by another hash, in sub-buckets whose offsets come from their counts: no task holds a shard.
    """
    spark = df.sparkSession
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *key)
    if partitions is None:
        partitions = min(MAX_PARTITIONS, max(shards, math.ceil(df.select(F.lit(1)).count() / ROWS_PER_PARTITION)))
    placed = df.withColumn("_part", F.pmod(draw(1), F.lit(partitions)).cast("int"))
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    matrix = communication_matrix([sizes.get(p, 0) for p in range(partitions)], shards, seed)
    ends = json.dumps(np.cumsum(matrix, axis=1).tolist())
    table = spark.range(1).select(F.posexplode(F.from_json(F.lit(ends), "array<array<bigint>>")).alias("_p", "_ends"))
    turn = F.row_number().over(Window.partitionBy("_part").orderBy(draw(2)))
    sent = placed.withColumn("_turn", turn).join(F.broadcast(table), F.col("_part") == F.col("_p"))
    sent = sent.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_turn"))).cast("int")).drop("_part", "_p", "_ends", "_turn")
    sent = sent.withColumn("_bucket", F.pmod(draw(3), F.lit(partitions)).cast("int"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy(F.col("shard").alias("_s"), F.col("_bucket").alias("_b")).count()
    offsets = offsets.select("_s", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(draw(4)))
    out = sent.join(F.broadcast(offsets), (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return out.withColumn("slot", F.col("_offset") + place - 1).drop("_bucket", "_s", "_b", "_offset")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs`` under the law ``rows``.

    size is the text's UTF-8 bytes plus 1; a null text has none and checksum 0. Null and repeated ids are rows like
    others; equal rows are interchangeable. An empty table gives no row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias(id_col), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law")
    )
    placed = shard_uniformly(rows, [F.col(id_col), F.col("size"), F.col("text_crc32")], shards, seed)
    return placed.select(id_col, "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, key: list[Column], shards: int = 8, seed: int = 42, rows_per_file: int = 1_000_000) -> None:
    """Write whole rows to ``path``/shard=N, each file in slot order."""
    placed = shard_uniformly(df, key, shards, seed).withColumn("_file", F.floor(F.col("slot") / rows_per_file))
    placed.repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)
