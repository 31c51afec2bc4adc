"""Readers, writers and lineage of the tables between stages (survey A1-A9, A13-A14, B15)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.splits import LINK_RULES, MOVIE_RULES, RATING_RULES, TAG_RULES, drop_orphans, expectations, require_unique
from tidemark.plans.views import clean_movies, clean_tags, no_tag

SCHEMAS = {
    "ratings": "userId long, movieId long, rating double, timestamp long",
    "movies": "movieId long, title string, genres string",
    "tags": "userId long, movieId long, tag string, timestamp long",
    "links": "movieId long, imdbId string, tmdbId string",
}
NAMES = {"userId": "user_id", "movieId": "item_id", "timestamp": "ts", "imdbId": "imdb_id", "tmdbId": "tmdb_id"}


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A raw table with its declared schema and our column names; a malformed row raises when it is read."""
    raw = spark.read.csv(path, schema=SCHEMAS[table], header=True, quote='"', escape='"', mode="FAILFAST")
    return raw.withColumnsRenamed({k: v for k, v in NAMES.items() if k in raw.columns})


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "ratings")


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    return clean_movies(read_csv(spark, path, "movies"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return clean_tags(read_csv(spark, path, "tags"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, "links")
    return raw.select("item_id", F.col("imdb_id").try_cast("bigint").alias("imdb_id"), F.col("tmdb_id").try_cast("bigint").alias("tmdb_id"))


def write_table(df: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet that appears whole or not at all: written beside the path and renamed; ``files=1`` for tables known to be small.

    The old table is renamed aside until the new one is in place, and put back if that fails; a crash between the two
    renames leaves it beside the path, under a name that ends in ``.old``.
    """
    spark = df.sparkSession
    beside = f"{path}.part-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(beside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{beside}.old"
    if there := fs.exists(hadoop(path)):
        if not fs.rename(hadoop(path), hadoop(old)):
            raise OSError(f"cannot move {path} aside")
    if not fs.rename(hadoop(beside), hadoop(path)):
        if there:
            fs.rename(hadoop(old), hadoop(path))
        raise OSError(f"cannot move {beside} to {path}")
    fs.delete(hadoop(old), True)


def write_ordered(df: DataFrame, path: str, keys: list[str], in_ranges: bool = False) -> None:
    """Files hold ranges of the first key, rows in order within. ``in_ranges`` says that the partitions of ``df`` do already."""
    (df if in_ranges else df.repartitionByRange(keys[0])).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


#: What each table must hold; user ids start at 0 in tags as in ratings.
INGEST_RULES = {"ratings": RATING_RULES, "movies": MOVIE_RULES, "tags": {**TAG_RULES, "user_id": RATING_RULES["user_id"]}, "links": LINK_RULES}
UNIQUE = {"ratings": ["user_id", "item_id"], "movies": ["item_id"], "links": ["item_id"]}


def ingest(spark: SparkSession, raw: str, out: str, rules: dict[str, dict[str, str]] = INGEST_RULES) -> DataFrame:
    """Read the four raw tables, check them, drop orphans and empty tags, write them, and return the audit (table, reason, dropped).

    Nothing is written unless all four keep their rules and unique keys.
    """
    read = {"ratings": read_ratings, "movies": read_movies, "tags": read_tags, "links": read_links}
    tables = {name: f(spark, f"{raw}/{name}.csv") for name, f in read.items()}
    for name, df in tables.items():
        bad = expectations(df, rules.get(name, {})).where("violations > 0").collect() if rules.get(name) else []
        if bad:
            raise ValueError(f"{name} break {[tuple(r) for r in bad]}")
        if name in UNIQUE:
            require_unique(df, UNIQUE[name])
    empty = read_csv(spark, f"{raw}/tags.csv", "tags").agg(F.lit("tags").alias("table"), F.lit("empty").alias("reason"), F.count_if(no_tag(F.col("tag"))).alias("dropped"))
    ratings, tags, orphans = drop_orphans(tables["ratings"], tables["tags"], tables["movies"])
    for name, df in (tables | {"ratings": ratings, "tags": tags}).items():
        write_table(df, f"{out}/{name}.parquet")
    return orphans.select("table", F.lit("unknown item").alias("reason"), "dropped").unionByName(empty)


FINGERPRINT = T.StructType().add("name", "string").add("length", "long").add("sha256", "string")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, sha256) of the data files below a path; names are paths from there. Files are hashed where Spark reads them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", r"^.*?" + re.escape(path.rstrip("/").split("/")[-1]) + r"/?", "")
    last = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(~last.startswith("_") & ~last.startswith(".")).select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def manifest(files: DataFrame, stage: str, config: dict[str, str], seed: int) -> DataFrame:
    """One lineage row: the digest of all files, whatever their order."""
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256)
    return files.agg(F.count("*").alias("n_files"), digest.alias("digest")).withColumns({"stage": F.lit(stage), "seed": F.lit(seed), "config": F.to_json(F.create_map(*[F.lit(str(x)) for kv in sorted(config.items()) for x in kv])) if config else F.lit("{}")})


def verify_files(now: DataFrame, recorded: DataFrame) -> None:
    """Raise if a recorded file is missing or differs, or a new one is there."""
    if wrong := changed_files(now, recorded).limit(5).collect():
        raise ValueError(f"outputs changed: {[tuple(r) for r in wrong]}")


def changed_files(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """(name, problem) of files that are missing, new or different."""
    a, b = now.select("name", F.col("sha256").alias("now")), recorded.select("name", F.col("sha256").alias("recorded"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("recorded").isNull(), "new").when(F.col("now") != F.col("recorded"), "different")
    return a.join(b, "name", "full_outer").select("name", problem.alias("problem")).where(F.col("problem").isNotNull())
