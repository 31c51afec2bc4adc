"""Recommender-shaped views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import genre_list, strip, title_year

GENRES = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (user, item): its first purchase, read as a rating."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first = Window.partitionBy("o_custkey", "l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("rn", F.row_number().over(first)).where("rn = 1")
    ts = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    return rows.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (F.ceil(F.col("l_quantity") / 5) / 2).cast("double").alias("rating"), ts.alias("ts"))


RATINGS_SQL = """ratings AS (SELECT user_id, item_id, rating, ts FROM (SELECT o_custkey AS user_id, l_partkey AS item_id,
  CAST(ceil(l_quantity / 5) / 2 AS double) AS rating, CAST(epoch(l_shipdate) AS bigint) AS ts,
  row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) q WHERE rn = 1)"""


def movies_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    title = F.when(key % 100 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ("), (1930 + key % 90).cast("string"), F.lit(")")))
    genres = F.when(key % 50 == 0, "(no genres listed)").otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("|")))
    return table(spark, sf_dir, "part").select(key.alias("item_id"), F.concat(F.lit("  "), title, F.lit(" ")).alias("title"), genres.alias("genres"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_movies(movies_raw(spark, sf_dir))


def clean_movies(raw: DataFrame) -> DataFrame:
    """(item_id, title, year, genres) from raw titles and genre strings."""
    title = strip(F.col("title"))
    return raw.select("item_id", title.alias("title"), title_year(title).alias("year"), genre_list(F.col("genres")).alias("genres"))


MOVIES_SQL = """movies AS (SELECT p_partkey AS item_id, p_name || CASE WHEN p_partkey % 100 = 0 THEN '' ELSE ' (' || CAST(1930 + p_partkey % 90 AS varchar) || ')' END AS title,
  CASE WHEN p_partkey % 100 = 0 THEN NULL ELSE CAST(1930 + p_partkey % 90 AS bigint) END AS year,
  CASE WHEN p_partkey % 50 = 0 THEN CAST([] AS varchar[]) ELSE string_split(p_name, ' ') END AS genres FROM part)"""


def tags_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_type")
    rows = ratings(spark, sf_dir).where("item_id % 7 = user_id % 7").join(types, "item_id")
    blank = F.when(F.col("item_id") % 11 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), "p_type", F.lit(" ")))
    return rows.select("user_id", "item_id", blank.alias("tag"), "ts")


def clean_tags(raw: DataFrame) -> DataFrame:
    """Tags stripped and lower-cased; null and empty ones go."""
    return raw.where(~no_tag(F.col("tag"))).withColumn("tag", F.lower(strip(F.col("tag"))))


def no_tag(tag: Column) -> Column:
    return F.coalesce(strip(tag), F.lit("")) == ""


TAGS_SQL = """tags AS (SELECT user_id, item_id, lower(trim(p_type)) AS tag, ts FROM ratings JOIN part ON item_id = p_partkey
  WHERE item_id % 7 = user_id % 7 AND item_id % 11 <> 0 AND trim(p_type) <> '')"""


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating, ts) of the events table, in seconds."""
    rating = F.least(F.lit(5.0), F.greatest(F.lit(0.5), F.round(F.col("value") / 10 * 2) / 2))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), rating.alias("rating"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))


EVENTS_SQL = """stream AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS bigint) AS item_id,
  least(5.0, greatest(0.5, CAST(round(value / 10 * 2) / 2 AS double))) AS rating, CAST(floor(epoch(ts)) AS bigint) AS ts FROM events)"""
