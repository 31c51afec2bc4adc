"""Session features over a stream and over a table (survey A10-A12, E4, I1-I9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import POSITIVE, tie_key

WINDOW_SECONDS = 30 * 60
EVENT = "user_id bigint, item_id bigint, rating double, ts bigint"
SESSION = "user_id bigint, ts bigint, item_id bigint, session_n_events double, session_n_positive double, session_mean_rating double, session_last_item_id double, session_last_ts double"
STATE = "ts array<bigint>, item array<bigint>, rating array<double>"


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Events of a topic whose values are JSON; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return parse_events(raw.select(F.col("value").cast("string").alias("value")))


def parse_events(values: DataFrame) -> DataFrame:
    return values.select(F.from_json("value", EVENT).alias("e")).select("e.*").where("user_id is not null and ts is not null")


def replay(events: DataFrame, start: int, limit: int | None = None) -> DataFrame:
    """Events from ``start`` on in time order, those of one second by a hash of user and item; limit is a feature."""
    out = events.where(F.col("ts") >= start).withColumn("tie", tie_key(F.col("user_id"), F.col("item_id"))).orderBy("ts", "tie", "user_id", "item_id")
    return (out.limit(limit) if limit else out).drop("tie")


def to_messages(events: DataFrame) -> DataFrame:
    """(key, value, timestamp) for a keyed topic."""
    return events.select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct("user_id", "item_id", "rating", "ts")).alias("value"), F.timestamp_seconds("ts").alias("timestamp"))


def write_kafka(events: DataFrame, servers: str, topic: str) -> None:
    to_messages(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def _advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Session features after each event of a user, in order of time and item. State maps (ts, item) to a rating; an event
    behind the clock, or one that the map has, leaves it as it is."""
    window = {(t, i): r for t, i, r in zip(*state.get, strict=True)} if state.exists else {}
    clock = max((t for t, _ in window), default=None)
    frame = pd.concat(frames).sort_values(["ts", "item_id"], kind="stable")
    out = []
    for ts, item, rating in frame[["ts", "item_id", "rating"]].itertuples(index=False, name=None):
        if clock is None or ts >= clock:
            clock = ts
            window.setdefault((ts, item), rating)
            for old in [k for k in window if k[0] <= clock - WINDOW_SECONDS]:
                del window[old]
        ratings, newest = list(window.values()), max(window)
        positive = sum(r >= POSITIVE for r in ratings)
        out.append((key[0], ts, item, float(len(ratings)), float(positive), sum(ratings) / len(ratings), float(newest[1]), float(newest[0])))
    state.update(([k[0] for k in window], [k[1] for k in window], list(window.values())))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in SESSION.split(", ")])


def stream_sessions(events: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """A row of session features for each event of a stream; events of items outside the catalog are left out.

    State per user is the events of the last half hour, so it stays small however long the stream runs.
    """
    if catalog is not None:
        events = events.join(catalog.select("item_id").distinct(), "item_id", "left_semi")
    return events.select("user_id", "item_id", "rating", "ts").groupBy("user_id").applyInPandasWithState(_advance, SESSION, STATE, "append", "NoTimeout")


#: Which of two session rows of a user is the newer: of rows of one time the one that has seen most events.
NEWEST = ("session_last_ts", "ts", "session_n_events", "session_last_item_id")


def batch_sessions(events: DataFrame) -> DataFrame:
    """Session features as of each user's last event, from a table: the reference for the stream."""
    unique = events.dropDuplicates(["user_id", "ts", "item_id"])
    last = Window.partitionBy("user_id")
    inside = unique.withColumn("end", F.max("ts").over(last)).where(F.col("ts") > F.col("end") - WINDOW_SECONDS)
    newest = F.max(F.struct("ts", "item_id"))
    return inside.groupBy("user_id").agg(
        F.max("ts").alias("ts"), newest["item_id"].cast("double").alias("session_last_item_id"), newest["ts"].cast("double").alias("session_last_ts"), F.count("*").cast("double").alias("session_n_events"), F.count_if(F.col("rating") >= POSITIVE).cast("double").alias("session_n_positive"), F.avg("rating").alias("session_mean_rating"),
    )


def rolling_sessions(events: DataFrame) -> DataFrame:
    """Events plus session features as of each, events of the same second included; of those the largest item id is the last."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(-WINDOW_SECONDS + 1, 0)
    last = F.max(F.struct("ts", "item_id")).over(w)
    return events.select(
        *events.columns, F.count("*").over(w).alias("session_n_events"), F.count_if(F.col("rating") >= POSITIVE).over(w).alias("session_n_positive"),
        F.avg("rating").over(w).alias("session_mean_rating"), last["item_id"].alias("session_last_item_id"), last["ts"].alias("session_last_ts"),
    )
