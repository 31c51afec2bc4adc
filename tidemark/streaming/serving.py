"""Serving state kept by a stream: each user's last events with gaps, and the set of items seen (survey I3-I6, I9)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from tidemark.functions.scalars import POSITIVE, tie_key
from tidemark.operators import sequences as Q
from tidemark.streaming.sink import KeyedTable

EVENT = "ts bigint, token bigint, positive int, gap int"
STATE = "user_id bigint, recent array<struct<ts:bigint,token:bigint,positive:int,gap:int>>, n_seen bigint, last_ts bigint, n_taken bigint, n_refused bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def gap_bucket_of(seconds: int | None) -> int:
    """``scalars.gap_bucket`` of one gap: 1 for the first event, else by the power of two, 32 at most."""
    return 1 if seconds is None else min(32, 1 + (seconds + 1).bit_length())


class ServingState(StatefulProcessor):
    """A user's state: the list of the last ``n`` events, the map of tokens seen, the newest time.

    An event whose token was seen, or older than the newest, changes nothing: redelivered and late events leave the state
    as it would be without them. Seen tokens live ``keep_seconds`` if given, by the clock of the machine.
    """

    def __init__(self, n: int, keep_seconds: int | None = None):
        self.n, self.keep = n, None if keep_seconds is None else 1000 * keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", EVENT)
        self.seen = handle.getMapState("seen", "token bigint", "ts bigint", self.keep)
        self.last = handle.getValueState("last", "ts bigint, n_seen bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        """A row (recent, seen, last_ts) of ``sequences.load_state``."""
        for recent, seen, last in initialState[["recent", "seen", "last_ts"]].itertuples(index=False, name=None):
            self.recent.put([tuple(int(e[c]) for c in ("ts", "token", "positive", "gap")) for e in recent])
            for token in seen:
                self.seen.updateValue((int(token),), (int(last),))
            self.last.update((int(last), len(seen)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(rows).sort_values(["ts", "tie", "token"], kind="stable")
        clock, n_seen = self.last.get() if self.last.exists() else (None, 0)
        recent, taken = [tuple(r) for r in self.recent.get()] if self.recent.exists() else [], 0
        for ts, token, positive in frame[["ts", "token", "positive"]].itertuples(index=False, name=None):
            ts, token = int(ts), int(token)
            if (clock is not None and ts < clock) or self.seen.containsKey((token,)):
                continue
            recent.append((ts, token, int(positive), gap_bucket_of(None if clock is None else ts - clock)))
            self.seen.updateValue((token,), (ts,))
            clock, n_seen, taken = ts, n_seen + 1, taken + 1
        recent = recent[-self.n :]
        if taken:
            self.recent.put(recent)
            self.last.update((clock, n_seen))
        names = ("ts", "token", "positive", "gap")
        out = {"user_id": [key[0]], "recent": [[dict(zip(names, e, strict=True)) for e in recent]], "n_seen": [n_seen], "last_ts": [clock], "n_taken": [taken], "n_refused": [len(frame) - taken]}
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """State of lists and maps needs the store that keeps it on disk; the setting before is put back, since a query keeps its own."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def known_events(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """(user_id, ts, token, positive, tie) of the events (user_id, item_id, rating, ts) whose item is in the catalog (item_id, token)."""
    known = events.where("user_id is not null and ts is not null").join(tokens.select("item_id", F.col("token").cast("bigint").alias("token")), "item_id")
    return known.select("user_id", "ts", "token", (F.col("rating") >= POSITIVE).cast("int").alias("positive"), tie_key(F.col("user_id"), F.col("item_id")).alias("tie"))


def serving_updates(events: DataFrame, tokens: DataFrame, n: int, loaded: DataFrame | None = None, keep_seconds: int | None = None) -> DataFrame:
    """A row of state for each user with events in a batch of the stream (user_id, item_id, rating, ts).

    ``tokens`` (item_id, token) is the catalog: events of other items are left out before they reach the state. ``loaded`` is the
    state to begin with (``sequences.load_state``). Events of one second count in the order of a hash of user and item.
    """
    rows = known_events(events, tokens)
    begun = None if loaded is None else loaded.select("user_id", "recent", "seen", "last_ts").groupBy("user_id")
    return rows.groupBy("user_id").transformWithStateInPandas(ServingState(n, keep_seconds), STATE, "update", "None" if keep_seconds is None else "ProcessingTime", initialState=begun)


def serve(updates: DataFrame, write, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Start the stream into a ``foreachBatch`` function: a batch each ``interval`` ("250 milliseconds"), which bounds how old the
    state that readers see may be; without one all there is, then end."""
    asked = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    with keyed_state(updates.sparkSession):
        return (asked.trigger(processingTime=interval) if interval else asked.trigger(availableNow=True)).start()


#: What a table that ``serve_table`` keeps is ordered by: of two states of a user the one with more events.
ORDER = ("last_ts", "n_seen")


def serve_table(events: DataFrame, tokens: DataFrame, n: int, table: KeyedTable, checkpoint: str, loaded: DataFrame | None = None, interval: str | None = None) -> StreamingQuery:
    """As ``serving_updates`` and ``serve``, where seen tokens live for ever: the state is a row a user (user_id, recent, seen, last_ts,
    n_seen, n_loaded) of the keyed table, and a batch is appended to it by joins, so that no user or event is a call of Python.

    A batch that is done again starts from the table before it. ``n_loaded`` is how many events a user's state began with;
    where it equals ``n_seen``, no event of theirs was taken yet.
    """
    spark = events.sparkSession
    if loaded is not None and not table.lists(spark):
        size = F.size("seen").cast("bigint")
        table(loaded.select("user_id", "recent", "seen", "last_ts", size.alias("n_seen"), size.alias("n_loaded")), -1)

    def append(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows, held = batch.persist(), table.before(session, number)
        try:
            if held is None:
                held = session.createDataFrame([], f"user_id bigint, recent {Q.STATE_EVENTS}, seen array<bigint>, last_ts bigint, n_seen bigint, n_loaded bigint")
            mine = held.join(rows.select("user_id").distinct(), "user_id", "left_semi")
            after = Q.append_events(mine.select("user_id", "recent", "seen", "last_ts"), rows, n).withColumn("n_seen", F.size("seen").cast("bigint"))
            counts = mine.select("user_id", F.col("n_seen").alias("_before"), "n_loaded")
            changed = after.join(counts, "user_id", "left").where(F.col("n_seen") > F.coalesce("_before", F.lit(0)))
            table(changed.select("user_id", "recent", "seen", "last_ts", "n_seen", F.coalesce("n_loaded", F.lit(0).cast("bigint")).alias("n_loaded")), number)
        finally:
            rows.unpersist()

    asked = known_events(events, tokens).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (asked.trigger(processingTime=interval) if interval else asked.trigger(availableNow=True)).start()
