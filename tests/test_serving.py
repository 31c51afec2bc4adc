"""Serving state kept by a stream, and the keyed table that batches of a stream keep up to date."""

import glob
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.scalars import gap_bucket
from tidemark.operators import sequences as Q
from tidemark.streaming import serving as SV
from tidemark.streaming.sink import KeyedTable

EVENT = "user_id bigint, item_id bigint, rating double, ts bigint"


def brute_state(history, events, n):
    """(recent, seen) a user after events one by one."""
    out = {}
    for u, token, positive, ts in history + events:
        recent, seen = out.setdefault(u, ([], set()))
        if token in seen or (recent and ts < recent[-1][0]):
            continue
        recent.append((ts, token, positive, SV.gap_bucket_of(None if not recent else ts - recent[-1][0])))
        seen.add(token)
    return {u: (recent[-n:], len(seen)) for u, (recent, seen) in out.items()}


def state_of(rows):
    return {r.user_id: ([tuple(e) for e in r.recent], r.n_seen) for r in rows}


def test_gaps_as_in_sequences(spark):
    gaps = [None, 0, 1, 2, 3, 59, 60, 2**20 - 2, 2**20 - 1, 2**40]
    got = spark.createDataFrame([(i, g) for i, g in enumerate(gaps)], "i long, g long").orderBy("i").select(gap_bucket(F.col("g")).alias("b")).collect()
    assert [r.b for r in got] == [SV.gap_bucket_of(g) for g in gaps]


@pytest.fixture
def stream(spark, tmp_path):
    def run(batches, tokens, n, loaded=None, **options):
        table = KeyedTable(str(tmp_path / "table"), "user_id", ("last_ts", "n_seen"), 4)
        for rows in batches:
            spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        SV.serve(SV.serving_updates(events, tokens, n, loaded, **options), table, str(tmp_path / "at")).awaitTermination()
        return table

    return run


def test_state_after_a_stream_equals_that_of_the_history(spark, stream):
    """Late and repeated events, in their own batch and another, and items outside the catalog leave no trace."""
    rng = random.Random(3)
    old = [(u, u * 100 + k, float(rng.randint(1, 5)), 1000 * k + u) for u in range(6) for k in range(rng.randint(0, 9))]
    new = [(u, u * 100 + 50 + k, float(rng.randint(1, 5)), 20_000 + 777 * k * (u + 1)) for u in range(8) for k in range(7)]
    late = [(u, i + 30, r, t - 100_000) for u, i, r, t in new[::3]]
    outside = [(u, 9_999, 5.0, 10**6) for u in range(8)]
    new.sort(key=lambda e: e[3])
    batches = [new[:20] + new[5:9], new[20:40] + late + new[:6], outside + new[40:], new]
    tokens = spark.createDataFrame([(i, i) for i in range(1000)], "item_id long, token long")
    frame = lambda rows: spark.createDataFrame(rows, EVENT)
    loaded = Q.load_state(Q.user_sequences(frame(old)), 5)
    table = stream(batches, tokens, 5, loaded)
    whole = {r.user_id: ([tuple(e) for e in r.recent], len(r.seen)) for r in Q.load_state(Q.user_sequences(frame(old + new)), 5).collect()}
    got = state_of(table.read(spark).collect())
    assert got == whole and len(got) == 8
    view = table.read(spark).select("user_id", "recent")
    assert [r.ts for r in Q.history_view(view).where("user_id = 3").orderBy("place").collect()] == [e[0] for e in reversed(whole[3][0])]


def test_appended_batches_equal_events_one_by_one(spark):
    rng = random.Random(8)
    events = [(rng.randrange(5), rng.randrange(60), rng.randrange(2), t) for t in sorted(rng.randrange(10**6) for _ in range(300))]
    old, new = events[:150], events[150:] + [(u, k + 70, 1, 5) for u in range(5) for k in range(3)]
    begun = brute_state([], old, 4)
    seen = {}
    for u, token, _, _ in old:
        seen.setdefault(u, set()).add(token)
    state = spark.createDataFrame(
        [(u, r, sorted(seen[u]), r[-1][0]) for u, (r, _) in begun.items()],
        "user_id long, recent array<struct<ts:bigint,token:bigint,positive:int,gap:int>>, seen array<bigint>, last_ts long",
    )
    after = Q.append_events(state, spark.createDataFrame(new, "user_id long, token long, positive int, ts long"), 4).collect()
    want = brute_state([], old + sorted((e for e in new if e[3] != 5), key=lambda e: e[3]), 4)
    assert {r.user_id: ([tuple(e) for e in r.recent], len(r.seen)) for r in after} == want


@pytest.mark.parametrize("keep_seconds", [None, 3600])
def test_a_batch_each_interval(spark, tmp_path, keep_seconds):
    tokens = spark.createDataFrame([(1, 1)], "item_id long, token long")
    spark.createDataFrame([(1, 1, 5.0, 7)], EVENT).write.json(str(tmp_path / "in"))
    table = KeyedTable(str(tmp_path / "t"), "user_id", ("last_ts",), 2)
    updates = SV.serving_updates(spark.readStream.schema(EVENT).json(str(tmp_path / "in")), tokens, 3, keep_seconds=keep_seconds)
    asked = SV.serve(updates, table, str(tmp_path / "at"), "250 milliseconds")
    try:
        end = time.monotonic() + 60  # with a time to live every trigger is a batch, so none is the last
        while not table.lists(spark) and time.monotonic() < end:
            time.sleep(0.2)
        assert asked.isActive and state_of(table.read(spark).collect()) == {1: ([(7, 1, 1, 1)], 1)}
    finally:
        asked.stop()


def test_keyed_table_of_many_batches(spark, tmp_path):
    """Fifty batches, some done again, one of them after a later one began: a row a key, the newest, in a bounded number of files."""
    rng = random.Random(5)
    table, want, most = KeyedTable(str(tmp_path), "k", ("t",), 4), {}, 0
    assert table.read(spark) is None
    for number in range(50):
        rows = [(rng.randrange(40), rng.randrange(100), number) for _ in range(rng.choice([1, 3, 8]))]
        batch = spark.createDataFrame(rows, "k long, t long, v long").coalesce(1)
        table(batch, number)
        for k, t, v in rows:
            if k not in want or t > want[k][0]:
                want[k] = (t, v)
        if number in (7, 31):
            table(batch, number)
        if number % 10 == 9:
            got = [(r.k, r.t, r.v) for r in table.read(spark).collect()]
            assert sorted(got) == sorted((k, t, v) for k, (t, v) in want.items())
        most = max(most, len(glob.glob(f"{tmp_path}/data/*/*/*.parquet")))
    assert most <= 3 * 4 and len(table.lists(spark)) == 2


def test_a_batch_done_again_after_a_crash_starts_from_the_one_before(spark, tmp_path):
    table = KeyedTable(str(tmp_path), "k", ("t",), 2)
    frame = lambda rows: spark.createDataFrame(rows, "k long, t long, v string")
    table(frame([(1, 5, "a"), (2, 5, "b")]), 0)
    frame([(1, 9, "lost")]).withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(f"{tmp_path}/data/batch=1")  # written, never listed
    assert sorted((r.k, r.v) for r in table.read(spark).collect()) == [(1, "a"), (2, "b")]
    table(frame([(1, 6, "c"), (2, 4, "old"), (2, 5, "equal")]), 1)
    assert sorted((r.k, r.v) for r in table.read(spark).collect()) == [(1, "c"), (2, "b")]
    table(frame([]), 2)
    assert table.read(spark).count() == 2


def test_users_of_whom_every_event_is_refused_have_no_row(spark, tmp_path):
    """User 1 has old events and new ones outside the catalog alone, user 2 only the latter, users 3, 4 and 6 an even item.

    What users 6 and 7 have outside the catalog is so new that, moved back by 100 million seconds, it would still be newer than their state."""
    new, old = 10_400, 9_500  # days
    bought = [(1, 4, old), (1, 3, new), (1, 151, new + 1), (2, 5, new), (2, 7, new + 9), (3, 8, old), (3, 6, new), (3, 9, new + 2), (4, 2, new + 3), (5, 2, old), (6, 2, new + 9), (6, 11, new + 1309), (7, 4, old), (7, 13, new + 1300)]
    lines = [(n, 1, item, 30.0, 100.0, day) for n, (_, item, day) in enumerate(bought)]
    made = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, day int")
    made.withColumn("l_shipdate", F.date_from_unix_date("day")).drop("day").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(n, user) for n, (user, _, _) in enumerate(bought)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(300).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    duck = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "i3_i6_stream_serving"
    want = duck.execute(f"SELECT user_id, recent, n_seen, last_ts FROM ({catalog.ORACLES[name]})").fetchall()
    got = [(r.user_id, r.recent, r.n_seen, r.last_ts) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {r[0] for r in got} == {3, 4, 6}


@pytest.mark.parametrize("begun", [True, False])
def test_state_kept_by_joins_equals_events_one_by_one(spark, tmp_path, begun):
    """Late, repeated and unknown events leave no trace, nor does a batch that is done again; users without an event taken are told by their counts."""
    rng = random.Random(4)
    old = [(u, u * 100 + k, float(rng.randint(1, 5)), 1000 * k + u) for u in range(6) for k in range(rng.randint(0, 9))] if begun else []
    new = sorted([(u, u * 100 + 50 + k, float(rng.randint(1, 5)), 20_000 + 777 * k * (u + 1)) for u in range(1, 8) for k in range(7)], key=lambda e: e[3])
    late, outside = [(u, i + 30, r, t - 100_000) for u, i, r, t in new[::3]], [(u, 9_999, 5.0, 10**6) for u in range(9)]
    for rows in [new[:20] + new[5:9], new[20:40] + (late if begun else []) + new[:6], outside + new[40:], new]:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    tokens = spark.createDataFrame([(i, i) for i in range(1000)], "item_id long, token long")
    frame = lambda rows: spark.createDataFrame(rows, EVENT)
    table = KeyedTable(str(tmp_path / "table"), "user_id", SV.ORDER, 3)
    loaded = Q.load_state(Q.user_sequences(frame(old)), 5) if begun else None
    SV.serve_table(events, tokens, 5, table, str(tmp_path / "at"), loaded).awaitTermination()
    whole = {r.user_id: ([tuple(e) for e in r.recent], len(r.seen)) for r in Q.load_state(Q.user_sequences(frame(old + new)), 5).collect()}
    assert state_of(table.read(spark).collect()) == whole
    untouched = {u for u, *_ in old} - {u for u, *_ in new}
    assert {r.user_id for r in table.read(spark).where("n_seen = n_loaded").collect()} == untouched
    for name in ("3", ".3.crc"):  # as after a crash before the last batch was noted as done
        (tmp_path / "at" / "commits" / name).unlink()
    written = table.places(spark, 3)
    SV.serve_table(events, tokens, 5, table, str(tmp_path / "at"), loaded).awaitTermination()
    assert (tmp_path / "at" / "commits" / "3").exists() and table.places(spark, 3) == written
    assert state_of(table.read(spark).collect()) == whole


def test_the_query_keeps_its_state_by_joins(spark, monkeypatch):
    monkeypatch.setattr(SV, "ServingState", None)
    assert catalog.QUERIES["i3_i6_stream_serving"](spark, "/root/testdata/sf0.001").count() > 0
