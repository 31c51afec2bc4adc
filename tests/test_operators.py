import math

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import features as P
from tidemark.operators import monitoring as M
from tidemark.operators import recommend as R
from tidemark.operators import trees as G
from tidemark.operators import splits as T
from tidemark.sources import files
from tidemark.streaming import sessions as SS
from tidemark.streaming.sink import KeyedTable

DAY = 86_400
RATINGS = "user_id long, item_id long, rating double, ts long"


def ratings(spark, rows):
    return spark.createDataFrame(rows, RATINGS)


def test_snapshot_days_and_boundary(spark):
    df = ratings(spark, [(1, 1, 4.0, 100 * DAY), (1, 2, 2.0, 105 * DAY), (2, 1, 5.0, 140 * DAY)])
    got = {(r.user_id, r.snapshot_day): r for r in P.snapshots(df, P.standard("user")).collect()}
    assert sorted(d for u, d in got if u == 1) == [101, 106, 108, 113, 131, 136]
    assert got[1, 106].user_n_ratings == 2 and got[1, 113].user_n_ratings_7d == 0 and got[1, 108].user_n_ratings_7d == 1
    assert got[1, 101].user_mean_rating == pytest.approx((4 + 17.5) / 6)
    late = {(r.user_id, r.snapshot_day) for r in P.snapshots(df, P.standard("user"), 120).collect()}
    assert late == {(1, 120), (1, 131), (1, 136), (2, 141), (2, 148), (2, 171)}


def test_as_of_takes_latest_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 1), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 3, 30), (1, 10, 100)], "k long, s long, v long")
    assert {(r.k, r.t): r.v for r in P.as_of_join(left, right, "k", "t", "s", ["v"]).collect()} == {(1, 5): 30, (1, 10): 100, (1, 1): None, (2, 9): None}


def test_spec_is_checked():
    for bad in (("x", "count", "rating"), ("x", "sum"), ("x", "count", None, 0)):
        with pytest.raises(ValueError):
            P.Feature(*bad)


def test_leakage_is_found(spark):
    good = [(1, 1, "train"), (2, 2, "val"), (3, 3, "test")]
    make = lambda rows: spark.createDataFrame([(1, i, ts, p) for i, ts, p in rows], "user_id long, item_id long, ts long, partition string")
    T.check_no_leakage(make(good))
    for bad in ([(1, 1, "train"), (2, 2, "val")], [(1, 9, "train"), (2, 2, "val"), (3, 3, "test")], [*good, (1, 4, "test")]):
        with pytest.raises(ValueError):
            T.check_no_leakage(make(bad))


def test_order_statistic(spark):
    for values in ([7], [3, 3, 3], list(range(0, 90 * DAY, DAY // 3))):
        df = spark.createDataFrame([(v,) for v in values], "ts long")
        for q in (0.0, 0.5, 0.95, 1.0):
            assert T.order_statistic(df, "ts", q) == sorted(values)[math.floor(q * (len(values) - 1))]


def test_metrics_by_hand(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "user_id long, item_id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 99), (2, 55), (3, 1)], "user_id long, item_id long")
    got = {r.user_id: r for r in E.per_user_metrics(recs, relevant, (2,)).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got[1].recall_2 == 0.5 and got[1].mrr == 0.5 and got[1].ndcg_2 == pytest.approx(1 / math.log2(3) / ideal)
    assert got[2].recall_2 == 0 and got[3].mrr == 0


def test_bootstrap_covers_the_mean(spark):
    users = spark.range(400).select(F.col("id").alias("user_id"), (F.col("id") % 2).cast("double").alias("m"))
    r = E.bootstrap(users, ["m"], 200).first()
    assert r["mean"] == 0.5 and 0.42 < r.low < 0.5 < r.high < 0.58
    tie = E.paired_difference(users, users, "m", replicates=50).first()
    assert tie.verdict == "tie"


def test_recommendation_checks(spark):
    recs = spark.createDataFrame([(1, 5), (1, 6)], "user_id long, item_id long")
    items, none = spark.createDataFrame([(5,), (6,)], "item_id long"), spark.createDataFrame([], "user_id long, item_id long")
    T.check_recommendations(recs, items, none)
    for args in ((recs, items.where("item_id = 5"), none), (recs.union(recs), items, none), (recs, items, recs)):
        with pytest.raises(ValueError):
            T.check_recommendations(*args)


def test_interleaving_is_fair_and_unique(spark):
    rows = spark.createDataFrame([(i, list(range(10)), list(range(5, 15))) for i in range(200)], "impression_id long, a array<long>, b array<long>")
    got = M.interleave(rows, 6).toPandas()
    assert (got.groupby("impression_id").item_id.nunique() == 6).all()
    per = got.groupby(["impression_id", "team"]).size().unstack()
    assert (per == 3).all().all()
    assert 60 < (got[got.slot == 1].team == "A").sum() < 140


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, i, 1.0 + i % 5, 1000 * u + t) for u in range(3) for i, t in enumerate([0, 30, 150, 750, 2549, 4349, 6150, 6150])]
    events = ratings(spark, rows)
    late = ratings(spark, [(0, 0, 5.0, 0), (0, 99, 5.0, 5)])
    events.coalesce(1).write.json(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(RATINGS).json(str(tmp_path / "in" / "*"))
    sink = KeyedTable(str(tmp_path / "out"), "user_id", SS.NEWEST, 4)

    def run():
        q = SS.stream_sessions(stream).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    online = spark.createDataFrame(sink.read(spark).collect(), SS.SESSION)
    columns = ["session_n_events", "session_n_positive", "session_mean_rating"]
    bad = {r.feature: r.mismatches for r in E.parity(online, SS.batch_sessions(events), ["user_id"], columns).collect()}
    assert bad == dict.fromkeys(columns, 0)
    late.coalesce(1).write.json(str(tmp_path / "in" / "b"))
    run()
    again = {r.user_id: r.session_n_events for r in sink.read(spark).collect()}
    assert again == {r.user_id: r.session_n_events for r in online.collect()}


def test_ingest_refuses_broken_tables(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    good = {
        "ratings": "userId,movieId,rating,timestamp\n1,1,4.0,10\n",
        "movies": "movieId,title,genres\n1,A (1999),Drama\n",
        "tags": "userId,movieId,tag,timestamp\n1,1,fun,5\n",
        "links": "movieId,imdbId,tmdbId\n1,0114709,862\n",
    }
    broken = {"ratings": "1,2,4.1,10\n", "movies": "1,B (1998),War\n", "tags": "1,1,fun,-1\n", "links": "1,0114710,863\n"}
    for table, line in broken.items():
        for name, text in good.items():
            (raw / f"{name}.csv").write_text(text + (line if name == table else ""))
        with pytest.raises(ValueError, match="break|repeat"):
            files.ingest(spark, str(raw), str(out))
        assert not out.exists()


def test_ingest_and_lineage(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,1,4.0,10\n1,9,3.5,11\n")
    (raw / "movies.csv").write_text('movieId,title,genres\n1," A, b (1999) ",Drama|War\n2,No year,(no genres listed)\n')
    (raw / "tags.csv").write_text('userId,movieId,tag,timestamp\n1,1,"  Fun, ny ",5\n1,1,"  ",6\n')
    (raw / "links.csv").write_text("movieId,imdbId,tmdbId\n1,0114709,862\n2,0113497,\n")
    for _ in range(2):  # the second run replaces what the first wrote
        audit = {(r.table, r.reason): r.dropped for r in files.ingest(spark, str(raw), str(tmp_path / "out")).collect()}
        assert audit == {("ratings", "unknown item"): 1, ("tags", "unknown item"): 0, ("tags", "empty"): 1}
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")) == ["links.parquet", "movies.parquet", "ratings.parquet", "tags.parquet"]
    movies = {r.item_id: r for r in spark.read.parquet(str(tmp_path / "out/movies.parquet")).collect()}
    assert (movies[1].title, movies[1].year, movies[1].genres, movies[2].genres) == ("A, b (1999)", 1999, ["Drama", "War"], [])
    assert [r.tag for r in spark.read.parquet(str(tmp_path / "out/tags.parquet")).collect()] == ["fun, ny"]
    prints = files.fingerprint(spark, str(tmp_path / "out")).collect()
    kept = spark.createDataFrame(prints, files.FINGERPRINT)
    assert files.manifest(kept, "ingest", {"a": "1"}, 42).first().n_files == len(prints)
    assert files.changed_files(kept, kept).count() == 0
    assert {r.problem for r in files.changed_files(kept.limit(1), kept).collect()} <= {"missing"}


def test_ranker_learns(spark):
    rows = spark.range(3000).select((F.col("id") / 20).cast("long").alias("user_id"), F.col("id").alias("item_id"), F.lit(1).alias("retrieval_rank"), F.rand(1).alias("f1"), F.rand(2).alias("f2"))
    wide = G.vectors(rows.withColumn("label", (F.col("f1") > 0.7).cast("int")), ["f1", "f2"])
    model = G.fit_ranker(wide, wide.select("user_id").distinct().where("user_id % 5 = 0"), {"maxDepth": 3}, 5)
    found = {r.feature: r.importance for r in G.importances(model, wide, ["f1", "f2"]).collect()}
    assert found["f1"] > 9 * found["f2"]


def test_fallback_sources(spark):
    requests = spark.createDataFrame([(1,), (2,)], "user_id long")
    personal = spark.createDataFrame([(1, 7, 0.5, 1)], "user_id long, item_id long, score double, rank int")
    popular = spark.createDataFrame([(3, 9.0), (4, 8.0)], "item_id long, score double")
    got = {(r.user_id, r.item_id): r.source for r in R.recommend_with_fallback(requests, personal, popular, spark.createDataFrame([(2, 3)], "user_id long, item_id long"), 1).collect()}
    assert got == {(1, 7): "personal", (2, 4): "popular"}


def test_vector_lists_skip_seen_break_ties_and_merge_blocks(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "user_id long, vector array<double>")
    items = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(9)], "item_id long, embedding array<double>")
    seen = spark.createDataFrame([(1, 0), (2, 2), (9, 5)], "user_id long, item_id long")
    found = {(r.user_id, r["rank"]): r.item_id for r in R.vector_lists(users, items, seen, 3, block_rows=2).collect()}
    assert found == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (2, 1): 5, (2, 2): 8, (2, 3): 1}
    assert R.vector_lists(users, items.limit(0), seen, 3).count() == 0
