"""More queries with their SQL: sources and sinks, checks, serving state, streams, evaluation of recommenders."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.catalog import EV, MV, RT, SPLIT, TG, VERDICT, bootstrap_sql, cutoff_of, query, rounded, split_of, train_of
from tidemark.functions import scalars as S
from tidemark.operators import evaluation as E
from tidemark.operators import experiments as X
from tidemark.operators import features as P
from tidemark.operators import monitoring as M
from tidemark.operators import recommend as R
from tidemark.operators import sequences as Q
from tidemark.operators import splits as T
from tidemark.operators import trees as G
from tidemark.plans import views as V
from tidemark.sources import files
from tidemark.sources.stages import scratch, stage
from tidemark.streaming import serving as SV
from tidemark.streaming import sessions as SS
from tidemark.streaming.sink import KeyedTable


def unit_sql(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS bigint) / 4294967296.0)"


# --- sources and sinks ---


def raw_csvs(spark, d) -> str:
    """The four raw tables as CSV files."""
    top = scratch(spark)
    own = V.ratings(spark, d)
    own.selectExpr("user_id as userId", "item_id as movieId", "rating", "ts as timestamp").write.csv(f"{top}/ratings.csv", header=True)
    known = V.movies_raw(spark, d).where("item_id % 9 <> 0")
    known.selectExpr("item_id as movieId", "title", "genres").write.csv(f"{top}/movies.csv", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    V.tags_raw(spark, d).selectExpr("user_id as userId", "item_id as movieId", "tag", "ts as timestamp").write.csv(f"{top}/tags.csv", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    links = V.table(spark, d, "part").selectExpr("p_partkey as movieId", "lpad(cast(p_partkey as string), 7, '0') as imdbId", "if(p_partkey % 10 = 0, null, cast(p_partkey * 3 as string)) as tmdbId")
    links.write.csv(f"{top}/links.csv", header=True)
    return top


@query(f"WITH {RT} SELECT * FROM ratings")
def a1_ratings_csv(spark, d):
    return files.read_ratings(spark, f"{raw_csvs(spark, d)}/ratings.csv")


@query("SELECT p_partkey AS item_id, CAST(p_partkey AS double) AS imdb_id, CAST(CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey * 3 END AS double) AS tmdb_id FROM part")
def a4_links_csv(spark, d):
    return files.read_links(spark, f"{raw_csvs(spark, d)}/links.csv").select("item_id", F.col("imdb_id").cast("double"), F.col("tmdb_id").cast("double"))


@query(f"""WITH {RT}, {TG}, asked AS (SELECT ratings.* FROM ratings JOIN part ON item_id = p_partkey WHERE item_id % 7 = user_id % 7),
audit AS (SELECT 'ratings' AS "table", 'unknown item' AS reason, count(*) AS n FROM ratings WHERE item_id % 9 = 0 UNION ALL SELECT 'tags', 'unknown item', count(*) FROM tags WHERE item_id % 9 = 0
 UNION ALL SELECT 'tags', 'empty', (SELECT count(*) FROM asked) - (SELECT count(*) FROM tags) UNION ALL SELECT 'ratings', 'written', count(*) FROM ratings WHERE item_id % 9 <> 0
 UNION ALL SELECT 'tags', 'written', count(*) FROM tags WHERE item_id % 9 <> 0 UNION ALL SELECT 'movies', 'written', count(*) FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT 'links', 'written', count(*) FROM part) SELECT * FROM audit""")
def a6_a9_d12_ingest_audit(spark, d):
    """What the ingest dropped and why, and the rows of the tables that it wrote, read back; it is run twice over the same folder."""
    raw, out = raw_csvs(spark, d), scratch(spark)
    rules = files.INGEST_RULES | {"links": {"item_id": "item_id >= 0"}}  # keys of the part table start at 0
    files.ingest(spark, raw, out, rules)
    audit = files.ingest(spark, raw, out, rules).withColumnRenamed("dropped", "n")
    for name in files.INGEST_RULES:
        written = spark.read.parquet(f"{out}/{name}.parquet")
        audit = audit.unionByName(written.agg(F.lit(name).alias("table"), F.lit("written").alias("reason"), F.count("*").alias("n")))
    return audit


@query(f"""WITH {RT}, ev AS (SELECT *, CAST(floor(ts / 86400) AS bigint) AS day FROM ratings), act AS (SELECT DISTINCT item_id, day FROM ev)
SELECT item_id, count(*) AS n_snapshots, min(s) AS first_day, max(s) AS last_day FROM (SELECT item_id, day + 1 AS s FROM act UNION SELECT item_id, day + 8 FROM act UNION SELECT item_id, day + 31 FROM act) x GROUP BY item_id""")
def a8_a15_ordered_snapshots(spark, d):
    path, spec = scratch(spark), P.standard("item")
    files.write_ordered(P.snapshots(stage(V.ratings(spark, d)), spec, ordered=True), path, ["item_id", "snapshot_day"], in_ranges=True)
    P.feature_view(spark.read.parquet(path), spec, "item_snapshots")
    return spark.table("item_snapshots").groupBy("item_id").agg(F.count("*").alias("n_snapshots"), F.min("snapshot_day").alias("first_day"), F.max("snapshot_day").alias("last_day"))


@query(f"WITH {EV} SELECT CAST(user_id AS varchar) AS key, user_id, item_id, rating, ts FROM stream")
def a10_a11_h14_messages(spark, d):
    sent = SS.to_messages(V.event_stream(spark, d))
    return sent.select("key", F.from_json("value", SS.EVENT).alias("e")).select("key", "e.*")


@query("SELECT 0 AS n_changed, 0 AS n_missing, 1 AS n_stages")
def a13_a14_fingerprints(spark, d):
    """Fingerprints of the tables, taken twice, must agree; one lineage row records them."""
    now = stage(files.fingerprint(spark, f"{d}/documents.parquet"))
    again = files.fingerprint(spark, f"{d}/documents.parquet")
    stages = files.manifest(now, "raw", {"tables": "documents"}, 42).where("n_files > 0").agg(F.count("*").cast("int").alias("n_stages"))
    wrong = files.changed_files(again, now).agg(F.count("*").cast("int").alias("n_changed"), F.count_if(F.col("problem") == "missing").cast("int").alias("n_missing"))
    return wrong.crossJoin(stages)


# --- checks and samples ---


@query(f"""WITH {MV} SELECT 'genres' AS rule, 0 AS violations UNION ALL SELECT 'item_id', count(*) FILTER (NOT item_id >= 1) FROM movies UNION ALL SELECT 'title', count(*) FILTER (length(title) < 1) FROM movies
UNION ALL SELECT 'year', count(*) FILTER (year IS NOT NULL AND NOT (year BETWEEN 1870 AND 2030)) FROM movies""")
def b1_movie_expectations(spark, d):
    return T.expectations(V.movies(spark, d), T.MOVIE_RULES)


@query(f"""WITH {RT}, {TG}, l AS (SELECT p_partkey AS item_id FROM part)
SELECT 'tags' AS "table", 'item_id' AS rule, count(*) FILTER (NOT item_id >= 1) AS violations FROM tags UNION ALL SELECT 'tags', 'tag', count(*) FILTER (length(tag) < 1) FROM tags UNION ALL SELECT 'tags', 'ts', count(*) FILTER (NOT ts >= 0) FROM tags
UNION ALL SELECT 'tags', 'user_id', count(*) FILTER (NOT user_id >= 1) FROM tags UNION ALL SELECT 'links', 'item_id', count(*) FILTER (NOT item_id >= 1) FROM l""")
def b1_tag_link_expectations(spark, d):
    """Rows of tags and links that break a rule: user 0 and item 0."""
    links = V.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    found = [(name, T.expectations(df, rules)) for name, df, rules in (("tags", V.clean_tags(V.tags_raw(spark, d)), T.TAG_RULES), ("links", links, T.LINK_RULES))]
    one, two = (df.select(F.lit(name).alias("table"), "rule", "violations") for name, df in found)
    return one.unionByName(two)


@query(f"""WITH {SPLIT} SELECT partition, count(*) AS n_rows, min(ts) AS lo, max(ts) AS hi, count(*) FILTER (n > 1) AS repeated FROM (SELECT *, count(*) OVER (PARTITION BY user_id, item_id) AS n FROM split) q GROUP BY partition""")
def b5_leakage(spark, d):
    split = split_of(spark, d)
    T.check_no_leakage(split)
    return T.partition_bounds(split)


ROWS_TEXT = "'42-' || CAST(user_id AS varchar) || '-' || CAST(item_id AS varchar) || '-' || CAST(rating AS varchar) || '-' || CAST(ts AS varchar)"


@query(f"WITH {RT} SELECT user_id, item_id, rating, ts FROM ratings ORDER BY {unit_sql(ROWS_TEXT)}, user_id, item_id, rating, ts LIMIT 1000", name="b7_fixed_sample")
def b7_fixed_sample(spark, d):
    return T.fixed_sample(V.ratings(spark, d), 1000)


SAMPLE = f"{RT}, sample AS (SELECT DISTINCT user_id FROM ratings WHERE ((((((user_id + ((42::hugeint * 2654435769) % 4294967296)) % 4294967296) * 2654435761::hugeint) % 4294967296) // 65536) % 100) < 10)"
HALF = unit_sql("'42-' || CAST(user_id AS varchar)")


@query(f"WITH {SAMPLE} SELECT user_id, CASE WHEN {HALF} < 0.5 THEN 'second' ELSE 'first' END AS half FROM (SELECT DISTINCT user_id FROM ratings) u WHERE user_id NOT IN (SELECT user_id FROM sample)", name="b8_user_halves")
def b8_user_halves(spark, d):
    rows = V.ratings(spark, d)
    return T.split_users(rows, T.sample_users(rows, 10).distinct(), 0.5)


@query(f"WITH {SPLIT} SELECT DISTINCT user_id FROM split WHERE partition = 'val' AND {HALF} < 0.5")
def b9_early_stop_users(spark, d):
    return T.early_stop_users(split_of(spark, d).where("partition = 'val'"))


@query(f"""WITH {SPLIT}, h AS (SELECT user_id FROM split WHERE partition = 'val' AND {HALF} < 0.5), t AS (SELECT user_id, item_id FROM split WHERE partition = 'val' AND label = 1)
SELECT CASE WHEN user_id IN (SELECT user_id FROM h) THEN 'in' ELSE 'out' END AS side, user_id, item_id FROM t""")
def b10_split_targets(spark, d):
    later = split_of(spark, d).where("partition = 'val'")
    inside, outside = T.split_targets(later.where("label = 1").select("user_id", "item_id"), T.early_stop_users(later))
    return inside.select(F.lit("in").alias("side"), "*").unionByName(outside.select(F.lit("out").alias("side"), "*"))


@query(f"WITH {RT}, {MV} SELECT user_id, item_id, g AS genre FROM (SELECT user_id, item_id, unnest(genres) AS g FROM ratings JOIN movies USING (item_id) WHERE rating >= 4) q WHERE g IN ('anvil', 'blue', 'bolt', 'cold')")
def b14_positive_vocabulary(spark, d):
    rows = R.signal(V.ratings(spark, d), "positive").join(V.movies(spark, d), "item_id")
    return rows.select("user_id", "item_id", F.explode("genres").alias("genre")).where(F.col("genre").isin("anvil", "blue", "bolt", "cold"))


CUT = "(SELECT ts AS t FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM ratings) q WHERE rn = CAST(floor({q} * (n - 1)) AS bigint) + 1)"


@query(f"WITH {RT} SELECT 't1' AS field WHERE (SELECT t FROM {CUT.format(q='CAST(0.8999999999999999 AS double)')} a) <> (SELECT t FROM {CUT.format(q='CAST(0.8 AS double)')} b) UNION ALL SELECT 't2' WHERE (SELECT t FROM {CUT.format(q='CAST(0.95 AS double)')} c) <> (SELECT t FROM {CUT.format(q='CAST(0.9 AS double)')} e)")
def b15_compatibility(spark, d):
    rows = stage(V.ratings(spark, d))
    lineage = lambda a, b: {"t1": T.order_statistic(rows, "ts", a), "t2": T.order_statistic(rows, "ts", b)}
    return spark.createDataFrame([(x,) for x in T.lineage_differences(lineage(1 - 0.05 - 0.05, 0.95), lineage(0.8, 0.9))], "field string")


@query(f"""WITH {RT}, r AS (SELECT user_id, item_id, ts AS score, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS rank FROM ratings WHERE item_id % 3 <> 0), two AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE rank = 1)
SELECT 'excluded_item' AS rule, (SELECT count(*) FROM two WHERE item_id % 5 = 0) AS violations UNION ALL SELECT 'repeated_item', (SELECT count(*) FROM r WHERE rank = 1) UNION ALL SELECT 'unknown_item', (SELECT count(*) FROM two WHERE item_id % 7 = 0)
UNION ALL SELECT 'score_order', (SELECT count(*) FROM (SELECT score, lag(score) OVER (PARTITION BY user_id ORDER BY rank) AS b FROM two) q WHERE score > b)""")
def b11_b16_broken_lists(spark, d):
    """Lists with planted faults of every kind."""
    rows = V.ratings(spark, d).where("item_id % 3 <> 0")
    rank = F.row_number().over(Q.Window.partitionBy("user_id").orderBy("item_id"))
    lists = stage(rows.select("user_id", "item_id", F.col("ts").alias("score"), rank.alias("rank")))
    items = V.table(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("item_id"))
    seen = lists.where("item_id % 5 = 0").select("user_id", "item_id").distinct()
    return T.recommendation_violations(lists.unionByName(lists.where("rank = 1")), items, seen)


# --- joins, aggregates, sequences ---


@query(f"""WITH {RT}, ev AS (SELECT *, CAST(floor(ts / 86400) AS bigint) AS day FROM ratings), i AS (SELECT item_id, day, sum(count(*)) OVER (PARTITION BY item_id ORDER BY day) - count(*) AS n FROM ev GROUP BY item_id, day),
u AS (SELECT user_id, day, sum(count(*)) OVER (PARTITION BY user_id ORDER BY day) - count(*) AS n FROM ev GROUP BY user_id, day)
SELECT ev.user_id, ev.item_id, ev.ts, CAST(i.n AS double) AS item_n_ratings, CAST(u.n AS double) AS user_n_ratings FROM ev JOIN i ON ev.item_id = i.item_id AND ev.day = i.day JOIN u ON ev.user_id = u.user_id AND ev.day = u.day""")
def c10_daily_refresh(spark, d):
    """Each event with what both its entities' snapshots said at the start of its day."""
    rows = stage(V.ratings(spark, d))
    out = rows.withColumn("day", S.day_of(F.col("ts")))
    for p in ("item", "user"):
        snaps = P.snapshots(rows, P.standard(p)).select(f"{p}_id", "snapshot_day", f"{p}_n_ratings")
        out = P.as_of_join(out, snaps, f"{p}_id", "day", "snapshot_day", [f"{p}_n_ratings"])
    count = lambda c: F.coalesce(c, F.lit(0)).cast("double").alias(c)
    return out.select("user_id", "item_id", "ts", count("item_n_ratings"), count("user_n_ratings"))


SIM = f"""{RT}, n AS (SELECT item_id, sqrt(count(*)) AS norm FROM ratings GROUP BY item_id), co AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS c FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL),
sim AS (SELECT i AS item_id, j AS other, round(c / (x.norm * y.norm + 10.0), 9) AS similarity FROM co JOIN n x ON x.item_id = i JOIN n y ON y.item_id = j),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, other) AS rn FROM sim) q WHERE rn <= 20)"""


@query(f"WITH {SIM} SELECT r.user_id, other AS item_id, round(sum(similarity), 6) AS score, count(*) AS n FROM ratings r JOIN near USING (item_id) WHERE r.user_id % 20 = 0 GROUP BY r.user_id, other HAVING NOT EXISTS (SELECT 1 FROM ratings s WHERE s.user_id = r.user_id AND s.item_id = near.other)")
def c13_similarity_scores(spark, d):
    """A stated set of users scored by their neighbours' similarities."""
    rows = stage(V.ratings(spark, d))
    asked = rows.where("user_id % 20 = 0")
    scores = asked.select("user_id", "item_id").join(R.item_knn(rows, 20), "item_id").groupBy("user_id", F.col("other").alias("item_id")).agg(F.sum("similarity").alias("score"), F.count("*").alias("n"))
    return rounded(scores.join(asked.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti"))


@query(f"WITH {RT}, s AS (SELECT item_id, count(*) AS n FROM ratings WHERE ts < 820454400 GROUP BY item_id) SELECT p_partkey AS item_id, CAST(n AS double) AS n FROM part LEFT JOIN s ON p_partkey = item_id")
def c16_aligned_items(spark, d):
    stats = V.ratings(spark, d).where("ts < 820454400").groupBy("item_id").agg(F.count("*").alias("n"))
    return X.aligned_items(V.table(spark, d, "part").select(F.col("p_partkey").alias("item_id")), stats).select("item_id", F.col("n").cast("double").alias("n"))


@query(f"WITH {RT}, p AS (SELECT item_id, count(*) AS n, count(*) FILTER (rating >= 4) AS np FROM ratings GROUP BY item_id) SELECT item_id, round(np + 1e-6 * n / max(n) OVER (), 9) AS score FROM p")
def d7_tie_break(spark, d):
    rows = V.ratings(spark, d)
    positive = rows.groupBy("item_id").agg(F.count_if(F.col("rating") >= 4).cast("double").alias("score"))
    return rounded(X.popularity_tie_break(positive, R.popularity(rows)), 9)


DRAW = {x: unit_sql(f"'42-0-{x}-' || CAST(user_id AS varchar)") for x in ("latest", "end")}


@query(f"""WITH {RT}, o AS (SELECT user_id, item_id AS token, CAST(rating >= 4 AS integer) AS positive, ts, row_number() OVER w AS pos, ts - lag(ts) OVER w AS g FROM ratings WINDOW w AS (PARTITION BY user_id ORDER BY ts, md5(CAST(user_id AS varchar) || '-' || CAST(item_id AS varchar)), item_id)),
n AS (SELECT *, max(pos) OVER (PARTITION BY user_id) AS n FROM o), e AS (SELECT *, CASE WHEN {DRAW['latest']} < 0.5 THEN n ELSE least(n, 2 + CAST(floor({DRAW['end']} * greatest(n - 1, 1)) AS bigint)) END AS last FROM n WHERE n >= 2),
x AS (SELECT user_id, pos, token, CAST(CASE WHEN g IS NULL THEN 1 ELSE least(32, 2 + floor(log2(g + 1))) END AS integer) AS gap, lead(token) OVER v AS next_token, lead(positive) OVER v AS next_positive FROM e WHERE pos <= last AND pos >= last - 20 WINDOW v AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, CAST(pos AS integer) AS pos, token, gap, next_token, next_positive FROM x WHERE next_token IS NOT NULL""", name="e8_training_windows")
def e8_training_windows(spark, d):
    return Q.training_windows(Q.user_sequences(V.ratings(spark, d)), 20, 0)


@query(f"""WITH {RT} SELECT user_id, item_id, ts, row_number() OVER (ORDER BY ts, md5(CAST(user_id AS varchar) || '-' || CAST(item_id AS varchar)), user_id, item_id) AS place FROM ratings WHERE ts >= 883612800""")
def f1_f2_replay_places(spark, d):
    """The place of each event in the order of a replay."""
    rows = V.ratings(spark, d).where("ts >= 883612800").withColumn("tie", S.tie_key(F.col("user_id"), F.col("item_id")))
    return Q.global_rank(rows, "ts", "tie", "user_id", "item_id").select("user_id", "item_id", "ts", "place")


@query(f"WITH {MV} SELECT item_id, CAST(coalesce(floor(greatest(0, year - 1870) / 5) + 1, 0) AS integer) AS year_bucket, CAST(list_contains(genres, 'blue') AS integer) AS is_blue, CAST(list_contains(genres, 'rod') AS integer) AS is_rod FROM movies")
def h5_h12_item_columns(spark, d):
    return V.movies(spark, d).select("item_id", S.year_bucket(F.col("year")).alias("year_bucket"), *S.multi_hot(F.col("genres"), ["blue", "rod"]))


@query(f"WITH {RT}, p AS (SELECT item_id, count(*) / (SELECT CAST(count(*) AS double) FROM ratings WHERE rating >= 4) AS q FROM ratings WHERE rating >= 4 GROUP BY item_id) SELECT item_id, round(ln(1 - exp(64 * ln(1 - q) + 128 * ln(1 - 1.0 / 2000))), 6) AS log_q FROM p")
def h16_log_inclusion(spark, d):
    rows = R.signal(V.ratings(spark, d), "positive")
    share = rows.groupBy("item_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("t"))))
    return rounded(share.select("item_id", S.log_inclusion(F.col("n") / F.col("t"), 64, 128, 2000).alias("log_q")))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS double[]), CAST(b.embedding AS double[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1")
def h15_cosine(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b"))
    return rounded(e.join(other, "vec_id").select("vec_id", S.cosine(F.col("embedding"), F.col("b")).alias("cosine")))


# --- serving state and streams ---

STATE = f"""{RT}, h AS (SELECT *, CAST(CASE WHEN g IS NULL THEN 1 ELSE least(32, 2 + floor(log2(g + 1))) END AS integer) AS gap FROM (SELECT user_id, item_id, ts, row_number() OVER w AS pos, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, md5(CAST(user_id AS varchar) || '-' || CAST(item_id AS varchar)) DESC, item_id DESC) AS b,
 ts - lag(ts) OVER w AS g FROM ratings WHERE ts < 883612800 WINDOW w AS (PARTITION BY user_id ORDER BY ts, md5(CAST(user_id AS varchar) || '-' || CAST(item_id AS varchar)), item_id)) q)"""


def old_state(spark, d):
    return Q.load_state(Q.user_sequences(V.ratings(spark, d).where("ts < 883612800")), 20)


@query(f"WITH {STATE} SELECT user_id, array_to_string(list(item_id ORDER BY pos) FILTER (b <= 20), ',') AS recent, array_to_string(list(item_id ORDER BY item_id), ',') AS seen, max(ts) AS last_ts FROM h GROUP BY user_id")
def i4_g4_serving_state(spark, d):
    s = old_state(spark, d)
    return s.select("user_id", F.array_join(F.transform("recent", lambda e: e["token"]), ",").alias("recent"), F.array_join("seen", ",").alias("seen"), "last_ts")


WHOLE = """SELECT *, CAST(rating >= 4 AS integer) AS positive, CAST(CASE WHEN g IS NULL THEN 1 ELSE least(32, 2 + floor(log2(g + 1))) END AS integer) AS gap
 FROM (SELECT *, row_number() OVER w AS pos, ts - lag(ts) OVER w AS g, count(*) OVER (PARTITION BY user_id) AS n, max(ts) OVER (PARTITION BY user_id) AS last_ts FROM {rows}
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, md5(CAST(user_id AS varchar) || '-' || CAST(item_id AS varchar)), item_id)) q"""


@query(f"WITH {RT}, h AS ({WHOLE.format(rows='ratings')}) SELECT user_id, CAST(n - pos + 1 AS integer) AS place, item_id AS token, positive, gap, ts FROM h WHERE pos > n - 20")
def i3_i9_history_view(spark, d):
    """State loaded from the old events, new ones appended, read newest first: gaps and all as from the whole history."""
    new = V.ratings(spark, d).where("ts >= 883612800")
    events = new.select("user_id", F.col("item_id").alias("token"), (F.col("rating") >= S.POSITIVE).cast("int").alias("positive"), "ts", S.tie_key(F.col("user_id"), F.col("item_id")).alias("tie"))
    return Q.history_view(Q.append_events(old_state(spark, d), events, 20))


@query(f"""WITH {RT}, x AS (SELECT * FROM ratings WHERE ts < 883612800 OR item_id % 2 = 0), h AS ({WHOLE.format(rows='x')})
SELECT user_id, array_to_string(list(item_id || ':' || positive || ':' || gap ORDER BY pos) FILTER (pos > n - 20), ',') AS recent, max(n) AS n_seen, max(last_ts) AS last_ts FROM h WHERE user_id IN (SELECT user_id FROM x WHERE ts >= 883612800) GROUP BY user_id""")
def i3_i6_stream_serving(spark, d):
    """State loaded from the old events; new ones come by a stream in four batches, with repeated and late ones and items outside the catalog
    among them, into a keyed table: what readers find equals the state of the whole history of each user of whom an event was taken.

    An event is late only to a user who has a newer one; users of whom all events are refused have no row."""
    top, rows = scratch(spark), stage(V.ratings(spark, d))
    new = rows.where("ts >= 883612800").select("user_id", "item_id", "rating", "ts")
    clock = rows.where("ts < 883612800 or item_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("clock"))
    late = new.select("user_id", (F.col("item_id") % 150 + 1).alias("item_id"), "rating", (F.col("ts") - 100_000_000).alias("ts"))
    late = late.join(clock, "user_id").where("ts < clock").drop("clock")
    third, last = (new.agg(F.percentile_approx("ts", [0.4, 0.8])).first() or [[0, 0]])[0] or (0, 0)
    for part in (new.where(F.col("ts") <= third), new.where((F.col("ts") > third) & (F.col("ts") <= last)), new.where(F.col("ts") > last), new.unionByName(late)):
        part.coalesce(1).write.mode("append").json(f"{top}/in")  # a file a batch, in this order
    events = spark.readStream.schema(SS.EVENT).option("maxFilesPerTrigger", 1).json(f"{top}/in")
    tokens = V.table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("token"))
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    table = KeyedTable(f"{top}/state", "user_id", SV.ORDER, tasks * max(1, rows.count() // (tasks * P.ROWS_PER_TASK)))
    SV.serve_table(events, tokens, 20, table, f"{top}/at", old_state(spark, d)).awaitTermination()
    line = F.transform("recent", lambda e: F.concat_ws(":", e["token"].cast("string"), e["positive"].cast("string"), e["gap"].cast("string")))
    return table.read(spark).where("n_seen > n_loaded").select("user_id", F.array_join(line, ",").alias("recent"), "n_seen", "last_ts")


@query(f"""WITH {EV}, u AS (SELECT DISTINCT user_id, item_id, ts, max(rating) AS rating FROM stream WHERE item_id % 2 = 0 GROUP BY ALL), e AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS t FROM u), w AS (SELECT * FROM e WHERE ts > t - 1800)
SELECT user_id, t AS ts, CAST(count(*) AS double) AS session_n_events, CAST(count(*) FILTER (rating >= 4) AS double) AS session_n_positive, round(avg(rating), 6) AS session_mean_rating,
 CAST(max(ts * 100000 + item_id) % 100000 AS double) AS session_last_item_id, CAST(t AS double) AS session_last_ts FROM w GROUP BY user_id, t""")
def i1_i7_stream_sessions(spark, d):
    """Events replayed through a stream of files into the keyed sink; its last rows equal the batch definition."""
    top = scratch(spark)
    V.event_stream(spark, d).select("user_id", "item_id", "rating", "ts").repartition(4, "user_id").write.json(f"{top}/in")
    catalog = V.table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("item_id"))
    events = spark.readStream.schema(SS.EVENT).json(f"{top}/in")
    table = KeyedTable(f"{top}/out", "user_id", SS.NEWEST, 8)
    asked = SS.stream_sessions(events, catalog).writeStream.foreachBatch(table).option("checkpointLocation", f"{top}/at").trigger(availableNow=True).start()
    asked.awaitTermination()
    return rounded(table.read(spark).drop("item_id"))


# --- evaluation of recommenders ---


def popular() -> X.Scores:
    return X.Scores("popularity", lambda s: R.popularity(s.history))


def recent(days: int) -> X.Scores:
    return X.Scores(f"recent_{days:03d}", lambda s: R.recent_popularity(s.history, s.cutoff, days))


def setup_sql(partition: str) -> str:
    history = "partition = 'train'" if partition == "val" else "partition <> 'test'"
    return f"""{SPLIT}, hist AS (SELECT * FROM split WHERE {history}), later AS (SELECT * FROM split WHERE partition = '{partition}'), cutoff AS (SELECT min(ts) AS c FROM later),
rel AS (SELECT user_id, item_id FROM later WHERE label = 1 AND user_id IN (SELECT user_id FROM hist)), us AS (SELECT DISTINCT user_id FROM rel)"""


def model_sql(name: str, score: str, k: int = 100) -> str:
    """CTEs ``<name>_m``: the row of fit_and_evaluate of a model whose items have the score."""
    return f"""{name}_s AS (SELECT item_id, {score} AS score FROM (SELECT item_id, CAST(count(*) AS double) AS n, count(*) FILTER (ts >= (SELECT c FROM cutoff) - 90 * 86400) AS r90, count(*) FILTER (ts >= (SELECT c FROM cutoff) - 30 * 86400) AS r30,
 count(*) FILTER (ts >= (SELECT c FROM cutoff) - 365 * 86400) AS r365 FROM hist GROUP BY item_id) g),
{name}_l AS (SELECT * FROM (SELECT us.user_id, s.item_id, row_number() OVER (PARTITION BY us.user_id ORDER BY s.score DESC, s.item_id) AS rank FROM us, {name}_s s WHERE NOT EXISTS (SELECT 1 FROM hist t WHERE t.user_id = us.user_id AND t.item_id = s.item_id)) q WHERE rank <= {k}),
{name}_u AS (SELECT rel.user_id, count(*) FILTER (rank <= 10) / CAST(least(10, count(*)) AS double) AS recall_10, count(*) FILTER (rank <= 100) / CAST(least(100, count(*)) AS double) AS recall_100, coalesce(1.0 / min(rank), 0) AS mrr
 FROM rel LEFT JOIN {name}_l l ON rel.user_id = l.user_id AND rel.item_id = l.item_id GROUP BY rel.user_id)"""


def mean_sql(name: str, label: str) -> str:
    return f"SELECT '{label}' AS model, count(*) AS users, round(avg(recall_10), 6) AS recall_10, round(avg(recall_100), 6) AS recall_100, round(avg(mrr), 6) AS mrr, round((SELECT count(DISTINCT item_id) FROM {name}_l WHERE rank <= 10) / (SELECT CAST(count(DISTINCT item_id) AS double) FROM hist), 6) AS coverage FROM {name}_u"


SCORES = {"p": "n", "a": "r30 + n / (max(n) OVER () + 1.0)", "b": "r90 + n / (max(n) OVER () + 1.0)", "c": "r365 + n / (max(n) OVER () + 1.0)"}
SHOWN = ["model", "users", "recall_10", "recall_100", "mrr", "coverage"]


@query(f"WITH {setup_sql('test')} SELECT (SELECT count(*) FROM hist) AS history, (SELECT c FROM cutoff) AS cutoff, (SELECT count(*) FROM rel) AS relevant, (SELECT count(*) FROM hist WHERE user_id IN (SELECT user_id FROM us)) AS excluded, (SELECT count(DISTINCT user_id) FROM later WHERE user_id NOT IN (SELECT user_id FROM hist)) AS cold_users")
def j1_j3_g1_test_setup(spark, d):
    s = X.eval_setup(split_of(spark, d), "test")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(s.history, "history").withColumn("cutoff", F.lit(s.cutoff)).crossJoin(count(s.relevant, "relevant")).crossJoin(count(s.excluded, "excluded")).crossJoin(s.cold)


@query(f"WITH {setup_sql('val')}, {model_sql('p', SCORES['p'])}, {model_sql('b', SCORES['b'])} {mean_sql('p', 'popularity')} UNION ALL {mean_sql('b', 'recent_090')}")
def j10_k10_l1_baselines(spark, d):
    return rounded(X.compare_models([popular(), recent(90)], X.eval_setup(split_of(spark, d), "val")).select(SHOWN))


@query(f"""WITH {setup_sql('val')}, {model_sql('a', SCORES['a'])}, {model_sql('b', SCORES['b'])}, {model_sql('c', SCORES['c'])}, rows AS ({mean_sql('a', 'recent_030')} UNION ALL {mean_sql('b', 'recent_090')} UNION ALL {mean_sql('c', 'recent_365')})
SELECT model, recall_100, row_number() OVER (ORDER BY recall_100 DESC, model) = 1 AS best FROM rows""")
def j11_grid(spark, d):
    return rounded(X.tune([recent(n) for n in (30, 90, 365)], X.eval_setup(split_of(spark, d), "val")).select("model", "recall_100", "best"))


@query(f"WITH {setup_sql('test')}, {model_sql('p', SCORES['p'])}, {model_sql('c', SCORES['c'])} {mean_sql('p', 'popularity')} UNION ALL {mean_sql('c', 'recent_365')}")
def j12_test_period(spark, d):
    return rounded(X.compare_models([popular(), recent(365)], X.eval_setup(split_of(spark, d), "test")).select(SHOWN))


def ridge_model() -> X.Model:
    return X.Ridge("ease")


@query()
def j6_j7_models(spark, d):
    """Neighbours and the ridge through the same evaluation."""
    knn = X.Neighbours("knn", lambda s: R.item_knn(s.history, 50))
    return rounded(X.compare_models([knn, ridge_model()], X.eval_setup(split_of(spark, d), "val")))


@query(f"""WITH {setup_sql('val')}, {model_sql('p', SCORES['p'])}, {model_sql('b', SCORES['b'])}, h AS (SELECT user_id, CASE WHEN count(*) <= 20 THEN '1-20' WHEN count(*) <= 40 THEN '21-40' WHEN count(*) <= 60 THEN '41-60' ELSE '>60' END AS segment FROM hist GROUP BY user_id)
, two AS (SELECT user_id, segment, p_u.recall_100 AS a, b_u.recall_100 AS b FROM p_u JOIN b_u USING (user_id) JOIN h USING (user_id)), {bootstrap_sql("SELECT user_id, segment, b - a AS value FROM two", "segment")}
SELECT segment, users, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, {VERDICT} FROM ci JOIN (SELECT segment, count(*) AS users, avg(a) AS mean_a, avg(b) AS mean_b FROM two GROUP BY segment) g USING (segment) WHERE users >= 30""")
def d25_j30_segment_comparison(spark, d):
    s = X.eval_setup(split_of(spark, d), "val")
    a, b = (E.per_user_metrics(m.lists(s, 100), s.relevant, (100,)).select("user_id", F.col("recall_100").alias(n)) for m, n in ((popular(), "a"), (recent(90), "b")))
    labels = X.history_segments(s.history, [20, 40, 60], ["1-20", "21-40", "41-60", ">60"])
    return rounded(X.segment_table(a.join(b, "user_id"), labels, "a", "b"))


@query()
def d28_interleaving_outcome(spark, d):
    s = X.eval_setup(split_of(spark, d), "val")
    lists = lambda m, name: m.lists(s, 20).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias(name))
    shown = M.interleave(lists(popular(), "a").join(lists(recent(90), "b"), "user_id").withColumnRenamed("user_id", "impression_id"), 10)
    credits = M.credit(shown, s.relevant.select(F.col("user_id").alias("impression_id"), "item_id"))
    return M.interleaving_outcome(credits.withColumnRenamed("impression_id", "user_id"))


@query(f"WITH {RT}, {MV}, {TG}, vocab AS (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) AS tag_index FROM tags WHERE ts < 846720000 GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 50), c AS (SELECT item_id, tag_index, count(*) AS n FROM tags JOIN vocab USING (tag) WHERE ts < 846720000 GROUP BY ALL), t AS (SELECT item_id, array_to_string(list(tag_index ORDER BY n DESC, tag_index), ',') AS tag_ids FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, tag_index) AS r FROM c) q WHERE r <= 8 GROUP BY item_id) SELECT m.item_id, CAST(len(list_filter(genres, lambda g: g IN ('blue', 'rod'))) AS integer) AS n_hot, CAST(coalesce(floor(greatest(0, year - 1870) / 5) + 1, 0) AS integer) AS year_bucket, tag_ids FROM movies m LEFT JOIN t USING (item_id)")
def j20_item_content(spark, d):
    tags = stage(V.clean_tags(V.tags_raw(spark, d)))
    c = Q.item_content(V.movies(spark, d), tags, Q.tag_vocabulary(tags, 846_720_000, 50), 846_720_000, ["blue", "rod"])
    return c.select("item_id", F.aggregate("genre_hot", F.lit(0), lambda s, x: s + x).alias("n_hot"), "year_bucket", F.array_join("tag_ids", ",").alias("tag_ids"))


NEG = unit_sql("'42-' || CAST(user_id AS varchar) || '-' || CAST(item_id AS varchar) || '-' || CAST(k AS varchar)")


@query(f"""WITH {RT}, pos AS (SELECT user_id, item_id FROM ratings WHERE rating >= 4.5), cat AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS token FROM (SELECT DISTINCT item_id FROM ratings) q),
drawn AS (SELECT user_id, 1 + CAST(floor({NEG} * (SELECT count(*) FROM cat)) AS bigint) AS token FROM pos, (SELECT unnest([1, 2]) AS k) x)
SELECT drawn.user_id, cat.item_id, token FROM drawn JOIN cat USING (token) WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.user_id = drawn.user_id AND p.item_id = cat.item_id)""")
def j22_negatives(spark, d):
    rows = stage(V.ratings(spark, d))
    return Q.negatives(rows.where("rating >= 4.5").select("user_id", "item_id"), Q.catalog_tokens(rows), 2).drop("log_q")


@query(f"WITH {RT} SELECT user_id FROM (SELECT DISTINCT user_id FROM ratings) u ORDER BY {HALF}, user_id LIMIT 100")
def j33_request_sample(spark, d):
    return X.sample_requests(V.ratings(spark, d), 100)


@query(f"""WITH {SPLIT}, w AS (SELECT 'reference' AS side, ts FROM split WHERE ts >= (SELECT min(ts) FROM split WHERE partition = 'val') - 90 * 86400 AND partition = 'train' UNION ALL SELECT 'current', ts FROM split WHERE ts > (SELECT max(ts) FROM split) - 90 * 86400)
SELECT side, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM w GROUP BY side""")
def k5_drift_windows(spark, d):
    split = split_of(spark, d)
    reference, current = M.drift_windows(split, cutoff_of(split))
    side = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return side(reference, "reference").unionByName(side(current, "current"))


def ranker_rows(spark, d, n: int = 200):
    """(setup, candidates with the ranker's inputs, their names): ``n`` candidates a user from recent popularity."""
    split, train = train_of(spark, d)
    s, movies = X.eval_setup(split, "val"), V.movies(spark, d)
    rows = R.candidates(recent(90).lists(s, n), s.relevant)
    made = R.ranker_features(rows, P.snapshots(train, P.standard("user")), P.snapshots(train, P.standard("item")), R.user_profiles(train, movies, V.GENRES), movies, s.cutoff, V.GENRES)
    keys = {"user_id", "item_id", "label", "n_relevant"}
    return s, stage(made), [c for c in made.columns if c not in keys and c != "retrieval_rank"]


def ranker_parts(spark, d):
    """(setup, features, rows to train on, rows to judge by): a user is in one of them, by hashes; features are one vector. Of the rows to train on, ``inner`` marks those to tune on."""
    s, rows, features = ranker_rows(spark, d)
    draw = lambda salt: S.unit(42, F.lit(salt), F.col("user_id"))
    part = F.when(draw("eval") < 0.5, "eval").when(draw("inner") < 0.2, "inner").otherwise("fit")
    wide = stage(G.vectors(rows, features, rows.where(part == "fit")).withColumn("part", part))
    return s, features, wide.where("part <> 'eval'").withColumn("inner", F.col("part") == "inner").drop("part"), wide.where("part = 'eval'").drop("part")


#: (trees, share of users) of each round of tuning.
RUNGS = [(4, 0.25), (8, 0.5), (16, 1.0)]


def search(s: X.Setup, rows, n_settings: int = 8):
    """(best setting, trials): settings drawn and halved in rounds."""
    return G.halving(rows, F.col("inner"), s.relevant, G.draw_settings(n_settings), RUNGS)


def tuned_ranker(spark, d):
    """(setup, features, rows to judge by, ranker of the best setting, fitted with early stopping)."""
    s, features, rows, judged = ranker_parts(spark, d)
    return s, features, judged, G.fit_ranker(rows, F.col("inner"), search(s, rows)[0])


@query()
def j26_ranker_tuning(spark, d):
    """Trials of a search over eight settings: which were left out in which round, by the NDCG@10 of users not fitted on."""
    s, _, rows, _ = ranker_parts(spark, d)
    return rounded(search(s, rows)[1])  # no ranker is fitted for its trials


#: A setting of the ranker where none is searched for.
SETTING = {"maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 20}


def fixed_ranker(spark, d):
    """(setup, features, rows to judge by, ranker fitted with early stopping)."""
    s, features, rows, judged = ranker_parts(spark, d)
    return s, features, judged, G.fit_ranker(rows, F.col("inner"), SETTING)


def compared_systems(spark, d, tuned: bool = False) -> tuple[X.Setup, dict]:
    """Lists of three systems for the users that the ranker is judged by: the ridge, retrieval, and retrieval put in order by the ranker."""
    s, _, judged, model = (tuned_ranker if tuned else fixed_ranker)(spark, d)
    users = stage(s.users.join(judged.select("user_id").distinct(), "user_id", "left_semi"))
    theirs = X.Setup(s.history, s.cutoff, stage(s.relevant.join(users, "user_id", "left_semi")), stage(s.excluded.join(users, "user_id", "left_semi")), s.cold)
    retrieval = judged.select("user_id", "item_id", F.col("retrieval_rank").alias("rank")).where("rank <= 100")
    return theirs, {"ridge": stage(ridge_model().lists(theirs, 100)), "retrieval": stage(retrieval), "ranker": stage(G.ranked(model, judged).where("rank <= 100"))}


@query()
def j29_three_systems(spark, d):
    """Mean metrics of three systems over the same users, the ranker tuned."""
    s, lists = compared_systems(spark, d, tuned=True)
    return rounded(X.system_table(lists, s.relevant))


@query()
def c5_paired_systems(spark, d):
    """Each pair of the three systems: mean difference of NDCG@10 over users, its interval and verdict."""
    s, lists = compared_systems(spark, d)
    return rounded(X.paired_systems(lists, s.relevant, "ndcg_10"))


@query()
def j32_three_variants(spark, d):
    """The ten items that each of three systems shows each user."""
    _, lists = compared_systems(spark, d)
    return X.variants(lists, 10)


@query()
def j25_j29_two_stage(spark, d):
    """Lift of the ranker over the retrieval order, on users that it wasn't fitted on."""
    s, _, judged, model = fixed_ranker(spark, d)
    users = s.relevant.join(judged.select("user_id").distinct(), "user_id", "left_semi")
    before = E.per_user_metrics(judged.select("user_id", "item_id", F.col("retrieval_rank").alias("rank")), users, (10,))
    return rounded(E.paired_difference(stage(before), stage(E.per_user_metrics(G.ranked(model, judged), users, (10,))), "ndcg_10"))


@query()
def j28_importances(spark, d):
    """Mean absolute contribution of each feature to the ranker's margin over all candidates of the users that it is judged by."""
    _, features, rows, judged = ranker_parts(spark, d)
    model = G.fit_ranker(rows, F.col("inner"), {"maxDepth": 5, "stepSize": 0.1}, 20)
    return rounded(G.importances(model, judged, features))


@query(f"""WITH {setup_sql('val')}, {model_sql('b', SCORES['b'], 200)} SELECT count(*) AS rows, 0 AS off FROM b_l WHERE rank <= 200 AND {unit_sql("'42-eval-' || CAST(user_id AS varchar)")} < 0.5""")
def j28_contributions_add_up(spark, d):
    """Candidates whose contributions and bias don't sum to the margin that the ranker gives."""
    _, _, rows, judged = ranker_parts(spark, d)
    model = G.fit_ranker(rows, F.col("inner"), {"maxDepth": 4, "stepSize": 0.1}, 10)
    made = G.contributions(model, model.transform(judged))
    margin = F.aggregate("contributions", F.col("bias"), lambda t, c: t + c)
    return made.agg(F.count("*").alias("rows"), F.count_if(F.abs(margin - vector_to_array("rawPrediction")[1]) > 1e-9).alias("off"))


@query(f"""WITH {setup_sql('val')}, {model_sql('p', SCORES['p'])} SELECT 'popular' AS variant, user_id, item_id, CAST(rank AS integer) AS rank FROM p_l WHERE rank <= 10
UNION ALL SELECT 'reranked', user_id, item_id, CAST(rank AS integer) FROM (SELECT l.user_id, l.item_id, row_number() OVER (PARTITION BY l.user_id ORDER BY coalesce(g.r, 0) DESC, l.rank) AS rank FROM p_l l LEFT JOIN (SELECT item_id, count(*) AS r FROM hist WHERE ts >= (SELECT c FROM cutoff) - 90 * 86400 GROUP BY item_id) g USING (item_id) WHERE l.rank <= 50) q WHERE rank <= 10""")
def j32_variants(spark, d):
    """Lists of two systems from one pass over the candidates."""
    s = X.eval_setup(split_of(spark, d), "val")
    rows = stage(popular().lists(s, 50).withColumnRenamed("rank", "retrieval_rank"))
    late = s.history.where(F.col("ts") >= s.cutoff - 90 * S.DAY_SECONDS).groupBy("item_id").agg(F.count("*").alias("r"))
    again = R.rerank(rows.drop("score").join(late, "item_id", "left").withColumn("score", F.coalesce("r", F.lit(0))), "score", 10)
    name = lambda df, v: df.select(F.lit(v).alias("variant"), "user_id", "item_id", "rank")
    return name(rows.withColumnRenamed("retrieval_rank", "rank").where("rank <= 10"), "popular").unionByName(name(again, "reranked"))
