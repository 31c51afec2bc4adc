"""Registry of queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import evaluation as E
from tidemark.operators import features as P
from tidemark.operators import monitoring as M
from tidemark.operators import ranker_inputs as RI
from tidemark.operators import recommend as R
from tidemark.operators import sequences as Q
from tidemark.operators import splits as T
from tidemark.operators import vector_index as I
from tidemark.operators.pairs import co_occurrence
from tidemark.operators.ridge import ease
from tidemark.plans import views as V
from tidemark.sources.stages import stage
from tidemark.streaming import sessions as SS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function as a query; SQL starts with the views that it names between braces."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


RT, MV, TG, EV = V.RATINGS_SQL, V.MOVIES_SQL, V.TAGS_SQL, V.EVENTS_SQL
STATS = "(SELECT ts AS t1 FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM ratings) q WHERE rn = CAST(floor({q} * (n - 1)) AS bigint) + 1)"
SPLIT = f"""{RT}, cuts AS (SELECT a.t1 AS t1, b.t1 AS t2 FROM {STATS.format(q="CAST(0.8999999999999999 AS double)")} a, {STATS.format(q="CAST(0.95 AS double)")} b),
split AS (SELECT r.*, CAST(rating >= 4.0 AS tinyint) AS label, CASE WHEN ts < t1 THEN 'train' WHEN ts < t2 THEN 'val' ELSE 'test' END AS partition FROM ratings r, cuts)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def split_of(spark: SparkSession, d: str) -> DataFrame:
    """The split ratings, made once: all branches of a query read the same written table."""
    return stage(T.temporal_split(stage(V.ratings(spark, d))))


@query(f"WITH {RT} SELECT * FROM ratings")
def a5_ratings(spark, d):
    return V.ratings(spark, d)


@query(f"WITH {MV} SELECT item_id, title, CAST(year AS double) AS year, array_to_string(genres, '|') AS genres, CAST(len(genres) AS integer) AS n_genres, genres[1] AS first_genre FROM movies")
def a2_movies(spark, d):
    return V.movies(spark, d).select("item_id", "title", F.col("year").cast("double").alias("year"), F.array_join("genres", "|").alias("genres"), F.size("genres").alias("n_genres"), F.get("genres", F.lit(0)).alias("first_genre"))


@query(f"WITH {RT}, {TG} SELECT * FROM tags")
def a3_tags(spark, d):
    return V.clean_tags(V.tags_raw(spark, d))


@query(f"""WITH {RT} SELECT 'item_id' AS rule, CAST(count(*) FILTER (NOT item_id >= 0) AS bigint) AS violations FROM ratings UNION ALL SELECT 'rating', count(*) FILTER (NOT (rating BETWEEN 0.5 AND 5.0 AND rating * 2 = floor(rating * 2))) FROM ratings
UNION ALL SELECT 'ts', count(*) FILTER (NOT ts >= 0) FROM ratings UNION ALL SELECT 'user_id', count(*) FILTER (NOT user_id >= 0) FROM ratings""")
def b1_expectations(spark, d):
    return T.expectations(V.ratings(spark, d), T.RATING_RULES)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def b2_repeated_keys(spark, d):
    return V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {SPLIT} SELECT * FROM split")
def b4_temporal_split(spark, d):
    return split_of(spark, d)


@query(f"WITH {RT} SELECT * FROM ratings WHERE ((((((user_id + ((42::hugeint * 2654435769) % 4294967296)) % 4294967296) * 2654435761::hugeint) % 4294967296) // 65536) % 100) < 10")
def b6_user_sample(spark, d):
    return T.sample_users(V.ratings(spark, d), 10)


@query(f"""WITH {SPLIT}, w AS (SELECT DISTINCT user_id FROM split WHERE partition = 'train'), i AS (SELECT DISTINCT item_id FROM split WHERE partition = 'train')
SELECT partition, count(*) AS n_rows, CAST(sum(label) AS bigint) AS n_positive, count(DISTINCT s.user_id) AS n_users, count(DISTINCT s.item_id) AS n_items, min(ts) AS start_ts, max(ts) AS end_ts,
count(DISTINCT CASE WHEN w.user_id IS NULL THEN s.user_id END) AS cold_users, count(DISTINCT CASE WHEN i.item_id IS NULL THEN s.item_id END) AS new_items,
count(*) FILTER (w.user_id IS NOT NULL AND label = 1) AS warm_positives FROM split s LEFT JOIN w ON s.user_id = w.user_id LEFT JOIN i ON s.item_id = i.item_id GROUP BY partition""")
def d8_split_statistics(spark, d):
    return T.split_statistics(split_of(spark, d))


@query(f"WITH {RT} SELECT t1.t1 AS t1, t2.t1 AS t2 FROM {STATS.format(q='CAST(0.8999999999999999 AS double)')} t1, {STATS.format(q='CAST(0.95 AS double)')} t2")
def d13_cut_points(spark, d):
    rows = stage(V.ratings(spark, d).select("ts"))  # read by four passes
    return spark.range(1).select(F.lit(T.order_statistic(rows, "ts", 1 - 0.05 - 0.05)).cast("bigint").alias("t1"), F.lit(T.order_statistic(rows, "ts", 0.95)).cast("bigint").alias("t2"))


@query(f"WITH {RT}, m AS (SELECT p_partkey FROM part WHERE p_size > 10) SELECT 'kept' AS side, count(*) AS n FROM ratings SEMI JOIN m ON item_id = p_partkey UNION ALL SELECT 'orphans', count(*) FROM ratings ANTI JOIN m ON item_id = p_partkey")
def c1_c2_orphans(spark, d):
    known = V.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("item_id"))
    rows = V.ratings(spark, d)
    count = lambda how, name: rows.join(known, "item_id", how).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return count("left_semi", "kept").unionByName(count("left_anti", "orphans"))


def snapshot_sql(key: str, p: str, from_day: int | None = None) -> str:
    lo = f"WHERE s >= {from_day}" if from_day is not None else ""
    edge = f"UNION SELECT DISTINCT {key}, {from_day} FROM ev WHERE day < {from_day}" if from_day is not None else ""
    agg = lambda expr, w: f"(SELECT {expr} FROM ev e WHERE e.{key} = d.{key} AND e.day < d.s{f' AND e.day >= d.s - {w}' if w else ''})"
    return f"""WITH {RT}, ev AS (SELECT *, CAST(floor(ts / 86400) AS bigint) AS day FROM ratings), act AS (SELECT DISTINCT {key}, day FROM ev),
due AS (SELECT * FROM (SELECT {key}, day + 1 AS s FROM act UNION SELECT {key}, day + 8 FROM act UNION SELECT {key}, day + 31 FROM act) x {lo} {edge}),
f AS (SELECT d.{key}, d.s AS snapshot_day, count(e.ts) AS n, count(e.ts) FILTER (e.rating >= 4) AS np, coalesce(sum(e.rating), 0.0) AS rs, count(e.ts) FILTER (e.day >= d.s - 7) AS n7,
 count(e.ts) FILTER (e.day >= d.s - 30) AS n30, min(e.ts) AS ft, max(e.ts) AS lt FROM due d LEFT JOIN ev e ON e.{key} = d.{key} AND e.day < d.s GROUP BY d.{key}, d.s)
SELECT {key}, snapshot_day, n AS {p}_n_ratings, np AS {p}_n_positive, rs AS {p}_rating_sum, n7 AS {p}_n_ratings_7d, n30 AS {p}_n_ratings_30d, ft AS {p}_first_ts, lt AS {p}_last_ts,
round((rs + 17.5) / (n + 5.0), 6) AS {p}_mean_rating, round((np + 2.5) / (n + 5.0), 6) AS {p}_positive_rate FROM f"""


@query(snapshot_sql("item_id", "item"))
def e2_item_snapshots(spark, d):
    return rounded(P.snapshots(stage(V.ratings(spark, d)), P.standard("item")).drop("event_timestamp"))


@query(snapshot_sql("user_id", "user", 9800))
def e2_user_snapshots_from_day(spark, d):
    return rounded(P.snapshots(stage(V.ratings(spark, d)), P.standard("user"), 9800).drop("event_timestamp"))


@query(f"""WITH {RT}, ev AS (SELECT *, CAST(floor(ts / 86400) AS bigint) AS day FROM ratings), snap AS (SELECT item_id, day + 1 AS s, sum(n) OVER (PARTITION BY item_id ORDER BY day) AS n_before FROM (SELECT item_id, day, count(*) AS n FROM ev GROUP BY ALL) q)
SELECT ev.user_id, ev.item_id, ev.ts, CAST(n_before AS double) AS n_before FROM ev ASOF LEFT JOIN snap ON ev.item_id = snap.item_id AND ev.day >= snap.s""")
def c7_as_of_join(spark, d):
    rows = V.ratings(spark, d).withColumn("day", S.day_of(F.col("ts")))
    total = F.sum("n").over(Window.partitionBy("item_id").orderBy("day"))
    snaps = rows.groupBy("item_id", "day").agg(F.count("*").alias("n")).select("item_id", (F.col("day") + 1).alias("s"), total.alias("n_before"))
    return P.as_of_join(rows, snaps, "item_id", "day", "s", ["n_before"]).select("user_id", "item_id", "ts", F.col("n_before").cast("double").alias("n_before"))


@query(f"""WITH {RT}, ev AS (SELECT *, CAST(floor(ts / 86400) AS bigint) AS day FROM ratings), u AS (SELECT user_id, max(day) + 1 AS snapshot_day, count(*) AS user_n_ratings FROM ev WHERE day < 9800 GROUP BY user_id)
SELECT k.c_custkey AS user_id, CAST(user_n_ratings AS double) AS user_n_ratings FROM customer k LEFT JOIN u ON k.c_custkey = u.user_id""")
def a16_a17_online_lookup(spark, d):
    snaps = P.snapshots(stage(V.ratings(spark, d)), P.standard("user"))
    online = P.latest_per_key(snaps, "user_id", "event_timestamp", F.timestamp_seconds(F.lit(9800 * 86400)))
    keys = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return P.online_lookup(keys, online, "user_id", ["user_n_ratings"]).withColumn("user_n_ratings", F.col("user_n_ratings").cast("double"))


@query(f"WITH {RT} SELECT item_id, count(*) AS n, count(*) FILTER (rating >= 4) AS n_positive, round(count(*) / CAST(sum(count(*)) OVER () AS double), 9) AS share, round((count(*) FILTER (rating >= 4) + 1) / CAST(sum(count(*) FILTER (rating >= 4) + 1) OVER () AS double), 9) AS positive_share FROM ratings GROUP BY item_id")
def d4_d6_d34_popularity(spark, d):
    c = V.ratings(spark, d).groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(F.col("rating") >= 4).alias("n_positive"))
    t = c.agg(F.sum("n").alias("t"), F.sum(F.col("n_positive") + 1).alias("tp"))
    return c.crossJoin(F.broadcast(t)).select("item_id", "n", "n_positive", F.round(F.col("n") / F.col("t"), 9).alias("share"), F.round((F.col("n_positive") + 1) / F.col("tp"), 9).alias("positive_share"))


TRAIN = f"{SPLIT}, train AS (SELECT * FROM split WHERE partition = 'train')"


def train_of(spark, d):
    split = split_of(spark, d)
    return split, split.where("partition = 'train'")


def cutoff_of(split: DataFrame) -> int:
    return split.where("partition = 'val'").agg(F.min("ts")).first()[0]


@query(f"""WITH {TRAIN}, c AS (SELECT item_id, count(*) FILTER (ts >= (SELECT min(ts) FROM split WHERE partition = 'val') - 90 * 86400) AS r, count(*) AS n FROM train GROUP BY item_id)
SELECT item_id, round(r + n / (max(n) OVER () + 1.0), 9) AS score FROM c""")
def d5_recent_popularity(spark, d):
    split, train = train_of(spark, d)
    return rounded(R.recent_popularity(train, cutoff_of(split)), 9)


USERS = "u AS (SELECT DISTINCT s.user_id FROM split s WHERE partition = 'val' AND label = 1 AND user_id IN (SELECT user_id FROM train))"
POPULAR = f"""{TRAIN}, {USERS}, p AS (SELECT item_id, CAST(count(*) AS double) AS score FROM train GROUP BY item_id),
recs AS (SELECT * FROM (SELECT u.user_id, p.item_id, p.score, row_number() OVER (PARTITION BY u.user_id ORDER BY p.score DESC, p.item_id) AS rank
 FROM u, p WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = p.item_id)) q WHERE rank <= 100),
relevant AS (SELECT user_id, item_id FROM split WHERE partition = 'val' AND label = 1 AND user_id IN (SELECT user_id FROM u))"""


def popular_lists(spark, d, k: int = 100):
    split, train = train_of(spark, d)
    relevant, excluded, _ = R.targets(split.where("partition = 'val'"), train)
    recs = R.popular_unseen(R.popularity(train), relevant.select("user_id").distinct(), excluded, k)
    return split, train, relevant, excluded, recs


@query(f"WITH {POPULAR} SELECT user_id, item_id, score, CAST(rank AS integer) AS rank FROM recs")
def j4_popular_unseen(spark, d):
    return popular_lists(spark, d)[4].select("user_id", "item_id", "score", "rank")


METRICS = f"""{POPULAR}, hit AS (SELECT r.user_id, r.item_id, rank FROM relevant r LEFT JOIN recs c ON r.user_id = c.user_id AND r.item_id = c.item_id),
m AS (SELECT user_id, count(*) AS n_relevant, count(*) FILTER (rank <= 10) / CAST(least(10, count(*)) AS double) AS recall_10, count(*) FILTER (rank <= 100) / CAST(least(100, count(*)) AS double) AS recall_100,
 coalesce(sum(1 / log2(rank + 1.0)) FILTER (rank <= 10), 0) / list_sum(list_transform(range(1, least(10, count(*)) + 1), lambda r: 1 / log2(r + 1.0))) AS ndcg_10,
 coalesce(sum(1 / log2(rank + 1.0)) FILTER (rank <= 100), 0) / list_sum(list_transform(range(1, least(100, count(*)) + 1), lambda r: 1 / log2(r + 1.0))) AS ndcg_100,
 coalesce(1.0 / min(rank), 0) AS mrr FROM hit GROUP BY user_id)"""


@query(f"WITH {METRICS} SELECT user_id, n_relevant, round(CAST(recall_10 AS double), 6) AS recall_10, round(CAST(recall_100 AS double), 6) AS recall_100, round(CAST(ndcg_10 AS double), 6) AS ndcg_10, round(CAST(ndcg_100 AS double), 6) AS ndcg_100, round(CAST(mrr AS double), 6) AS mrr FROM m")
def d14_d17_user_metrics(spark, d):
    _, _, relevant, _, recs = popular_lists(spark, d)
    return rounded(E.per_user_metrics(recs, relevant))


def bootstrap_sql(rows: str, by: str = "metric") -> str:
    """CTE ``ci`` (metric, n, mean, low, high) of the rows (user_id, metric, value)."""
    u = "CAST('0x' || substr(md5('42-' || CAST(user_id AS varchar) || '-' || CAST(r // 4 AS varchar)), CAST(1 + 8 * (r % 4) AS integer), 8) AS bigint) / 4294967296.0"
    steps = " + ".join(f"CAST(u >= CAST({e} AS double) AS integer)" for e in E.POISSON)
    return f"""bv AS ({rows}), bw AS (SELECT user_id, r, {steps} AS w FROM (SELECT user_id, r, {u} AS u FROM (SELECT DISTINCT user_id FROM bv) bu, range(1000) t(r)) bd),
br AS (SELECT {by}, r, sum(w * value) / nullif(sum(w) FILTER (value IS NOT NULL), 0) AS m FROM bv JOIN bw USING (user_id) GROUP BY {by}, r),
ci AS (SELECT * FROM (SELECT {by}, count(value) AS n, avg(value) AS mean FROM bv GROUP BY {by}) bm JOIN (SELECT {by}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM br GROUP BY {by}) be USING ({by}))"""


CI = ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "low", "high"))
VERDICT = "CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'tie' END AS verdict"
MEASURED = ["recall_10", "recall_100", "ndcg_10", "mrr"]


@query(f"WITH {METRICS}, {bootstrap_sql(' UNION ALL '.join(f'SELECT user_id, {chr(39)}{m}{chr(39)} AS metric, CAST({m} AS double) AS value FROM m' for m in MEASURED))} SELECT metric, n, {CI} FROM ci")
def d18_d20_bootstrap(spark, d):
    _, _, relevant, _, recs = popular_lists(spark, d)
    return rounded(E.bootstrap(E.per_user_metrics(recs, relevant), MEASURED))


@query(f"""WITH {POPULAR}, c AS (SELECT i.item_id, count(r.user_id) AS c FROM (SELECT DISTINCT item_id FROM train) i LEFT JOIN (SELECT * FROM recs WHERE rank <= 10) r ON i.item_id = r.item_id GROUP BY i.item_id),
o AS (SELECT c, row_number() OVER (ORDER BY c) AS k, count(*) OVER () AS n, sum(c) OVER () AS t FROM c)
SELECT round(CAST((SELECT count(*) FROM c WHERE c > 0) / CAST((SELECT count(*) FROM c) AS double) AS double), 9) AS coverage, round(CAST((SELECT 2 * sum(c * k) / CAST(max(n) * max(t) AS double) - (max(n) + 1.0) / max(n) FROM o) AS double), 9) AS gini""")
def d9_d10_coverage_gini(spark, d):
    _, train, _, _, recs = popular_lists(spark, d)
    items = train.select("item_id").distinct()
    return rounded(E.coverage(recs, items, 10).crossJoin(E.gini(recs, items, 10)), 9)


@query(f"WITH {POPULAR} SELECT user_id, round(avg(p.score / (SELECT count(*) FROM train)), 9) AS arp FROM recs JOIN p USING (item_id) WHERE rank <= 10 GROUP BY user_id")
def d11_average_popularity(spark, d):
    _, train, _, _, recs = popular_lists(spark, d)
    return rounded(E.average_popularity(recs, train, 10), 9)


@query(f"""WITH {POPULAR} SELECT r.user_id, r.item_id, CAST(r.score AS float) AS retrieval_score, CAST(rank AS integer) AS retrieval_rank, CAST(v.item_id IS NOT NULL AS tinyint) AS label, n AS n_relevant
FROM recs r JOIN (SELECT user_id, count(*) AS n FROM relevant GROUP BY user_id) k USING (user_id) LEFT JOIN relevant v ON r.user_id = v.user_id AND r.item_id = v.item_id""")
def j19_candidates(spark, d):
    _, _, relevant, _, recs = popular_lists(spark, d)
    return R.candidates(recs, relevant)


KNN = f"""{RT}, n AS (SELECT item_id, sqrt(count(*)) AS norm FROM ratings GROUP BY item_id), co AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS c FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL),
sim AS (SELECT i AS item_id, j AS other, c / (x.norm * y.norm + 10.0) AS similarity FROM co JOIN n x ON x.item_id = i JOIN n y ON y.item_id = j)"""


@query(f"WITH {KNN}, top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, other) AS rn FROM sim) SELECT item_id, other, round(similarity, 9) AS similarity FROM top WHERE rn <= 20")
def j6_item_knn(spark, d):
    return R.item_knn(stage(V.ratings(spark, d)), 20)


@query(f"WITH {RT} SELECT a.item_id AS i, b.item_id AS j, count(*) AS n FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY ALL")
def c12_co_occurrence(spark, d):
    return co_occurrence(stage(V.ratings(spark, d)))  # read by several steps


@query()
def j7_ease(spark, d):
    """The strongest 20 weights of each target item."""
    return rounded(E.top_k(rounded(ease(V.ratings(spark, d), keep=20), 9), 20, "other", "similarity", "item_id"), 6)


@query()
def j8_implicit_als(spark, d):
    split, train = train_of(spark, d)
    relevant, _, _ = R.targets(split.where("partition = 'val'"), train)
    return R.implicit_als(train, relevant.select("user_id").distinct(), 20, maxIter=15)


@query("""SELECT query_id, vec_id, CAST(rank AS integer) AS rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(CAST(q.embedding AS double[]), CAST(v.embedding AS double[])) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS double[]), CAST(v.embedding AS double[])), 9) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 10 = 0 AND v.vec_id % 10 <> 0) x WHERE rank <= 10""")
def j14_exact_inner_product(spark, d):
    vectors, queries = searches(spark, d)
    asked = queries.select(F.col("query_id").alias("user_id"), F.transform("q", lambda x: x.cast("double")).alias("vector"))
    none = asked.select("user_id", F.col("user_id").alias("item_id")).limit(0)
    found = R.vector_lists(asked, vectors.withColumnRenamed("vec_id", "item_id"), none, 10)
    return rounded(found.select(F.col("user_id").alias("query_id"), F.col("item_id").alias("vec_id"), "rank", "score"))


@query(f"""WITH {RT}, o AS (SELECT *, md5(CAST(user_id AS varchar) || '-' || CAST(item_id AS varchar)) AS tie, row_number() OVER w AS pos, ts - lag(ts) OVER w AS gap FROM ratings WINDOW w AS (PARTITION BY user_id ORDER BY ts, md5(CAST(user_id AS varchar) || '-' || CAST(item_id AS varchar)), item_id))
SELECT user_id, CAST(pos AS integer) AS pos, item_id, item_id AS token, CAST(rating >= 4 AS integer) AS positive, CAST(CASE WHEN gap IS NULL THEN 1 ELSE least(32, 2 + floor(log2(gap + 1))) END AS integer) AS gap, ts FROM o""")
def e5_e6_sequences(spark, d):
    return Q.user_sequences(V.ratings(spark, d))


@query(f"""WITH {RT}, o AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, md5(CAST(user_id AS varchar) || '-' || CAST(item_id AS varchar)) DESC, item_id DESC) AS b FROM ratings)
SELECT user_id, array_to_string(list_concat(list_transform(range(20 - count(*)), lambda x: 0), list(item_id ORDER BY b DESC)), ',') AS tokens FROM o WHERE b <= 20 GROUP BY user_id""")
def e7_e11_last_events(spark, d):
    return Q.last_events(Q.user_sequences(V.ratings(spark, d)), 20).select("user_id", F.array_join("tokens", ",").alias("tokens"))


@query(f"WITH {RT} SELECT item_id, row_number() OVER (ORDER BY item_id) AS token FROM (SELECT DISTINCT item_id FROM ratings) q")
def c15_catalog_tokens(spark, d):
    return Q.catalog_tokens(V.ratings(spark, d))


TAGS = f"{RT}, {TG}, vocab AS (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) AS tag_index FROM tags WHERE ts < 846720000 GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 50)"


@query(f"WITH {TAGS} SELECT tag, CAST(tag_index AS integer) AS tag_index FROM vocab")
def d23_tag_vocabulary(spark, d):
    return Q.tag_vocabulary(V.clean_tags(V.tags_raw(spark, d)), 846_720_000, 50)


@query(f"""WITH {TAGS}, c AS (SELECT item_id, tag_index, count(*) AS n FROM tags JOIN vocab USING (tag) WHERE ts < 846720000 GROUP BY ALL)
SELECT item_id, array_to_string(list(tag_index ORDER BY n DESC, tag_index), ',') AS tag_ids FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, tag_index) AS r FROM c) q WHERE r <= 8 GROUP BY item_id""")
def d24_top_tags(spark, d):
    tags = V.clean_tags(V.tags_raw(spark, d))
    return Q.top_tags(tags, Q.tag_vocabulary(tags, 846_720_000, 50), 846_720_000).select("item_id", F.array_join("tag_ids", ",").alias("tag_ids"))


@query(f"""WITH {EV} SELECT event_id, CAST(count(*) OVER w AS bigint) AS session_n_events, CAST(count(*) FILTER (rating >= 4) OVER w AS bigint) AS session_n_positive, round(avg(rating) OVER w, 6) AS session_mean_rating,
 CAST(max(ts * 100000 + item_id) OVER w % 100000 AS bigint) AS session_last_item_id, max(ts) OVER w AS session_last_ts
FROM stream WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 1799 PRECEDING AND CURRENT ROW)""")
def e4_rolling_sessions(spark, d):
    return rounded(SS.rolling_sessions(V.event_stream(spark, d)).drop("user_id", "item_id", "rating", "ts"))


@query("SELECT event_type AS stage, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max_ms FROM events GROUP BY event_type")
def d31_latency_percentiles(spark, d):
    r = M.latency_percentiles(V.table(spark, d, "events"), "event_type", "value")
    return r.select("stage", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "max_ms")


@query("SELECT event_type AS stage, CAST(le AS double) AS le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0]) AS le) e GROUP BY ALL")
def d32_latency_histogram(spark, d):
    return M.latency_histogram(V.table(spark, d, "events"), "event_type", "value", [1, 5, 10, 50, 100])


@query(f"WITH {RT}, {MV}, x AS (SELECT user_id, avg(year) AS y FROM ratings JOIN movies USING (item_id) GROUP BY user_id) SELECT user_id, round(y, 6) AS user_mean_year FROM x")
def d22_mean_year(spark, d):
    return rounded(R.user_profiles(V.ratings(spark, d), V.movies(spark, d), V.GENRES).select("user_id", "user_mean_year"))


@query(f"""WITH {RT}, {MV}, g AS (SELECT user_id, unnest(genres) AS g FROM ratings JOIN movies USING (item_id) WHERE rating >= 4), c AS (SELECT user_id, g, count(*) AS n FROM g GROUP BY ALL)
SELECT user_id, g AS genre, round(n / sqrt(sum(n * n) OVER (PARTITION BY user_id)), 6) AS weight FROM c""")
def d21_genre_profile(spark, d):
    p = R.user_profiles(V.ratings(spark, d), V.movies(spark, d), V.GENRES)
    rows = p.select("user_id", F.posexplode("user_genres").alias("i", "weight")).where("weight > 0")
    return rounded(rows.select("user_id", F.element_at(F.array(*map(F.lit, V.GENRES)), F.col("i") + 1).alias("genre"), "weight"))


@query(f"""WITH {RT}, h AS (SELECT user_id, count(*) AS n, max(ts) AS last_ts FROM ratings GROUP BY user_id) SELECT CASE WHEN n <= 20 THEN '1-20' WHEN n <= 40 THEN '21-40' WHEN n <= 60 THEN '41-60' ELSE '>60' END AS bucket, count(*) AS users, round(avg(n), 6) AS mean_n, max(last_ts) AS last_ts FROM h GROUP BY 1""")
def d25_d26_segments(spark, d):
    h = V.ratings(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    b = S.label_bucket(F.col("n"), [20, 40, 60], ["1-20", "21-40", "41-60", ">60"])
    return rounded(h.groupBy(b.alias("bucket")).agg(F.count("*").alias("users"), F.avg("n").alias("mean_n"), F.max("last_ts").alias("last_ts")))


@query()
def j23_ranker_features(spark, d):
    split, train, relevant, _, recs = popular_lists(spark, d)
    movies = V.movies(spark, d)
    rows = R.candidates(recs, relevant)
    return R.ranker_features(rows, P.snapshots(train, P.standard("user")), P.snapshots(train, P.standard("item")), R.user_profiles(train, movies, V.GENRES), movies, cutoff_of(split), V.GENRES)


PARITY_SQL = f"""WITH {POPULAR}, {MV}, c AS (SELECT user_id, item_id, CAST(score AS float) AS score, rank FROM recs UNION ALL SELECT -1 - user_id, item_id, CAST(score AS float), rank FROM recs),
b AS (SELECT floor(min(ts) / 86400) AS d, min(ts) AS t FROM split WHERE partition = 'val'),
past AS (SELECT train.*, d - floor(ts / 86400) AS ago FROM train, b WHERE floor(ts / 86400) < d),
us AS (SELECT user_id, count(*) AS n, (count(*) FILTER (rating >= 4) + 2.5) / (count(*) + 5.0) AS pr, (sum(rating) + 17.5) / (count(*) + 5.0) AS mr, count(*) FILTER (ago <= 30) AS n30, min(ts) AS ft, max(ts) AS lt FROM past GROUP BY user_id),
it AS (SELECT item_id, count(*) AS n, (count(*) FILTER (rating >= 4) + 2.5) / (count(*) + 5.0) AS pr, (sum(rating) + 17.5) / (count(*) + 5.0) AS mr, count(*) FILTER (ago <= 7) AS n7, count(*) FILTER (ago <= 30) AS n30,
 min(ts) AS ft, max(ts) AS lt FROM past GROUP BY item_id),
y AS (SELECT user_id, avg(year) AS mean_year FROM train JOIN movies USING (item_id) GROUP BY user_id),
w AS (SELECT user_id, g, n / sqrt(sum(n * n) OVER (PARTITION BY user_id)) AS w FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, unnest(genres) AS g FROM train JOIN movies USING (item_id) WHERE rating >= 4) q GROUP BY ALL) r),
ig AS (SELECT DISTINCT item_id, unnest(genres) AS g FROM movies), ng AS (SELECT item_id, (SELECT count(*) FROM ig WHERE ig.item_id = m.item_id) AS n FROM movies m),
dot AS (SELECT c.user_id, c.item_id, sum(w.w) AS p FROM c JOIN ig USING (item_id) JOIN w ON w.user_id = c.user_id AND w.g = ig.g GROUP BY ALL),
made AS (SELECT CAST(c.score AS double) AS retrieval_score, CAST(rank AS double) AS retrieval_rank, us.pr AS user_positive_rate, us.mr AS user_mean_rating, CAST(us.n30 AS double) AS user_n_ratings_30d, it.pr AS item_positive_rate,
 it.mr AS item_mean_rating, CAST(ng.n AS double) AS item_n_genres, ln(1 + coalesce(us.n, 0)) AS user_log_n_ratings, (t - us.lt) / 86400.0 AS user_days_since_last, (t - us.ft) / 86400.0 AS user_tenure_days, ln(1 + coalesce(it.n, 0)) AS item_log_n_ratings,
 ln(1 + coalesce(it.n7, 0)) AS item_log_n_ratings_7d, ln(1 + coalesce(it.n30, 0)) AS item_log_n_ratings_30d, (t - it.ft) / 86400.0 AS item_age_days, (t - it.lt) / 86400.0 AS item_days_since_last, CAST(m.year AS double) AS item_year,
 CASE WHEN ng.n > 0 THEN coalesce(p, 0.0) / sqrt(ng.n) ELSE 0.0 END AS genre_affinity, abs(m.year - mean_year) AS year_gap
 FROM c CROSS JOIN b LEFT JOIN us USING (user_id) LEFT JOIN it ON it.item_id = c.item_id LEFT JOIN y ON y.user_id = c.user_id LEFT JOIN movies m ON m.item_id = c.item_id LEFT JOIN ng ON ng.item_id = c.item_id
 LEFT JOIN dot ON dot.user_id = c.user_id AND dot.item_id = c.item_id)
SELECT feature, count(value) AS n_known, round(avg(value), 3) AS mean, CAST(0 AS bigint) AS mismatches FROM made UNPIVOT INCLUDE NULLS (value FOR feature IN (COLUMNS(*))) GROUP BY feature"""


@query(PARITY_SQL)
def j24_feature_parity(spark, d):
    """The features of the request path, and where they differ from the candidate table's; each list is also asked for by an unknown user."""
    split, train, relevant, _, recs = popular_lists(spark, d)
    movies, cutoff = V.movies(spark, d), cutoff_of(split)
    listed = R.candidates(recs, relevant).select("user_id", "item_id", "retrieval_score", "retrieval_rank")
    rows = stage(listed.unionByName(listed.withColumn("user_id", -1 - F.col("user_id"))))
    users, items = (stage(P.snapshots(train, P.standard(e))) for e in ("user", "item"))
    profiles = stage(R.user_profiles(train, movies, V.GENRES))
    until = F.timestamp_seconds(F.lit(cutoff))
    online = [P.latest_per_key(t, k, "event_timestamp", until) for t, k in ((users, "user_id"), (items, "item_id"))]
    made = stage(RI.request_features(RI.requests(rows, *online, profiles, movies, cutoff, V.GENRES), V.GENRES))
    offline = R.ranker_features(rows, users, items, profiles, movies, cutoff, V.GENRES)
    differ = E.parity(made, offline, ["user_id", "item_id"], RI.FEATURES, 1e-6)
    held = made.agg(*[F.struct(F.count(c).alias("n_known"), F.round(F.avg(c), 3).alias("mean")).alias(c) for c in RI.FEATURES]).unpivot([], RI.FEATURES, "feature", "held")
    return held.join(differ, "feature").select("feature", "held.n_known", "held.mean", "mismatches")


@query()
def k4_k8_drift(spark, d):
    split, rows = split_of(spark, d), stage(V.ratings(spark, d))
    feats = M.event_features(rows, P.snapshots(rows, P.standard("item")).select("item_id", "snapshot_day", "item_n_ratings_30d", "item_first_ts"), V.movies(spark, d))
    return rounded(M.drift_summary(*M.drift_windows(stage(feats), cutoff_of(split))))


def sides(spark, d):
    rows = V.ratings(spark, d)
    return rows.where("ts < 820454400"), rows.where("ts >= 820454400")


@query(f"""WITH {RT}, x AS (SELECT rating, count(*) FILTER (ts < 820454400) AS a, count(*) FILTER (ts >= 820454400) AS b FROM ratings GROUP BY rating), c AS (SELECT lead(rating) OVER (ORDER BY rating) - rating AS gap, abs(sum(a) OVER (ORDER BY rating) / (SELECT sum(a) FROM x) - sum(b) OVER (ORDER BY rating) / (SELECT sum(b) FROM x)) AS dd FROM x)
SELECT 'rating' AS "column", round(sum(gap * dd) / greatest((SELECT stddev_pop(rating) FROM ratings WHERE ts < 820454400), 0.001), 6) AS score FROM c""")
def k6_wasserstein(spark, d):
    return rounded(M.wasserstein(*sides(spark, d), "rating"))


@query(f"""WITH {RT}, x AS (SELECT rating, count(*) FILTER (ts < 820454400) / CAST((SELECT count(*) FROM ratings WHERE ts < 820454400) AS double) AS p, count(*) FILTER (ts >= 820454400) / CAST((SELECT count(*) FROM ratings WHERE ts >= 820454400) AS double) AS q FROM ratings GROUP BY rating)
SELECT 'rating' AS "column", round(sqrt(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS score FROM x""")
def k7_jensen_shannon(spark, d):
    return rounded(M.jensen_shannon(*sides(spark, d), "rating"))


@query(f"WITH {RT} SELECT user_id, item_id, rating, ts, CAST(n AS integer) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS n FROM ratings WHERE rating >= 4) q WHERE n <= 20")
def k3_capped_impressions(spark, d):
    rows = M.capped_impressions(V.ratings(spark, d))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "item_id")))


@query()
def k1_k2_interleaving(spark, d):
    split, train, relevant, excluded, recs = popular_lists(spark, d, 20)
    recent = R.popular_unseen(R.recent_popularity(train, cutoff_of(split)), relevant.select("user_id").distinct(), excluded, 20)
    lists = lambda df, name: df.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias(name))
    shown = M.interleave(lists(recs, "a").join(lists(recent, "b"), "user_id").withColumnRenamed("user_id", "impression_id"), 10)
    return M.credit(shown, relevant.select(F.col("user_id").alias("impression_id"), "item_id"))


@query(f"WITH {RT} SELECT item_id, CAST(year(make_timestamp(min(ts) * 1000000)) AS integer) AS first_year FROM ratings GROUP BY item_id")
def d29_first_event(spark, d):
    return V.ratings(spark, d).groupBy("item_id").agg(F.year(F.timestamp_seconds(F.min("ts"))).alias("first_year"))


@query(f"WITH {EV} SELECT event_id, CAST(hour(make_timestamp(ts * 1000000)) AS integer) AS hour_utc, CAST(isodow(make_timestamp(ts * 1000000)) AS integer) AS weekday, CAST(floor(ts / 86400) AS bigint) AS day FROM stream")
def h6_h7_calendar(spark, d):
    at = F.timestamp_seconds("ts")
    return V.event_stream(spark, d).select("event_id", F.hour(at).alias("hour_utc"), (F.weekday(at) + 1).alias("weekday"), S.day_of(F.col("ts")).alias("day"))


@query(f"WITH {RT} SELECT user_id, item_id, ts, md5(CAST(user_id AS varchar) || '-' || CAST(item_id AS varchar)) AS tie FROM ratings WHERE ts >= 883612800")
def f2_replay_order(spark, d):
    return V.ratings(spark, d).where("ts >= 883612800").select("user_id", "item_id", "ts", S.tie_key(F.col("user_id"), F.col("item_id")).alias("tie"))


@query(f"""WITH {SPLIT}, a AS (SELECT DISTINCT item_id FROM split WHERE partition = 'train'), b AS (SELECT DISTINCT item_id FROM split WHERE partition <> 'train')
SELECT 'both' AS side, item_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x UNION ALL SELECT 'history', item_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y UNION ALL SELECT 'later', item_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a) z""")
def g2_g3_g5_item_sets(spark, d):
    split, train = train_of(spark, d)
    a, b = train.select("item_id"), split.where("partition <> 'train'").select("item_id")
    name = lambda df, side: df.select(F.lit(side).alias("side"), "item_id")
    return name(a.intersect(b), "both").unionByName(name(a.subtract(b), "history")).unionByName(name(b.subtract(a), "later"))


@query(f"""WITH {POPULAR} SELECT user_id, count(*) AS n_relevant, count(*) FILTER (item_id IN (SELECT item_id FROM train)) AS n_reachable FROM relevant GROUP BY user_id""")
def d27_j2_targets(spark, d):
    split, train = train_of(spark, d)
    relevant, _, _ = R.targets(split.where("partition = 'val'"), train)
    return relevant.groupBy("user_id").agg(F.count("*").alias("n_relevant"), F.count_if("reachable").alias("n_reachable"))


RECENT = f"""{POPULAR}, rc AS (SELECT item_id, count(*) FILTER (ts >= (SELECT min(ts) FROM split WHERE partition = 'val') - 90 * 86400) AS r, count(*) AS n FROM train GROUP BY item_id),
rp AS (SELECT item_id, r + n / (max(n) OVER () + 1.0) AS score FROM rc),
recent AS (SELECT * FROM (SELECT u.user_id, rp.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY rp.score DESC, rp.item_id) AS rank
 FROM u, rp WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = rp.item_id)) q WHERE rank <= 100)"""


def recent_lists(split: DataFrame, train: DataFrame, relevant: DataFrame, excluded: DataFrame) -> DataFrame:
    return R.popular_unseen(R.recent_popularity(train, cutoff_of(split)), relevant.select("user_id").distinct(), excluded, 100)


@query(f"""WITH {RECENT} SELECT round(avg(o), 9) AS recall FROM (SELECT a.user_id, avg(CAST(b.item_id IS NOT NULL AS integer)) AS o FROM (SELECT * FROM recs WHERE rank <= 20) a
LEFT JOIN (SELECT * FROM recent WHERE rank <= 20) b ON a.user_id = b.user_id AND a.item_id = b.item_id GROUP BY a.user_id) q""")
def d30_list_overlap(spark, d):
    split, train, relevant, excluded, recs = popular_lists(spark, d)
    return rounded(E.recall_against_exact(recent_lists(split, train, relevant, excluded), recs, 20, "user_id", "item_id"), 9)


@query(f"""WITH {RECENT}, hits AS (SELECT r.user_id, count(*) AS n, count(a.item_id) AS a, count(b.item_id) AS b FROM relevant r LEFT JOIN recs a ON a.user_id = r.user_id AND a.item_id = r.item_id LEFT JOIN recent b ON b.user_id = r.user_id AND b.item_id = r.item_id GROUP BY r.user_id),
{bootstrap_sql("SELECT user_id, 'difference' AS metric, b / CAST(least(100, n) AS double) - a / CAST(least(100, n) AS double) AS value FROM hits")} SELECT metric, n, {CI}, {VERDICT} FROM ci""")
def c5_d19_k9_paired_difference(spark, d):
    split, train, relevant, excluded, recs = popular_lists(spark, d)
    a, b = E.per_user_metrics(recs, relevant), E.per_user_metrics(recent_lists(split, train, relevant, excluded), relevant)
    return rounded(E.paired_difference(a, b, "recall_100"))


@query(f"""WITH {POPULAR}, pos AS (SELECT item_id, count(*) AS np FROM train WHERE label = 1 GROUP BY item_id), s AS (SELECT r.user_id, r.item_id, CAST(r.rank AS integer) AS retrieval_rank, coalesce(np, 0) AS score FROM recs r LEFT JOIN pos USING (item_id))
SELECT user_id, item_id, retrieval_rank, score, CAST(rank AS integer) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, retrieval_rank) AS rank FROM s) q WHERE rank <= 10""")
def e10_e12_rerank(spark, d):
    _, train, _, _, recs = popular_lists(spark, d)
    positives = train.where("label = 1").groupBy("item_id").agg(F.count("*").alias("score"))
    rows = recs.select("user_id", "item_id", F.col("rank").alias("retrieval_rank")).join(positives, "item_id", "left")
    return R.rerank(rows.withColumn("score", F.coalesce("score", F.lit(0))), "score", 10).select("user_id", "item_id", "retrieval_rank", "score", "rank")


@query(f"WITH {RT} SELECT item_id, count(*) AS n FROM ratings GROUP BY item_id ORDER BY n DESC, item_id LIMIT 200")
def f3_most_popular(spark, d):
    return V.ratings(spark, d).groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(200)


@query(f"""WITH {RT}, x AS (SELECT user_id, unnest(CAST(embedding AS double[])) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM ratings JOIN embeddings ON item_id = vec_id WHERE rating >= 4),
m AS (SELECT user_id, dim, avg(v) AS v FROM x GROUP BY ALL) SELECT user_id, CAST(dim AS integer) AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY user_id)), 6) AS value FROM m""")
def j21_pooled_user_vectors(spark, d):
    vectors = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    pooled = R.pooled_vectors(R.signal(V.ratings(spark, d), "positive"), vectors)
    return rounded(pooled.select("user_id", F.posexplode("vector").alias("dim", "value")))


@query(f"""WITH {TRAIN}, {USERS}, p AS (SELECT item_id, count(*) AS n FROM train GROUP BY item_id ORDER BY n DESC, item_id LIMIT 50), recs AS (SELECT user_id, item_id FROM u, p)
SELECT 'unknown_item' AS rule, count(*) AS violations FROM recs WHERE item_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)
UNION ALL SELECT 'excluded_item', count(*) FROM recs r WHERE EXISTS (SELECT 1 FROM train t WHERE t.user_id = r.user_id AND t.item_id = r.item_id) UNION ALL SELECT 'repeated_item', 0 UNION ALL SELECT 'score_order', 0""")
def b11_b12_b16_list_checks(spark, d):
    split, train = train_of(spark, d)
    relevant, excluded, _ = R.targets(split.where("partition = 'val'"), train)
    recs = R.popular_unseen(R.popularity(train), relevant.select("user_id").distinct(), excluded.limit(0), 50)
    return T.recommendation_violations(recs, V.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("item_id")), excluded)


@query(f"""WITH {SPLIT}, f AS (SELECT item_id, max(ts) AS item_last_ts FROM split GROUP BY item_id)
SELECT max(item_last_ts) AS latest, count(*) FILTER (item_last_ts >= (SELECT min(ts) FROM split WHERE partition = 'val')) AS ahead FROM f""")
def b13_clock_guard(spark, d):
    split = split_of(spark, d)
    return T.features_ahead(split.groupBy("item_id").agg(F.max("ts").alias("item_last_ts")), cutoff_of(split))


@query(f"""WITH {EV}, s AS (SELECT event_id, count(*) OVER a AS n1, count(*) OVER b AS n2, avg(rating) OVER a AS m1, avg(rating) OVER b AS m2 FROM stream
WINDOW a AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 899 PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 1799 PRECEDING AND CURRENT ROW))
SELECT 'session_n_events' AS feature, count(*) FILTER (n1 <> n2) AS mismatches FROM s UNION ALL SELECT 'session_mean_rating', count(*) FILTER (abs(m1 - m2) > 1e-9 * greatest(1, abs(m1), abs(m2))) FROM s""")
def d33_parity(spark, d):
    e = V.event_stream(spark, d)

    def sessions(seconds: int) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(-seconds + 1, 0)
        return e.select("event_id", F.count("*").over(w).alias("session_n_events"), F.avg("rating").over(w).alias("session_mean_rating"))

    return E.parity(sessions(900), sessions(1800), ["event_id"], ["session_n_events", "session_mean_rating"])


VECTOR = f"""{RT}, x AS (SELECT user_id, unnest(CAST(embedding AS double[])) AS v, generate_subscripts(embedding, 1) AS dim FROM ratings JOIN embeddings ON item_id = vec_id WHERE rating >= 4),
m AS (SELECT user_id, dim, avg(v) AS v FROM x GROUP BY ALL), uv AS (SELECT user_id, list(v ORDER BY dim) AS m, sqrt(sum(v * v)) AS norm FROM m GROUP BY user_id),
sc AS (SELECT user_id, vec_id AS item_id, round(list_dot_product(m, CAST(embedding AS double[])) / norm, 9) AS score FROM uv, embeddings),
lists AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc ANTI JOIN ratings r ON r.user_id = sc.user_id AND r.item_id = sc.item_id) q WHERE rank <= 10)"""


def vector_recommendations(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = V.ratings(spark, d)
    items = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    users = R.pooled_vectors(R.signal(rows, "positive"), items)
    return rows, R.vector_lists(users, items, rows.select("user_id", "item_id"), 10)


@query(f"WITH {VECTOR} SELECT user_id, item_id, round(score, 6) AS score, CAST(rank AS integer) AS rank FROM lists")
def j9_j13_j16_vector_lists(spark, d):
    return rounded(vector_recommendations(spark, d)[1])


@query(f"""WITH {VECTOR}, pop AS (SELECT item_id, CAST(count(*) AS double) AS score FROM ratings GROUP BY item_id), rest AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM lists)),
fb AS (SELECT * FROM (SELECT user_id, pop.item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pop.item_id) AS rank FROM rest, pop
 WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = rest.user_id AND r.item_id = pop.item_id)) q WHERE rank <= 10)
SELECT user_id, item_id, round(score, 6) AS score, CAST(rank AS integer) AS rank, 'personal' AS source FROM lists WHERE user_id IN (SELECT c_custkey FROM customer) UNION ALL SELECT user_id, item_id, score, CAST(rank AS integer), 'popular' FROM fb""")
def j31_recommend_with_fallback(spark, d):
    rows, personal = vector_recommendations(spark, d)
    requests = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return rounded(R.recommend_with_fallback(requests, personal, R.popularity(rows), rows.select("user_id", "item_id"), 10))


def searches(spark, d) -> tuple[DataFrame, DataFrame]:
    e = V.table(spark, d, "embeddings")
    return e.where("vec_id % 10 <> 0").select("vec_id", "embedding"), e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query()
def j15_j17_inverted_lists(spark, d):
    vectors, queries = searches(spark, d)
    return rounded(I.search(I.build_index(vectors), queries, 10))


@query(ORACLES["j14_exact_inner_product"])
def j17_all_lists_probed(spark, d):
    """Every list looked at and all of it scored exactly: the exact result."""
    vectors, queries = searches(spark, d)
    found = I.search(I.build_index(vectors), queries, 10, probes=vectors.count(), fetch=vectors.count())
    return rounded(found.select("query_id", "vec_id", "rank", "score"))


@query()
def j17_capped_with_fallback(spark, d):
    """Vectors of the query's own label are left out, and those are most of the twenty fetched: what is short is answered from all."""
    vectors, queries = searches(spark, d)
    labels = stage(V.table(spark, d, "embeddings").select("vec_id", F.col("label").alias("group")))
    theirs = queries.join(labels.withColumnRenamed("vec_id", "query_id"), "query_id")
    return rounded(I.search(I.build_index(vectors.join(labels, "vec_id")), theirs, 10, probes=2, fetch=20))


@query()
def j18_index_quality(spark, d):
    """Settings of the search by recall against exact search, recall of relevant items at 100, and bytes a vector."""
    vectors, queries = searches(spark, d)
    exact, index = stage(QUERIES["j14_exact_inner_product"](spark, d)), I.build_index(vectors)
    split, train = train_of(spark, d)
    relevant, excluded, _ = R.targets(split.where("partition = 'val'"), train)
    items = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    users = stage(R.pooled_vectors(R.signal(train, "positive").join(relevant.select("user_id").distinct(), "user_id", "left_semi"), items.withColumnRenamed("vec_id", "item_id")))
    asked, seen = users.select(F.col("user_id").alias("query_id"), F.col("vector").alias("q")), stage(excluded.select(F.col("user_id").alias("query_id"), F.col("item_id").alias("vec_id")).distinct())
    catalog, rows = I.build_index(items), []
    for probes in (1, 4, 16, 32):
        near = I.search(index, queries, 10, probes, fall_back=False)
        lists = I.search(catalog, asked, 100, probes, fetch=400, excluded=seen, fall_back=False).select(F.col("query_id").alias("user_id"), F.col("vec_id").alias("item_id"), "rank")
        found = E.per_user_metrics(lists, relevant.join(users.select("user_id"), "user_id", "left_semi"), (100,)).agg(F.avg("recall_100").alias("recall_100"))
        rows.append(E.recall_against_exact(near, exact, 10).crossJoin(found).select(F.lit(probes).alias("probes"), "recall", "recall_100", F.lit(index.bytes_per_vector).alias("bytes_a_vector")))
    return rounded(reduce(DataFrame.unionByName, rows))


# Registers the rest; it needs the names above.
from tidemark import studies  # noqa: E402, F401
