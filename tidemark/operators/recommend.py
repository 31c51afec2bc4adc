"""Recommenders over long-form tables (survey C11-C13, D4-D7, D34, J1-J24, J31-J33)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_SECONDS, POSITIVE
from tidemark.operators.evaluation import top_k
from tidemark.operators.features import latest_per_key
from tidemark.operators.pairs import by_item
from tidemark.operators.ranker_inputs import column_features, content
from tidemark.operators.sequences import global_rank
from tidemark.sources.stages import scratch, shuffles_cleaned, stage


#: The most popular items that are joined by a broadcast; beyond so many it is a shuffle.
TOP = 200_000

#: Items of candidates whose features are joined by a broadcast; beyond so many it is a shuffle.
ITEMS = 20_000


def signal(history: DataFrame, kind: str = "all") -> DataFrame:
    return history if kind == "all" else history.where(F.col("rating") >= POSITIVE)


def train_set(history: DataFrame, cutoff: int) -> DataFrame:
    """The history, checked to end before the cutoff."""
    last = history.agg(F.max("ts")).first()[0]
    if last is not None and last >= cutoff:
        raise ValueError(f"history reaches {last}, the cutoff is {cutoff}")
    return history


def targets(evaluation: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relevant, excluded, cold): positives of users with history, flagged by whether their item is in it; the
    history of those users; and how many users have none."""
    warm, items = history.select("user_id").distinct(), history.select("item_id", F.lit(True).alias("reachable")).distinct()
    relevant = evaluation.where("label = 1").join(warm, "user_id", "left_semi").join(items, "item_id", "left").select("user_id", "item_id", F.coalesce("reachable", F.lit(False)).alias("reachable"))
    excluded = history.select("user_id", "item_id").join(relevant.select("user_id").distinct(), "user_id", "left_semi")
    cold = evaluation.select("user_id").distinct().join(warm, "user_id", "left_anti").agg(F.count("*").alias("cold_users"))
    return relevant, excluded, cold


def popularity(history: DataFrame, kind: str = "all") -> DataFrame:
    return signal(history, kind).groupBy("item_id").agg(F.count("*").cast("double").alias("score"))


def recent_popularity(history: DataFrame, cutoff: int, days: int = 90, kind: str = "all") -> DataFrame:
    """Interactions of the last ``days`` before the cutoff, ties broken by the share of the all-time maximum."""
    counts = signal(history, kind).groupBy("item_id").agg(F.count_if(F.col("ts") >= cutoff - days * DAY_SECONDS).alias("recent"), F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("top")))).select("item_id", (F.col("recent") + F.col("n") / (F.col("top") + 1.0)).alias("score"))


def popular_unseen(scores: DataFrame, users: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The k best items that each user hasn't seen.

    Between two items that a user has seen, a run of places is unseen, and its ranks follow from how many were seen before. So a
    user's own history is shuffled, and only the k rows of the list are made, with their rank; no list is held whole for them.
    """
    ranked = stage(global_rank(scores.withColumn("minus", -F.col("score")), "minus", "item_id").select("place", "item_id", "score"))
    own = seen.join(users.select("user_id"), "user_id", "left_semi").join(ranked.select("item_id", "place"), "item_id").select("user_id", "place")
    w = Window.partitionBy("user_id").orderBy("place")
    before, following = F.dense_rank().over(w) - 1, F.lead("place").over(w)
    runs = users.select("user_id", F.lit(0).cast("bigint").alias("place")).unionByName(own).select("user_id", "place", before.alias("before"), following.alias("following"))
    last = F.least(F.col("before") + k, F.col("following") - 1).cast("bigint")  # of null and a number the number
    runs = stage(runs.select("user_id", "before", (F.col("place") + 1).alias("lo"), last.alias("hi")).where("lo <= hi"))
    lists = runs.select("user_id", "before", F.explode(F.sequence("lo", "hi")).alias("place"))
    top = runs.agg(F.max("hi")).first()[0] or 0  # all lists are made of these places
    best = ranked.where(F.col("place") <= top)
    return lists.join(F.broadcast(best) if top <= TOP else best, "place").select("user_id", "item_id", "score", (F.col("place") - F.col("before")).cast("int").alias("rank"))


def item_knn(history: DataFrame, neighbours: int = 200, shrink: float = 10.0, max_history: int | None = None) -> DataFrame:
    """(item_id, other, similarity): the most similar items by shrunk cosine over users."""
    # An item's pairs are counted in one task, with the sizes of both, so they aren't shuffled again. The similarity is rounded once: ties go to the smaller id.
    similarity = F.round(F.col("together") / (F.sqrt("n") * F.sqrt("m") + shrink), 9).alias("similarity")
    nearest = lambda t: top_k(t.select("item_id", "other", similarity), neighbours, "item_id", "similarity", "other").drop("rank")
    return by_item(history, max_history, 2048, False, nearest)


def score_by_similarity(history: DataFrame, similar: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Sum of similarities to a user's history, best unseen items."""
    scores = history.select("user_id", "item_id").join(similar, "item_id").groupBy("user_id", F.col("other").alias("item_id")).agg(F.sum("similarity").alias("score"))
    return top_k(scores.join(seen, ["user_id", "item_id"], "left_anti"), k)


def implicit_als(history: DataFrame, users: DataFrame, k: int, rank: int = 64, seed: int = 42, **options) -> DataFrame:
    """Lists from MLlib's implicit matrix factorization: unseen items of largest inner product. Ids are numbered first, so long ones do.

    Each iteration shuffles all factors to most blocks. Lineage is cut after each, so that the shuffles of earlier ones can be deleted while the fit runs.
    """
    from pyspark.ml.recommendation import ALS

    scratch(history.sparkSession)  # a checkpoint folder is set
    options = {"checkpointInterval": 1} | options

    us = stage(global_rank(history.select("user_id").distinct(), "user_id", name="u"))
    its = stage(global_rank(history.select("item_id").distinct(), "item_id", name="i"))
    rows = history.join(us, "user_id").join(its, "item_id").select(F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), F.lit(1.0).alias("value"))
    als = ALS(rank=rank, seed=seed, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="value", coldStartStrategy="drop", **options)
    with shuffles_cleaned(history.sparkSession):
        model = als.fit(rows)
    wide = lambda f, names, c, to: f.join(names, f["id"] == names[c]).select(names.columns[0], F.transform("features", lambda x: x.cast("double")).alias(to))
    vectors = wide(model.userFactors, us, "u", "vector").join(users, "user_id", "left_semi")
    return vector_lists(vectors, wide(model.itemFactors, its, "i", "embedding"), history.select("user_id", "item_id"), k)


def pooled_vectors(history: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, vector): mean of the vectors of a user's items, to unit length; users without a vector have no row."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = history.select("user_id", "item_id").join(vectors.select("item_id", array_to_vector("embedding").alias("v")), "item_id")
    mean = rows.groupBy("user_id").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select("user_id", F.transform("m", lambda x: x / norm).alias("vector"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class BestItems:
    """The k best unseen items of each user of a block, over blocks of items that come one after the other.

    Products are made in single precision; what they leave within their error of a user's k-th best so far is scored exactly.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, user: np.ndarray, item: np.ndarray, k: int, rows: int = 512, group: np.ndarray | None = None):
        self.ids, self.vectors, self.k, self.rows, self.group = ids, vectors, k, rows, group
        self.rough, self.norms = vectors.astype(np.float32), np.linalg.norm(vectors, axis=1)
        self.score, self.item = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.items, code = np.unique(item, return_inverse=True)
        self.seen = np.sort(user * max(1, len(self.items)) + code)

    def known(self, user: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether a user has seen an item, a row of each."""
        if not len(self.seen):
            return np.zeros(len(user), bool)
        code = np.minimum(np.searchsorted(self.items, item), len(self.items) - 1)
        key = user * len(self.items) + code
        return (self.items[code] == item) & (self.seen[np.minimum(np.searchsorted(self.seen, key), len(self.seen) - 1)] == key)

    def add(self, ids: np.ndarray, vectors: np.ndarray, group: np.ndarray | None = None) -> None:
        """A block of items; those of a user's own group have no part."""
        norm = np.linalg.norm(vectors, axis=1).max()
        single = norm * self.norms.max() < 1e30
        error = (vectors.shape[1] + 8) * (2.0**-22 if single else 2.0**-51)  # of a product, with that of the bound, as a part of both norms
        columns = np.ascontiguousarray((vectors.astype(np.float32) if single else vectors).T)
        full = bool(np.isfinite(self.score[:, -1]).all())
        hidden = None if full else self._places(ids)
        for lo in range(0, len(self.ids), self.rows):
            some = slice(lo, lo + self.rows)
            with np.errstate(all="ignore"):
                about = (self.rough if single else self.vectors)[some] @ columns
                if not single:
                    about[~np.isfinite(about)] = -np.inf
            apart = self.group is not None and group is not None
            if apart:
                about[self.group[some][:, None] == group] = -np.inf
            slack = 2e-9 + error * self.norms[some] * norm
            least = self.score[some, -1] - slack
            short = np.flatnonzero(np.isneginf(least))
            if len(short):  # fewer than k so far: what the k best unseen of this block can be
                here = slice(*np.searchsorted(hidden[0], [lo, lo + len(about)]))
                about[hidden[0][here] - lo, hidden[1][here]] = -np.inf
                part, n = about[short], min(self.k, about.shape[1])
                least[short] = np.partition(part, part.shape[1] - n, axis=1)[:, part.shape[1] - n] - 2 * slack[short]
            row, column = np.divmod(np.flatnonzero(about >= least[:, None].astype(about.dtype)), len(ids))
            if apart:  # where fewer than k are left, the bound lets all pass
                other = self.group[row + lo] != group[column]
                row, column = row[other], column[other]
            if len(row):
                self._keep(row + lo, ids[column], vectors[column])

    def _places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(user, column) of the items of a block that a user has seen, by user."""
        if not len(self.seen):
            return self.seen, self.seen
        order = np.argsort(ids)
        user, code = np.divmod(self.seen, len(self.items))
        place = order[np.minimum(np.searchsorted(ids, self.items, sorter=order), len(ids) - 1)]
        there = (ids[place] == self.items)[code]
        return user[there], place[code[there]]

    def _keep(self, user: np.ndarray, item: np.ndarray, vectors: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            score = np.round(np.einsum("ij,ij->i", self.vectors[user], vectors), 9)
        last, tie = self.score[user, -1], self.item[user, -1]
        left = np.isfinite(score) & ((score > last) | (score == last) & (item < tie))
        left[left] = ~self.known(user[left], item[left])
        user, item, score = user[left], item[left], score[left]
        if not len(user):
            return
        who = np.unique(user)
        user, item, score = np.r_[np.repeat(who, self.k), user], np.r_[self.item[who].ravel(), item], np.r_[self.score[who].ravel(), score]
        order = np.lexsort((item, -score, user))
        user, item, score = user[order], item[order], score[order]
        chosen = np.arange(len(user)) - np.searchsorted(user, user) < self.k
        self.item[who], self.score[who] = item[chosen].reshape(-1, self.k), score[chosen].reshape(-1, self.k)

    def lists(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_pydict({"user_id": self.ids[row], "item_id": self.item[row, place], "score": self.score[row, place]})


#: Rows of items that a task goes through, block by block, with a block of users.
SEGMENT_ITEMS = 131_072

#: A user or query without a group has this one, an item the next.
NO_GROUP = -(1 << 63)


def vector_lists(users: DataFrame, items: DataFrame, seen: DataFrame, k: int, block_rows: int = 1024) -> DataFrame:
    """(user_id, item_id, score, rank): the k unseen items of largest inner product of each user (user_id, vector).

    A block of users meets a segment of the items block by block in one task, which keeps each user's k best: what is shuffled is
    k rows a user and segment. Scores are rounded to 9 digits, ties go to the smaller id. Ids are longs; a vector with a component that isn't a finite number has no part.
    Where both tables have a column ``group``, a number, a user isn't shown items of their own group; a null is no group.
    """
    apart = "group" in users.columns and "group" in items.columns
    grouped = lambda df, none: (F.coalesce(F.col("group").cast("bigint"), F.lit(none)) if apart else F.lit(none)).alias("group")
    users, items = users.select("user_id", "vector", grouped(users, NO_GROUP)), items.select("item_id", "embedding", grouped(items, NO_GROUP + 1))
    own = seen.join(users.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.collect_set("item_id").alias("seen"))
    wide = users.join(own, "user_id", "left").select("user_id", "vector", "group", F.coalesce("seen", F.array().cast("array<bigint>")).alias("seen"))

    def packed(df: DataFrame, key: str, vector: str, rows: int, prefix: str) -> DataFrame:
        n = F.broadcast(df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows)).alias("n")))
        block = F.pmod(F.xxhash64(key), F.col("n")).alias("block")
        lists = "seen" if "seen" in df.columns else F.array().cast("array<bigint>").alias("seen")
        gathered = df.crossJoin(n).select(block, F.struct(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), lists, "group").alias("x")).groupBy("block").agg(F.collect_list("x").alias("x"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    x = b.column(1)[r].values
                    ids, vectors, theirs = x.field("id").to_numpy(), _matrix(x.field("v")), x.field("seen")
                    row, item = np.repeat(np.arange(len(x)), np.diff(theirs.offsets.to_numpy())), theirs.flatten().to_numpy()
                    whole = np.isfinite(vectors).all(axis=1)
                    place, known = np.cumsum(whole) - 1, whole[row]
                    parts = ids[whole], vectors[whole], x.field("group").to_numpy()[whole], place[row[known]], item[known]
                    if whole.any():
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1), *[pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]], names=names)

        names = [f"{prefix}{c}" for c in ("block", "ids", "vectors", "group", "row", "seen")]
        kept = stage(gathered.mapInArrow(pack, f"{names[0]} bigint, " + ", ".join(f"{c} binary" for c in names[1:])))
        return kept if prefix == "u_" else kept.select(*names[:4])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for b in batches:
            for r in range(b.num_rows):
                number = lambda name, kind: np.frombuffer(b.column(name)[r].as_buffer(), kind)  # noqa: B023, E731
                if (block := b.column("u_block")[r].as_py()) != at:
                    if best:
                        yield best.lists()
                    ids = number("u_ids", np.int64).copy()
                    best = BestItems(ids, number("u_vectors", np.float64).reshape(len(ids), -1).copy(), number("u_row", np.int64), number("u_seen", np.int64), k, group=number("u_group", np.int64).copy() if apart else None)
                    at = block
                ids = number("i_ids", np.int64)
                best.add(ids, number("i_vectors", np.float64).reshape(len(ids), -1), number("i_group", np.int64) if apart else None)
        if best:
            yield best.lists()

    # A stated set of users against all items, in blocks.
    us, its = packed(wide, "user_id", "vector", 4 * block_rows, "u_"), packed(items, "item_id", "embedding", block_rows, "i_")
    n, m = max(1, us.count()), max(1, its.count())
    tasks = 3 * us.sparkSession.sparkContext.defaultParallelism
    segments = min(m, max(-(-m * block_rows // SEGMENT_ITEMS), -(-tasks // n)))
    pairs = us.repartition(2 * n, "u_block").hint("shuffle_replicate_nl").crossJoin(its.repartition(segments, "i_block"))  # a block of users stays while those of items come
    return top_k(pairs.mapInArrow(score, "user_id bigint, item_id bigint, score double"), k)


def candidates(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    """Lists with score, rank, label and how many relevant items their user has."""
    theirs = relevant.groupBy("user_id").agg(F.count("*").alias("n_relevant"), F.collect_set("item_id").alias("hits"))  # one shuffle of the lists, by user
    label = F.array_contains("hits", F.col("item_id")).cast("tinyint").alias("label")
    return recs.join(theirs, "user_id").select("user_id", "item_id", F.col("score").cast("float").alias("retrieval_score"), F.col("rank").alias("retrieval_rank"), label, "n_relevant")


def user_profiles(history: DataFrame, movies: DataFrame, genres: list[str]) -> DataFrame:
    """(user_id, user_mean_year, genres as a unit vector over positives, in vocabulary order)."""
    rows = history.join(movies, "item_id")
    year = rows.groupBy("user_id").agg(F.avg("year").alias("user_mean_year"))
    one = rows.where(F.col("rating") >= POSITIVE).select("user_id", F.explode("genres").alias("g")).where(F.col("g").isin(genres))
    wide = one.groupBy("user_id").agg(F.array(*[F.count_if(F.col("g") == g).cast("double") for g in genres]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    return year.join(wide.select("user_id", F.transform("c", lambda x: x / norm).alias("genres")), "user_id", "left").withColumnRenamed("genres", "user_genres")


def ranker_features(rows: DataFrame, user_snaps: DataFrame, item_snaps: DataFrame, profiles: DataFrame, movies: DataFrame, cutoff: int, genres: list[str]) -> DataFrame:
    """Candidates plus the ranker's inputs, from the latest snapshots before the cutoff."""
    until = F.timestamp_seconds(F.lit(cutoff))
    u, i = latest_per_key(user_snaps, "user_id", "event_timestamp", until), latest_per_key(item_snaps, "item_id", "event_timestamp", until)
    rows = stage(rows)
    own = rows.select("item_id").distinct()
    few = own.limit(ITEMS + 1).count() <= ITEMS  # lists of popular items hold the same few, each for most users
    listed = lambda t: t.join(F.broadcast(own) if few else own, "item_id", "left_semi")
    about = listed(i.drop("snapshot_day", "event_timestamp")).join(listed(content(movies, genres)), "item_id", "full")
    df = rows.join(u.drop("snapshot_day", "event_timestamp"), "user_id", "left").join(profiles, "user_id", "left")
    df = df.join(F.broadcast(about) if few else about, "item_id", "left")
    return df.select(*rows.columns, *column_features(df, cutoff))


def rerank(rows: DataFrame, score: str, k: int) -> DataFrame:
    """Candidates in the order of a new score, ties by retrieval rank."""
    return top_k(rows, k, "user_id", score, "retrieval_rank")


def recommend_with_fallback(requests: DataFrame, personal: DataFrame, popular: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Personal lists where there is one, else the most popular unseen items, with their source."""
    personal = stage(personal)  # several steps ask who has a list
    known = personal.select("user_id").distinct()
    mine = personal.join(requests, "user_id", "left_semi").where(F.col("rank") <= k).select("user_id", "item_id", "score", "rank", F.lit("personal").alias("source"))
    rest = popular_unseen(popular, requests.join(known, "user_id", "left_anti"), seen, k)
    return mine.unionByName(rest.select("user_id", "item_id", "score", "rank", F.lit("popular").alias("source")))
