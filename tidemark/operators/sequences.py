"""User sequences and training windows (survey C15, D23-D24, E5-E8, E11, E13, H16, J20, J22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import POSITIVE, gap_bucket, log_inclusion, tie_key, unit, year_bucket
from tidemark.sources.stages import stage


def global_rank(df: DataFrame, first: str, *rest: str, name: str = "place", ranges: int = 64) -> DataFrame:
    """``df`` plus each row's position, from 1, in the order of numeric column ``first`` and the rest.

    Rows fall into ranges of ``first`` between its approximate quantiles, are numbered within their range, and shifted by
    the sizes of the ranges before: no task sorts the whole table. Rows of one value of ``first`` share a range.
    """
    cuts = sorted(set(df.approxQuantile(first, [i / ranges for i in range(1, ranges)], 0.01)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(first))) if cuts else F.lit(0)
    placed = stage(df.withColumn("_p", part))  # read by two branches, which must see the same ranges
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(first, *rest)))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("n"))  # a row a range
    starts = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_start"))
    return ranked.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_r")).drop("_p", "_r", "_start")


def catalog_tokens(items: DataFrame) -> DataFrame:
    """(item_id, token): position among the sorted items, from 1."""
    return global_rank(items.select("item_id").distinct(), "item_id", name="token")


def user_sequences(history: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Events in order of (ts, tie key) with position, positive flag and gap bucket; items outside the catalog go."""
    w = Window.partitionBy("user_id").orderBy("ts", "tie", "item_id")
    rows = history.join(tokens, "item_id") if tokens is not None else history.withColumn("token", F.col("item_id"))
    rows = rows.withColumn("tie", tie_key(F.col("user_id"), F.col("item_id")))
    gap = F.col("ts") - F.lag("ts").over(w)
    return rows.select("user_id", F.row_number().over(w).alias("pos"), "item_id", "token", (F.col("rating") >= POSITIVE).cast("int").alias("positive"), gap_bucket(gap).alias("gap"), "ts")


def last_events(sequences: DataFrame, n: int) -> DataFrame:
    """Each user's last n events as ordered arrays, zero-filled on the left."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("pos")))
    rows = sequences.withColumn("_b", back).where(F.col("_b") <= n).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "positive", "gap"))).alias("e"))
    pad = lambda c: F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.lit(n) - F.size("e")), F.transform("e", lambda x: x[c].cast("bigint")))
    return rows.select("user_id", pad("token").alias("tokens"), pad("positive").alias("positives"), pad("gap").alias("gaps"))


def training_windows(sequences: DataFrame, length: int, epoch: int, latest_share: float = 0.5, seed: int = 42) -> DataFrame:
    """One window of at most length + 1 events for each user and epoch, as (input, next token, next positive) rows.

    The window ends at the last event with probability ``latest_share``, else at a uniform one; both by hashes.
    """
    draw = lambda salt: unit(seed, epoch, salt, F.col("user_id"))
    n = F.max("pos").over(Window.partitionBy("user_id"))
    end = F.when(draw("latest") < latest_share, F.col("n")).otherwise(F.least(F.col("n"), 2 + F.floor(draw("end") * F.greatest(F.col("n") - 1, F.lit(1)))))
    rows = sequences.withColumn("n", n).where("n >= 2").withColumn("end", end).where((F.col("pos") <= F.col("end")) & (F.col("pos") >= F.col("end") - length))
    w = Window.partitionBy("user_id").orderBy("pos")
    out = rows.select("user_id", "pos", "token", "gap", F.lead("token").over(w).alias("next_token"), F.lead("positive").over(w).alias("next_positive"))
    return out.where(F.col("next_token").isNotNull())


def tag_vocabulary(tags: DataFrame, cutoff: int, size: int = 1000) -> DataFrame:
    """(tag, tag_index): the commonest tags applied before the cutoff, from 1."""
    top = tags.where(F.col("ts") < cutoff).groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(size)
    return top.withColumn("tag_index", F.row_number().over(Window.orderBy(F.desc("count"), "tag"))).select("tag", "tag_index")


def top_tags(tags: DataFrame, vocabulary: DataFrame, cutoff: int, n: int = 8) -> DataFrame:
    """(item_id, tag_ids): each item's most used tags of the vocabulary, by count, then vocabulary order."""
    counts = tags.where(F.col("ts") < cutoff).join(F.broadcast(vocabulary), "tag").groupBy("item_id", "tag_index").count()
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("count"), "tag_index"))).where(F.col("r") <= n)
    return ranked.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "tag_index"))), lambda x: x["tag_index"]).alias("tag_ids"))


def item_content(movies: DataFrame, tags: DataFrame, vocabulary: DataFrame, cutoff: int, genres: list[str]) -> DataFrame:
    """Multi-hot genres, year bucket and top tags of each item."""
    hot = F.array(*[F.array_contains("genres", g).cast("int") for g in genres])
    return movies.select("item_id", hot.alias("genre_hot"), year_bucket(F.col("year")).alias("year_bucket")).join(top_tags(tags, vocabulary, cutoff), "item_id", "left")


def negatives(positives: DataFrame, catalog: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(user_id, item_id, token, log_q): n uniform catalog draws a positive, by hash; a user's own positives are masked.

    log_q is the log probability that the item is among as many draws by its share of positives or uniform ones, by
    which a sampled loss is corrected.
    """
    size, total = catalog.count(), positives.count()
    place = 1 + F.floor(unit(seed, F.col("user_id"), F.col("item_id"), F.col("k")) * max(size, 1))
    drawn = positives.select("user_id", "item_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).select("user_id", place.cast("bigint").alias("token"))
    share = positives.groupBy("item_id").agg((F.count("*") / float(max(total, 1))).alias("share"))
    chances = catalog.join(share, "item_id", "left").select("item_id", "token", log_inclusion(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1 - 1e-9)), 1, n, max(size, 2)).alias("log_q"))
    return drawn.join(chances, "token").join(positives.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").select("user_id", "item_id", "token", "log_q")


STATE_EVENTS = "array<struct<ts:bigint,token:bigint,positive:int,gap:int>>"


def append_events(state: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """Serving state after new events (user_id, token, positive, ts): the last ``n`` events, newest last, with the gap of each
    to the one before, and the sorted set of tokens seen. Events that a user has seen, or older than the newest of the state,
    change nothing; those of one second count in the order of ``tie`` if there is such a column, then of tokens.

    State rows are (user_id, recent array of (ts, token, positive, gap), seen array of tokens, last_ts).
    """
    tie = F.col("tie") if "tie" in events.columns else F.lit("")
    fresh = events.withColumn("_tie", tie).join(state.select("user_id", "seen", "last_ts"), "user_id", "left")
    fresh = fresh.where((F.col("last_ts").isNull() | (F.col("ts") >= F.col("last_ts"))) & ~F.coalesce(F.array_contains("seen", F.col("token")), F.lit(False)))
    once = fresh.groupBy("user_id", "token").agg(F.min(F.struct("ts", "_tie", "token", "positive")).alias("e"))
    added = once.groupBy("user_id").agg(F.sort_array(F.collect_list("e")).alias("new"))
    both = state.join(added, "user_id", "full_outer").withColumn("new", F.coalesce("new", F.array().cast("array<struct<ts:bigint,_tie:string,token:bigint,positive:int>>")))
    before = lambda i: F.when(i == 0, F.col("last_ts")).otherwise(F.get("new", i - 1)["ts"])
    made = F.transform("new", lambda e, i: F.struct(e["ts"].alias("ts"), e["token"].alias("token"), e["positive"].alias("positive"), gap_bucket(e["ts"] - before(i)).cast("int").alias("gap")))
    recent = F.concat(F.coalesce("recent", F.array().cast(STATE_EVENTS)), made.cast(STATE_EVENTS))
    kept = F.when(F.size(recent) > n, F.slice(recent, -n, n)).otherwise(recent)
    seen = F.sort_array(F.array_union(F.coalesce("seen", F.array().cast("array<bigint>")), F.transform("new", lambda e: e["token"].cast("bigint"))))
    return both.select("user_id", kept.alias("recent"), seen.alias("seen"), F.greatest("last_ts", F.array_max(F.transform("new", lambda e: e["ts"]))).alias("last_ts"))


def load_state(sequences: DataFrame, n: int) -> DataFrame:
    """Serving state of a whole history (``user_sequences``): last ``n`` events, tokens seen, newest time."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("pos")))
    event = F.struct("ts", F.col("token").cast("bigint").alias("token"), "positive", "gap")
    rows = sequences.withColumn("b", back)
    return rows.groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("b") <= n, F.struct("pos", event.alias("e"))))), lambda x: x["e"]).alias("recent"),
        F.sort_array(F.collect_set(F.col("token").cast("bigint"))).alias("seen"), F.max("ts").alias("last_ts"),
    )


def history_view(state: DataFrame) -> DataFrame:
    """(user_id, place, token, positive, gap, ts): each user's last events, newest first from 1."""
    return state.select("user_id", F.posexplode(F.reverse("recent")).alias("p", "e")).select("user_id", (F.col("p") + 1).alias("place"), "e.token", "e.positive", "e.gap", "e.ts")
