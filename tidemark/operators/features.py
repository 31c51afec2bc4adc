"""Point-in-time features: declared aggregates, daily snapshots, as-of lookups (survey D1-D3, E1-E2, C6-C10, A16-A17)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_SECONDS, POSITIVE, day_of, smoothed
from tidemark.sources.stages import stage

#: About so many rows are sorted in a task.
ROWS_PER_TASK = 500_000

KINDS = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Feature:
    """A count, or the sum, min or max of a column, over all history or the last ``days``, maybe of positives only."""

    name: str
    kind: str
    column: str | None = None
    days: int | None = None
    positives: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS or (self.kind == "count") == (self.column is not None) or (self.days is not None and self.days < 1):
            raise ValueError(f"{self.name}: a count has no column, other kinds need one, days must be positive")

    @property
    def measure(self) -> str:
        """What is taken of a day's events; features that differ only in ``days`` share it."""
        return "_".join(["m", self.kind, self.column or "rows", "positive" if self.positives else "all"])

    @property
    def adds_up(self) -> bool:
        return self.kind in ("count", "sum")

    def of_day(self) -> Column:
        what = F.col(self.column) if self.column else F.lit(1)
        return KINDS[self.kind](F.when(F.col("rating") >= POSITIVE, what) if self.positives else what).alias(self.measure)


@dataclass(frozen=True)
class FeatureTable:
    """Features of one entity, and ratios (name, numerator, denominator, prior, weight) of them."""

    key: str
    features: tuple[Feature, ...]
    ratios: tuple[tuple[str, str, str, float, float], ...] = field(default=())

    @property
    def windows(self) -> list[int]:
        return sorted({f.days for f in self.features if f.days})


def standard(entity: str) -> FeatureTable:
    p = entity
    return FeatureTable(
        f"{p}_id",
        (
            Feature(f"{p}_n_ratings", "count"), Feature(f"{p}_n_positive", "count", positives=True), Feature(f"{p}_rating_sum", "sum", "rating"),
            Feature(f"{p}_n_ratings_7d", "count", days=7), Feature(f"{p}_n_ratings_30d", "count", days=30),
            Feature(f"{p}_first_ts", "min", "ts"), Feature(f"{p}_last_ts", "max", "ts"),
        ),
        ((f"{p}_mean_rating", f"{p}_rating_sum", f"{p}_n_ratings", 3.5, 5.0), (f"{p}_positive_rate", f"{p}_n_positive", f"{p}_n_ratings", 0.5, 5.0)),
    )


def tasks_for(df: DataFrame, rows: int) -> int:
    """So many tasks that each gets ``ROWS_PER_TASK`` of ``rows`` rows, so that its memory doesn't grow with the table; one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def snapshots(events: DataFrame, spec: FeatureTable, from_day: int | None = None, ordered: bool = False) -> DataFrame:
    """A row per entity and day on which its features may change: the day after activity, and when a window lets it go.

    Features cover the days strictly before. ``from_day`` leaves out earlier rows and adds one on that day for each
    entity active before. ``ordered`` puts ranges of entities into the partitions, and rows in order within. Events are counted
    first, so they should be a written table.

    A day's measures enter an entity's features on the next day and leave a window of w days w days later, with their
    sign turned. What enters and leaves on a day is one row, and a snapshot is the running total of those rows up to its
    day: no frame is searched, and the rows are the snapshots. Smallest and largest values can't leave; over a window they
    are taken from the days inside it.
    """
    key = spec.key
    measures = {f.measure: f.of_day() for f in spec.features}
    days = events.groupBy(key, day_of(F.col("ts")).alias("day")).agg(*measures.values())
    shifts = F.explode(F.array(*[F.lit(w) for w in (0, *spec.windows)])).alias("shift")
    due = F.col("day") + 1 + F.col("shift")
    # An entity's days come together once and stay so: what they are made into needs no further exchange.
    tasks = tasks_for(events, events.count() * (1 + len(spec.windows)))
    days = days.repartitionByRange(tasks, key) if ordered else days.repartition(tasks, key)
    moves = days.select("*", shifts).withColumn("snapshot_day", due if from_day is None else F.greatest(due, F.lit(from_day).cast("bigint")))

    def moved(f: Feature) -> Column:
        enters = F.when(F.col("shift") == 0, F.col(f.measure))
        if f.adds_up:
            return F.coalesce(F.sum(enters.when(F.col("shift") == f.days, -F.col(f.measure)) if f.days else enters), F.lit(0)).alias(f.name)
        if f.days:  # the days inside a window, each with its value
            return F.collect_list(F.when((F.col("shift") == 0) & F.col(f.measure).isNotNull(), F.struct("day", f.measure))).alias(f.name)
        return KINDS[f.kind](enters).alias(f.name)

    so_far = Window.partitionBy(key).orderBy("snapshot_day").rowsBetween(Window.unboundedPreceding, 0)

    def held(f: Feature) -> Column:
        whole = "bigint" if f.kind == "count" or f.column == "ts" else "double"
        if f.adds_up:
            return F.sum(f.name).over(so_far).cast(whole).alias(f.name)
        if f.days:
            late = Window.partitionBy(key).orderBy("snapshot_day").rangeBetween(-f.days, 0)  # the first of them may hold older days
            inside = F.filter(F.flatten(F.collect_list(f.name).over(late)), lambda x: x["day"] >= F.col("snapshot_day") - f.days)
            return (F.array_min if f.kind == "min" else F.array_max)(F.transform(inside, lambda x: x[f.measure])).cast(whole).alias(f.name)
        return KINDS[f.kind](f.name).over(so_far).cast(whole).alias(f.name)

    steps = moves.groupBy(key, "snapshot_day").agg(*[moved(f) for f in spec.features])
    out = steps.select(key, "snapshot_day", *[held(f) for f in spec.features])
    out = out.withColumns({name: smoothed(F.col(n), F.col(d), prior, weight) for name, n, d, prior, weight in spec.ratios})
    return out.withColumn("event_timestamp", F.timestamp_seconds(F.col("snapshot_day") * DAY_SECONDS))


#: Keys of more than one in so many of all rows are cut into ranges of time; there are fewer of them than this number.
LONG_KEYS = 100_000
RANGES = 256


def time_ranges(rows: DataFrame, key: str, time: str, segment_rows: int) -> DataFrame | None:
    """(key, cuts) of the keys with more than ``segment_rows`` rows: approximate quantiles of their times; none without such keys.

    The result is small: with ``segment_rows`` or a hundred-thousandth of all rows, whichever is more, a key must have.
    """
    limit = max(segment_rows, rows.count() // LONG_KEYS)
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    long = stage(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key))
    if long.limit(1).count() == 0:
        return None
    theirs = rows.join(F.broadcast(long), key)
    return stage(theirs.groupBy(key).agg(F.array_sort(F.array_distinct(F.percentile_approx(time, shares, F.lit(10_000)))).alias("cuts")))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str], segment_rows: int = 1_000_000) -> DataFrame:
    """``left`` with the columns of the latest ``right`` row of the same key at or before its time; nulls without one.

    One union, one sort per key, one running last: no pairs are made, whatever the number of snapshots, and a task sorts about
    ``ROWS_PER_TASK`` rows. A long key is cut into
    ranges of time, each sorted by a task of its own; the last value of the ranges before one is put in front of it. A null
    key or time finds nothing; of ``right`` rows that are equal in key and time any one counts.
    """
    wanted = right.select(F.struct(*columns)).schema[0].dataType
    ours = left.select(key, F.col(left_time).alias("_t"), F.lit(1).alias("_k"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(wanted).alias("_hit"))
    theirs = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_k"), F.struct(*columns).alias("_hit")).where(F.col(key).isNotNull() & F.col("_t").isNotNull())
    both = stage(ours.unionByName(theirs, allowMissingColumns=True))
    ranges = time_ranges(both.select(key, "_t"), key, "_t", segment_rows)
    if ranges is None:
        parted = both.withColumn("_part", F.lit(0))
    else:
        cuts = F.broadcast(ranges)
        parted = both.join(cuts, key, "left").withColumn("_part", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("_t"))), F.lit(0))).drop("cuts")
        parted = parted.withColumn("_part", F.greatest("_part", F.lit(0)))
        last = parted.where("_k = 0").join(F.broadcast(ranges.select(key)), key).groupBy(key, "_part").agg(F.max_by("_hit", "_t").alias("_hit"))
        grid = ranges.select(key, F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("_part"))  # RANGES rows a key at most
        before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = grid.join(last, [key, "_part"], "left").withColumn("_hit", F.last("_hit", ignorenulls=True).over(before))
        parted = parted.unionByName(carried.where("_hit is not null").withColumn("_k", F.lit(-1)), allowMissingColumns=True)
    w = Window.partitionBy(key, "_part").orderBy(F.col("_t").asc_nulls_first(), "_k").rowsBetween(Window.unboundedPreceding, 0)
    parted = parted.repartition(tasks_for(both, both.count()), key, *([] if ranges is None else ["_part"]))
    found = parted.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).where("_k = 1")
    return found.select("_row.*", *[F.col(f"_hit.{c}").alias(c) for c in columns])


def latest_per_key(df: DataFrame, key: str, time: str, until=None) -> DataFrame:
    """The latest row of each key, up to a time if given: what an online table holds."""
    if until is not None:
        df = df.where(F.col(time) <= until)
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(time)).alias("r")).select("r.*")


def online_lookup(keys: DataFrame, online: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns of each asked key, null when it is absent. Spark broadcasts the keys when they are few."""
    return keys.join(online.select(key, *columns), key, "left")


FEATURE_TYPES = {"count": "bigint", "ts": "bigint"}


def feature_view(df: DataFrame, spec: FeatureTable, name: str) -> list[tuple[str, str]]:
    """Register a snapshot table as a view and return its typed fields, from the spec."""
    df.createOrReplaceTempView(name)
    fields = [(f.name, FEATURE_TYPES.get(f.kind) or FEATURE_TYPES.get(f.column or "", "double")) for f in spec.features]
    return [(spec.key, "bigint"), ("event_timestamp", "timestamp"), *fields, *[(r[0], "double") for r in spec.ratios]]
