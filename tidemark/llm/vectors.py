"""Nearest neighbours by an adaptive dimension scan, and near-duplicate vectors by binary codes with error bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batch, connected_components, cut

#: Vectors of one block, and block pairs sent to Python at once: they bound the memory of a task.
BLOCK_ROWS, PAIRS_PER_BATCH = 1024, 32


def usable(vector: Column) -> Column:
    """True for a vector that takes part: not null, not zero, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_size(df: DataFrame, vector_col: str) -> int:
    """The commonest number of components; vectors of another size aren't comparable and take no part."""
    r = df.groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return r.n if r else 0


def rotation(size: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of ``size`` numbers each, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


@contextmanager
def small_batches(spark: SparkSession, rows: int = PAIRS_PER_BATCH) -> Iterator[None]:
    """Rows that carry whole blocks go to Python a few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def blocks(df: DataFrame, keys: list[str], id_col: str, fields: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, block, members): rows with the same keys in blocks of about ``block_rows``, dealt by a hash of the id.

    Members are arrays of structs of ``fields``. A key with a third of all rows is many blocks, never one group.
    """
    # Counts are summed where the rows lie first; AQE splits the join with a large key's count.
    counts = df.groupBy(*keys).count().select(*keys, F.ceil(F.col("count") / block_rows).alias("_n"))
    dealt = df.join(counts, keys).withColumn("block", F.pmod(F.xxhash64(id_col, F.lit(7)), F.col("_n")).cast("int"))
    return dealt.groupBy(*keys, "block").agg(F.collect_list(F.struct(*fields)).alias("members"))


def block_pairs(packed: DataFrame, *keys: str) -> DataFrame:
    """(m1, m2) of each two different blocks of the same keys. The pairs of a key are listed first and each fetches its
    blocks by number, so they are dealt over as many tasks as the key has blocks."""
    most = packed.groupBy(*keys).agg(F.max("block").alias("last")).where("last > 0")
    listed = most.select(*keys, F.explode(F.sequence(F.lit(1), F.col("last"))).alias("b2")).select(*keys, "b2", F.explode(F.sequence(F.lit(0), F.col("b2") - 1)).alias("b1"))
    one = packed.select(*keys, F.col("block").alias("b1"), F.col("members").alias("m1"))
    two = packed.select(*keys, F.col("block").alias("b2"), F.col("members").alias("m2"))
    return listed.join(one, [*keys, "b1"]).join(two, [*keys, "b2"]).select("m1", "m2")


# --- nearest neighbours ---------------------------------------------------------------------------------------------


def k_means(x: np.ndarray, k: int, seed: int = 42, rounds: int = 15) -> np.ndarray:
    """Centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = nearest_lists(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        n = np.bincount(home, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` closest centres of each row, in no order."""
    d = (centres**2).sum(axis=1) - 2 * x @ centres.T
    return np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))


def lists_to_probe(x: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Fewest lists that give ``recall`` of the true neighbours of sampled rows within the sample.

    The neighbours within the sample are farther than those among all rows, so the number is on the safe side.
    """
    probes = x[: min(len(x), 256)]
    d = ((probes[:, None, :] - centres[None]) ** 2).sum(axis=2)
    order = np.argsort(np.argsort(d, axis=1), axis=1)  # rank of each list for each probe
    home = nearest_lists(x, centres, 1)[:, 0]
    gaps = (x**2).sum(axis=1) - 2 * probes @ x.T
    gaps[np.arange(len(probes)), np.arange(len(probes))] = np.inf
    true = np.argsort(gaps, axis=1)[:, : min(k, len(x) - 1)]
    needed = np.sort(np.take_along_axis(order, home[true], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1 if len(needed) else len(centres)


def scan(query: np.ndarray, rotated: np.ndarray, k: int, columns: int = 16, error: float = 2.1, first: int = 64) -> np.ndarray:
    """Rows of ``rotated`` that may be among the k nearest to a rotated query.

    The first rows are measured fully; their k-th distance is the bar. For the others the squared distance grows by
    blocks of columns; a row is abandoned when the scaled partial distance is above the bar by more than the test
    allows at that number of dimensions. The bar falls once the rest is measured.
    """
    n, size = rotated.shape
    first = max(first, 4 * k)
    full = ((rotated[:first] - query) ** 2).sum(axis=1)
    if n <= first:
        rows, dist = np.arange(n), full
    else:
        bar = np.partition(full, k - 1)[k - 1]
        rows, dist = np.arange(first, n), np.zeros(n - first)
        for at in range(0, size, columns):
            to = min(size, at + columns)
            dist = dist + ((rotated[rows, at:to] - query[at:to]) ** 2).sum(axis=1)
            if to < size:
                stay = dist * size / to <= bar * (1 + error / math.sqrt(to)) ** 2
                rows, dist = rows[stay], dist[stay]
        rows, dist = np.r_[np.arange(first), rows], np.r_[full, dist]
    if len(rows) <= k:
        return rows
    bar = np.partition(dist, k - 1)[k - 1]
    return rows[dist <= bar * (1 + 1e-9) + 1e-12]


def nearest_neighbours(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, recall: float = 0.97,
    sample_rows: int = 8192, max_lists: int = 1024, seed: int = 42,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable row where ``queries`` holds, its k nearest other rows found.

    Centroids and the number of lists probed are fitted on ``sample_rows`` rows, those of least hash of the id;
    every row is indexed. Lists are cut into blocks, so is the set of queries of a list, and each pair of blocks is
    one piece of work. score is the Euclidean distance of the original vectors in double precision, ties go to the
    smaller id. Fewer than k candidates give them all; no usable row gives no row. Rows that share an id are
    candidates of one another's queries only if their ids differ; rows equal in id and vector are one, and each
    different vector of an id is a query of its own. Rows with a null id take no part, nor do vectors of another size
    than the commonest. A query that finds fewer than k in its lists is answered from all of them. Extra columns are left out.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    good = good.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(vector_col).alias("mark"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    size = common_size(good, "v")
    good = good.where(F.size("v") == size)
    count = good.count()
    if not count:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = matrix(good.select("v").orderBy(F.xxhash64("v", F.lit(seed))).limit(sample_rows).toArrow()["v"].combine_chunks(), size)
    centres = k_means(sample, min(max_lists, max(1, round(math.sqrt(count))), max(1, len(sample) // 8)), seed)
    probes = lists_to_probe(sample, centres, k, recall)
    turn = rotation(size, seed)

    def place(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    lists = nearest_lists(matrix(part.column(2), size), centres, n).astype(np.int32)
                    yield batch(id=part.column(0), mark=part.column(1), v=part.column(2), lists=pa.array(list(lists)))

        return run

    kind = "array<float>" if "float" in vectors.schema[vector_col].dataType.simpleString() else "array<double>"
    placed, fields = f"id bigint, mark bigint, v {kind}, lists array<int>", ["id", "mark", "v"]
    stored = good.select(*fields).mapInArrow(place(1), placed).select(*fields, F.col("lists")[0].alias("list"))
    asked = good.where("q").select(*fields).mapInArrow(place(probes), placed).select(*fields, F.explode("lists").alias("list"))
    right = cut(blocks(stored, ["list"], "id", fields))
    numbers = right.groupBy("list").agg(F.max("block").alias("last")).select("list", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"))

    def members(x: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, marks and vectors of a block; rows equal in all lie in the same block and are one."""
        ids, marks, v = x.field(0).to_numpy(), x.field(1).to_numpy(), matrix(x.field(2), size)
        _, first = np.unique(np.stack([ids, marks]), axis=1, return_index=True)
        return ids[first], marks[first], v[first]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ask, marks, x = members(b.column(0)[i].values)
                ids, _, y = members(b.column(1)[i].values)
                xr, yr = x @ turn, y @ turn
                out: list[tuple] = []
                for q, mark, v, vr in zip(ask, marks, x, xr, strict=True):
                    rows = scan(vr, yr, k + int((ids == q).sum()))
                    rows = rows[ids[rows] != q]
                    score = np.sqrt(((y[rows] - v) ** 2).sum(axis=1))
                    best = np.lexsort((ids[rows], score))[:k]
                    out.append((np.full(len(best), q), np.full(len(best), mark), ids[rows][best], score[best]))
                parts = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield batch(query_id=parts[0], mark=parts[1], vec_id=parts[2], score=parts[3])

    def answers(asked: DataFrame) -> DataFrame:
        # Blocks of queries and of stored rows meet as pairs, dealt by list and block.
        left = blocks(asked, ["list"], "id", fields, 256).select("list", F.col("members").alias("asked"))
        pairs = left.join(numbers, "list").join(right, ["list", "block"]).select("asked", "members")
        with small_batches(spark):
            found = cut(pairs.mapInArrow(search, "query_id bigint, mark bigint, vec_id bigint, score double"))
        rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    ranked = cut(answers(asked))
    full = ranked.where(F.col("rank") == k).select("query_id", "mark")
    short = good.where("q").join(full, (F.col("id") == F.col("query_id")) & (good["mark"] == full["mark"]), "left_anti").select(*fields)
    if probes < len(centres) and not short.isEmpty():
        every = answers(short.select(*fields, F.explode(F.sequence(F.lit(0), F.lit(len(centres) - 1))).alias("list")))
        ranked = ranked.join(full, ["query_id", "mark"], "left_semi").select(*every.columns).unionByName(every)
    return ranked.select("query_id", "rank", "vec_id", "score")


# --- near duplicates ------------------------------------------------------------------------------------------------


def binary_codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their signs, and the correction factor of each: its inner product with its own code."""
    rotated = x / np.linalg.norm(x, axis=1, keepdims=True) @ turn
    signs = np.where(rotated >= 0, 1.0, -1.0).astype(np.float32)
    return rotated.astype(np.float32), signs, np.abs(rotated).sum(axis=1) / math.sqrt(x.shape[1])


def close_pairs(x: np.ndarray, y: np.ndarray, cx: tuple, cy: tuple, threshold: float, confidence: float = 5.0) -> np.ndarray:
    """Which pairs of rows have a cosine of at least ``threshold``, as a boolean matrix.

    The code of a row of x times the rotated row of y, over the correction factor, estimates their cosine without
    bias; its error is within ``confidence`` standard errors of the factor's spread. Only pairs whose upper bound
    reaches the threshold are computed again, from the original vectors in double precision.
    """
    size, factor = x.shape[1], cx[2][:, None]
    estimate = (cx[1] @ cy[0].T) / (math.sqrt(size) * factor)
    bound = confidence * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(1, size - 1))
    open_pairs = estimate + bound >= threshold
    out = np.zeros(open_pairs.shape, dtype=bool)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    rows = np.flatnonzero(open_pairs.any(axis=1))
    for part in np.array_split(rows, max(1, len(rows) // 128)):
        if open_pairs[part].mean() > 0.05 if len(part) else False:
            out[part] = open_pairs[part] & ((x[part] @ y.T) / (nx[part, None] * ny) >= threshold)
        elif len(part):
            i, j = np.nonzero(open_pairs[part])
            out[part[i], j] = (x[part[i]] * y[j]).sum(axis=1) / (nx[part[i]] * ny[j]) >= threshold
    return out


def spanning_edges(ok: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a forest that connects what the bipartite graph ``ok`` connects."""
    left, right = [], []
    fresh_i, fresh_j = ok.any(axis=1), np.ones(ok.shape[1], dtype=bool)
    for i in range(len(ok)):
        queue = [i] if fresh_i[i] else []
        fresh_i[i] = False
        while queue:
            a = queue.pop()
            js = np.flatnonzero(ok[a] & fresh_j)
            fresh_j[js] = False
            left += [a] * len(js)
            right += js.tolist()
            for j in js:
                more = np.flatnonzero(ok[:, j] & fresh_i)
                fresh_i[more] = False
                left += more.tolist()
                right += [j] * len(more)
                queue += more.tolist()
    return left, right


def close_cells(pivots: np.ndarray, threshold: float):
    """Filter of pairs of cells (label, a, b, most_a, most_b, ...): vectors lie within those angles of their pivots, so two
    cells can hold a link only if their pivots' angle is at most both angles and that of the threshold together."""
    unit = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j, p, q = (b.column(c).to_numpy() for c in range(1, 5))
            angle = np.arccos(np.clip((unit[i] * unit[j]).sum(axis=1), -1, 1))
            yield b.filter(pa.array(angle <= p + q + math.acos(threshold) + 1e-6))

    return run


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, seed: int = 42, block_rows: int = BLOCK_ROWS, max_cells: int = 1024
) -> DataFrame:
    """One row per row of ``vectors``: (id_col, n_links, component_id, kept).

    Rows of the same non-null label link when their cosine is at least ``threshold``; n_links counts a row's links,
    component_id is the smallest id that links reach, kept says it is the row's own. Unusable vectors, those of
    another size than the commonest and rows without label link with nothing. Equal vectors of a label are one
    class with a count, so copies aren't paired; classes are compared in pairs of bounded blocks, which return
    counts and spanning edges instead of pairs. Rows with a null id get a null component of their own, repeated rows
    a row each; extra columns are left out.

    Blocks lie in cells, a vector in that of its nearest pivot (up to ``max_cells`` vectors, those of least hash); only
    pairs of blocks whose cells are too far apart for a link are left out, whatever a label's size. So no link is
    lost to the search, but the work on one label whose cells all lie close grows with the square of its vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    live = rows.where(usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    size = common_size(live, "v")
    live = live.where(F.size("v") == size)
    classes = cut(live.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    turn = rotation(size, seed) if size else np.zeros((0, 0))
    cells = min(max_cells, max(1, classes.count() // (16 * block_rows)))
    chosen = classes.select("v").orderBy(F.xxhash64("v", F.lit(seed)), "rep").limit(cells).toArrow()["v"].combine_chunks()
    pivots = matrix(chosen, size) if len(chosen) else np.ones((1, max(1, size)))
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), size)
            nearness = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearness.argmax(axis=1).astype(np.int32)), pa.array(np.arccos(np.clip(nearness.max(axis=1), -1, 1)))], names=["label", "rep", "v", "copies", "cell", "angle"])

    types = {f.name: f.dataType.simpleString() for f in classes.schema}
    table = cut(classes.select("label", "rep", "v", "copies").mapInArrow(placed, f"label {types['label']}, rep bigint, v {types['v']}, copies bigint, cell int, angle double"))
    packed = cut(blocks(table, ["label", "cell"], "rep", ["rep", "v", "copies"], block_rows))
    sized = packed.groupBy("label", "cell").agg(F.max("block").alias("last")).join(table.groupBy("label", "cell").agg(F.max("angle").alias("most")), ["label", "cell"])
    side = lambda n: sized.select("label", F.col("cell").alias(f"c{n}"), F.col("most").alias(f"most{n}"), F.col("last").alias(f"last{n}"))
    met = side(1).join(side(2), "label").where("c1 <= c2").select("label", "c1", "c2", "most1", "most2", "last1", "last2")
    met = met.mapInArrow(close_cells(pivots, threshold), met.schema)
    listed = met.select("label", "c1", "c2", "last2", F.explode(F.sequence(F.lit(0), F.col("last1"))).alias("b1"))
    listed = listed.select("label", "c1", "c2", "b1", F.explode(F.sequence(F.lit(0), F.col("last2"))).alias("b2")).where("c1 < c2 or b1 <= b2")
    part = lambda n: packed.select("label", F.col("cell").alias(f"c{n}"), F.col("block").alias(f"b{n}"), F.col("members").alias(f"m{n}"))
    pairs = listed.join(part(1), ["label", "c1", "b1"]).join(part(2), ["label", "c2", "b2"]).select((F.expr("c1 = c2 and b1 = b2")).alias("same"), "m1", "m2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                same, m, n = b.column(0)[i].as_py(), b.column(1)[i].values, b.column(2)[i].values
                (ids, copies), (ids2, copies2) = ((z.field(0).to_numpy(), z.field(2).to_numpy()) for z in (m, n))
                x, y = matrix(m.field(1), size), matrix(n.field(1), size)
                cx = binary_codes(x, turn)
                ok = close_pairs(x, y, cx, cx if same else binary_codes(y, turn), threshold)
                if same:
                    ok |= ok.T
                    np.fill_diagonal(ok, False)
                links = ok @ copies2
                left, right = spanning_edges(ok)
                a, c, k = [ids[links > 0], ids[left]], [np.full((links > 0).sum(), -1), ids2[right]], [links[links > 0], np.zeros(len(left), int)]
                if not same:
                    back = ok.T @ copies
                    a, c, k = [*a, ids2[back > 0]], [*c, np.full((back > 0).sum(), -1)], [*k, back[back > 0]]
                a, c, k = (np.concatenate(z).astype(np.int64) for z in (a, c, k))
                yield batch(a=a, b=pa.array(c, mask=k > 0), n=k)

    with small_batches(spark):
        found = cut(pairs.mapInArrow(compare, "a bigint, b bigint, n bigint"))
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("b is not null").select("a", "b"))
    named = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = live.join(named, ["label", "v"]).select("id", "n_links", "component_id")
    mine = usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("v") == size)
    alone = rows.where(~mine).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
