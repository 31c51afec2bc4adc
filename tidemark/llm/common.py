"""Helpers shared by the corpus operators: cutting lineage, linking within buckets, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; a local one only where it is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


#: Members of one bucket held in memory at most; larger buckets are linked through midpoints.
BUCKET_ROWS = 65_536
#: Buckets of up to so many members are compared side by side, all at once.
FEW = 24


def _sphere(free: int, radius: int) -> np.ndarray:
    """All masks of 1 to ``radius`` bits out of the set bits of ``free``, and zero."""
    bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
    rings, last = [np.zeros(1, np.uint64)], [(np.uint64(0), -1)]
    for _ in range(radius):
        last = [(m | b, j) for m, k in last for j, b in enumerate(bits) if j > k]
        rings.append(np.array([m for m, _ in last], dtype=np.uint64))
    return np.concatenate(rings)


def link_bucket(values: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect exactly what pairs within ``radius`` bits connect: one edge for each value reached.

    Values reached leave the rest at once, so a dense group costs one sweep, not all its pairs.
    """
    left, right = [], []
    rest = values
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            hits = rest[near]
            if len(hits):
                left.append(np.full(len(hits), x))
                right.append(hits)
                frontier.extend(hits)
                rest = rest[~near]
    return left, right


def hamming_links(batches: Iterator[pa.RecordBatch], radius: int, masks: list[int], bucket_rows: int = BUCKET_ROWS) -> Iterator[pa.RecordBatch]:
    """From rows (t, key, fp) sorted by (t, key), fp distinct in each bucket, to edges (a, b) of fingerprints.

    A bucket beyond ``bucket_rows`` isn't held: each member is joined to all points within half the radius of it
    in the bits that the bucket leaves free. Two members are within the radius if and only if they share such a
    point (even radius), so components stay exact and the work linear.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_held, over = 0, None  # over: (t, key) of the bucket that is too large to hold

    def midpoints(t: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        around = _sphere(~masks[t] & (2**64 - 1), (radius + 1) // 2)
        for part in np.array_split(fps, max(1, len(fps) // 512)):
            a = np.repeat(part, len(around))
            b = (part[:, None] ^ around[None, :]).ravel()
            yield batch(a=a[a != b].view(np.int64), b=b[a != b].view(np.int64))

    def flush(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(fp) < 2:
            return
        starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(fp)])
        left, right = [fp[:0]], [fp[:0]]
        few = sizes <= FEW
        room = np.repeat(np.where(few, sizes, 0), sizes) - (np.arange(len(fp)) - np.repeat(starts, sizes)) - 1
        for step in range(1, int(sizes[few].max(initial=1))):  # members that have another so many rows on
            at = np.flatnonzero(room >= step)
            near = np.bitwise_count(fp[at] ^ fp[at + step]) <= radius
            left.append(fp[at[near]])
            right.append(fp[at[near] + step])
        for s, n in zip(starts[~few], sizes[~few], strict=True):
            a, b = link_bucket(fp[s : s + n], radius)
            left += a
            right += b
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            yield batch(a=a.view(np.int64), b=b.view(np.int64))

    for rows in batches:
        t, key, fp = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.view(np.uint64)
        if not len(fp):
            continue
        if over is not None:
            same = (t == over[0]) & (key == over[1])
            yield from midpoints(int(over[0]), fp[same])
            if same.all():
                continue
            t, key, fp, over = t[~same], key[~same], fp[~same], None
        held.append((t, key, fp))
        n_held += len(fp)
        t, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])[-1])
        yield from flush(t[:last], key[:last], fp[:last])
        held, n_held = [(t[last:], key[last:], fp[last:])], len(fp) - last
        if n_held > bucket_rows:
            over = (t[last], key[last])
            yield from midpoints(int(over[0]), fp[last:])
            held, n_held = [], 0
    if held:
        yield from flush(*held[0])


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least that the edges (a, b) connect it to."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[i], root[j]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


class Forest:
    """Edges added piece by piece; what they connect is kept by one edge a node."""

    def __init__(self, hold: int = 500_000):
        self._parts, self._n, self._hold = [], 0, hold

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self._parts.append((a, b))
        self._n += len(a)
        if self._n > self._hold:
            self.edges()
            self._hold = max(self._hold, 2 * self._n)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        self._parts = [contracted(*(np.concatenate(x) for x in zip((none, none), *self._parts, strict=True)))]
        self._n = len(self._parts[0][0])
        return self._parts[0]


def stars(batches: Iterator[pa.RecordBatch], hold: int = 500_000) -> Iterator[pa.RecordBatch]:
    """From edges (a, b) to edges (u, v) from each node to the least that it is connected to, over up to ``hold`` edges at a time."""
    held, n = [], 0
    for rows in batches:
        held.append([c.to_numpy() for c in rows.columns])
        n += rows.num_rows
        if n > hold:
            u, v = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield batch(u=u, v=v)
            held, n = [], 0
    if n:
        u, v = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield batch(u=u, v=v)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges(a, b)``, longs; component is the smallest node reachable.

    Each task first contracts the edges that lie in it. Then alternates large-star and small-star steps; both hang each node below the smallest neighbour known, so the
    number of rounds grows with the logarithm of the diameter and no group is ever gathered in a task.
    """
    known = cut(edges.where("a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(stars, "u bigint, v bigint").distinct())
    digest = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = known.agg(*digest).first()
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        known = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = known.agg(*digest).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        known.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def least_hashed(ids: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The ``rows`` rows whose ids hash lowest, marked for broadcast: ``rows`` bounds their size, so the texts that
    they select are read where they lie and never shuffled."""
    return F.broadcast(ids.orderBy(F.xxhash64(id_col), id_col).limit(rows))
