"""A keyed table that a stream of batches keeps up to date (survey A6, A12, L5)."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.stages import remove


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class KeyedTable:
    """One row a key, in ``buckets`` folders by a hash of the key; ``order`` columns say which of two rows of a key stays.

    A batch rewrites only the buckets that it touches, into a folder of its number, and then a list of where each bucket
    lies is put in place by one rename: readers see the table before or after a batch, never between. A batch that is done
    again starts from the list before it, so it changes nothing. What no list of the last two batches names is removed.
    """

    path: str
    key: str
    order: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def lists(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches whose lists are there, in order."""
        place, fs = _hadoop(spark, f"{self.path}/lists")
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def places(self, spark: SparkSession, number: int) -> dict[int, int]:
        """Which batch wrote each bucket last, as of a batch: ``buckets`` entries at most."""
        place, fs = _hadoop(spark, f"{self.path}/lists/batch={number}")
        file = fs.open(place)
        try:
            found = json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(file)))
        finally:
            file.close()
        return {int(b): written for b, written in found.items()}

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Take a batch in: a ``foreachBatch`` function. Rows that are equal in ``order`` don't replace what is there."""
        spark = batch.sparkSession
        before = [n for n in self.lists(spark) if n < number]
        held = self.places(spark, before[-1]) if before else {}
        rows = batch.persist()
        try:
            touched = [r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # ``buckets`` at most
            if touched:
                fresh = rows.withColumn("_new", F.lit(1))
                old = self._read(spark, {b: held[b] for b in touched if b in held})
                both = fresh if old is None else fresh.unionByName(old.select(*rows.columns).withColumn("_new", F.lit(0)))
                place = F.struct(*self.order, -F.col("_new"))
                kept = both.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), place).alias("r")).select("r.*")
                kept.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        finally:
            rows.unpersist()
        self._list(spark, held | dict.fromkeys(touched, number), number)
        self._clean(spark, number)

    def _list(self, spark: SparkSession, held: dict[int, int], number: int) -> None:
        beside, final = f"{self.path}/beside-{number}", f"{self.path}/lists/batch={number}"
        target, fs = _hadoop(spark, final)
        fs.mkdirs(target.getParent())
        file = fs.create(_hadoop(spark, beside)[0], True)
        file.write(bytearray(json.dumps(held).encode()))
        file.close()
        fs.delete(target, True)  # only a batch that is done again finds one
        if not fs.rename(_hadoop(spark, beside)[0], target):
            raise OSError(f"cannot put {final} in place")

    def _clean(self, spark: SparkSession, number: int) -> None:
        numbers = [n for n in self.lists(spark) if n <= number]
        for old in numbers[:-2]:
            remove(spark, f"{self.path}/lists/batch={old}")
        named = {(w, b) for n in numbers[-2:] for b, w in self.places(spark, n).items()}
        place, fs = _hadoop(spark, f"{self.path}/data")
        for folder in fs.listStatus(place) if fs.exists(place) else []:
            written = int(folder.getPath().getName().removeprefix("batch="))
            inside = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("bucket=")]
            gone = [p for p in inside if (written, int(p.getName().removeprefix("bucket="))) not in named and written <= number]
            for p in gone:
                fs.delete(p, True)
            if inside and len(gone) == len(inside):
                fs.delete(folder.getPath(), True)

    def _read(self, spark: SparkSession, places: dict[int, int]) -> DataFrame | None:
        found = [f"{self.path}/data/batch={written}/bucket={b}" for b, written in sorted(places.items())]
        return spark.read.parquet(*found) if found else None

    def before(self, spark: SparkSession, number: int) -> DataFrame | None:
        """The table as a batch finds it, also one that is done again; none before the first row."""
        numbers = [n for n in self.lists(spark) if n < number]
        return self._read(spark, self.places(spark, numbers[-1])) if numbers else None

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The table as of the last batch, one row a key; none before the first row."""
        numbers = self.lists(spark)
        return self._read(spark, self.places(spark, numbers[-1])) if numbers else None
