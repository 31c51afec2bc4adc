"""Tables that a job writes for its own later steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Event, Thread

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share; below a local one only where it is unset (tests)."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        top = spark.sparkContext.getCheckpointDir()
    return f"{top}/stage-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, for results that several branches or many steps use."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch`` named, once no later step reads it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop(path), True)


@contextmanager
def shuffles_cleaned(spark: SparkSession, seconds: float = 20.0) -> Iterator[None]:
    """Collects the driver's garbage at this interval, upon which Spark deletes the shuffle files of tables no longer referred to."""
    done = Event()

    def collect() -> None:
        while not done.wait(seconds):
            spark.sparkContext._jvm.System.gc()

    thread = Thread(target=collect, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
