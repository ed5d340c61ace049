"""Shared-folder work tables and small session helpers of the llm operators.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` (a folder that
every executor reaches), never by a local checkpoint, so a lost executor costs
a re-read and not a failed job.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Most bytes in an Arrow batch.
BATCH_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the cluster; a temporary one only where none is named and all runs on this machine, as in tests."""
    folder = spark.conf.get(_KEY, None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {_KEY} to a folder that every executor reaches")
        folder = "file://" + tempfile.mkdtemp(prefix="foliolake-")
        spark.conf.set(_KEY, folder)
    return folder


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def arrow_bytes(spark: SparkSession) -> None:
    """Documents are long, so an Arrow batch has a size in bytes; one value for all operators, as plans run later than they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def trimmed(run):
    """A batch function whose freed memory goes back to the system when a task ends: workers live on, and so would it."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return inner


def partitions_for(df: DataFrame, most: int) -> int:
    """Shuffle partitions for ``df``: the session's number, and more where the plan's size estimate gives each over ``most`` bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # sources without statistics claim an absurd size, which says nothing
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // most) if size < 1 << 60 else 1)


class Scratch:
    """Tables of one run: ``save`` writes and rereads, ``drop`` deletes early, the rest goes at exit."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        atexit.register(self._delete, "")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(name)

    def _delete(self, name: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:  # the session ended before
            return
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
