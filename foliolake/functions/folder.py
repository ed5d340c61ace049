"""Folders that every executor reaches, for tables that a job writes and reads again."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the cluster; a temporary one only where none is named and all runs on this machine, as in tests."""
    folder = spark.conf.get(_KEY, None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {_KEY} to a folder that every executor reaches")
        path = tempfile.mkdtemp(prefix="foliolake-")
        atexit.register(shutil.rmtree, path, True)
        folder = f"file://{path}"
        spark.conf.set(_KEY, folder)
    return folder


def _path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _path(spark, path)
    return system.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, system = _path(spark, path)
    system.delete(p, True)


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of a file or folder: names, sizes and times of change. Another state has another digest."""
    p, system = _path(spark, path)
    found = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in system.listStatus(p))
    return hashlib.sha256(repr(found).encode()).hexdigest()[:32]


def saved(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a folder of its own, for a plan that reads it more than once."""
    return saved(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def kept(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table made from what lies at ``source``: written once in the shared folder, and again when files there change."""
    path = f"{shared_folder(spark)}/{name}-{state_of(spark, source)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
