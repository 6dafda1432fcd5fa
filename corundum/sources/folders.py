"""Folders that all executors share.

A folder of intermediate tables belongs to the job that asked for it. Tables that nothing reads any more
are removed at once; what a result still reads stays until the session's JVM ends, which removes it. A
JVM that is killed can't: vacuum() removes what is older than any job that may still read it."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Of the names of folders of intermediate tables.
PREFIX = "tables-"


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session may do without that setting:
    it gets one below the machine's own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "corundum-work")
    folder = f"{base.rstrip('/')}/{PREFIX}{uuid.uuid4().hex}"
    fs, p = _at(spark, folder)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return folder


def vacuum(spark: SparkSession, base: str, hours: float) -> int:
    """Remove folders of intermediate tables below base that are older than so many hours: those of
    sessions that were killed. Returns how many."""
    fs, p = _at(spark, base)
    if not fs.exists(p):
        return 0
    old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(PREFIX) and s.getModificationTime() < (time.time() - hours * 3600) * 1000]
    for x in old:
        fs.delete(x, True)
    return len(old)


def _at(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def settled(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read back: what follows no longer depends on what df was read from."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
