"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; a single machine without the setting makes a temporary one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/vellum-{uuid.uuid4().hex}"


def _store(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def written(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back as a table, so that later passes and lost executors repeat nothing.

    The table goes with the innermost scope, else when the driver ends.
    """
    spark = df.sparkSession
    at = folder(spark)
    df.write.parquet(at)
    store, path = _store(spark, at)
    store.deleteOnExit(path)
    if _scopes:
        _scopes[-1].append(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end: run there what reads them, lazy results included."""
    _scopes.append([])
    try:
        yield
    finally:
        for at in _scopes.pop():
            store, path = _store(spark, at)
            store.delete(path, True)
