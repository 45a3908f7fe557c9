"""Append-only logs whose schema grows: a folder for each version, read as one table with back-filled columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.accounts import latest

VERSION = "version"


def append(rows: DataFrame, folder: str, version: int) -> None:
    """Adds rows to a version of a log. Versions differ in their columns alone, later ones having more."""
    rows.write.mode("append").parquet(f"{folder}/{VERSION}={version:05d}")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that a log has, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [s.getPath().getName() for s in store.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{VERSION}="))


def read(spark: SparkSession, folder: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """All rows of a log with the columns of all its versions.

    A column that a version has not is null there, or its default; a null that was written stays. A column whose type
    changed, or a log without versions, is an error.
    """
    found = [spark.read.parquet(f"{folder}/{VERSION}={v:05d}") for v in versions(spark, folder)]
    if not found:
        raise ValueError(f"{folder} has no versions")
    types: dict[str, object] = {}
    for df in found:
        for f in df.schema:
            if types.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"{f.name} was {types[f.name].simpleString()} and became {f.dataType.simpleString()}")
    filled = (df.withColumns({c: F.lit((defaults or {}).get(c)).cast(t) for c, t in types.items() if c not in df.columns}) for df in found)
    return reduce(lambda a, b: a.unionByName(b), filled).select(*types)


def compact(spark: SparkSession, folder: str, to: str, key: str, order: str, deleted: str | None = None, defaults: dict[str, object] | None = None) -> None:
    """Writes a log's last row of each key as the only version of another log, without the keys that were deleted."""
    rows = read(spark, folder, defaults)
    kept = rows.groupBy(key).agg(F.max(order).alias(order))
    current = latest(rows, key, order, deleted).join(kept, key)
    last = versions(spark, folder)[-1]
    extra = {deleted: F.lit(False)} if deleted else {}
    current.withColumns(extra).select(*rows.columns).write.mode("overwrite").parquet(f"{to}/{VERSION}={last:05d}")
