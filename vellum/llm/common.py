"""Tables, shared storage and column names used by every operator of the subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(part: str, parts: int, column: str = "doc_id") -> Column:
    """True for rows whose crc32(column as text) mod parts is part; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts == int(part)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not use yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which all executors and the driver share.

    Where no such folder is set a single machine makes a temporary one, as in tests; a cluster needs the setting.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/vellum-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, at: str) -> None:
    """Has the folder deleted when the driver ends; results may be read from it until then."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)


def written(df: DataFrame, release: bool = False) -> DataFrame:
    """The same rows, computed once and read back as a table in the shared folder, so that lost executors lose nothing.

    release: the shuffle files behind them are deleted as soon as the table is there, not when the driver frees memory.
    """
    spark, at = df.sparkSession, shared_dir(df.sparkSession)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    try:
        spark.conf.set(name, "true" if release else before)
        df.write.parquet(at)
    finally:
        spark.conf.set(name, before)
    until_exit(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def idle_memory() -> None:
    """Gives freed memory back: Spark keeps Python workers for a minute after their tasks, beside the next ones."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
