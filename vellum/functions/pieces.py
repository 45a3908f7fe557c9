"""Python functions over Arrow columns, a few rows at a time, so that a task holds no more Python objects for large batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a batch that become Python objects at once; a single row may have more.
PIECE = 1 << 20


def pieces(columns: tuple[pa.Array, ...], most: int = PIECE) -> Iterator[tuple[pa.Array, ...]]:
    """The same rows in order, halved until a piece has at most so many bytes or is one row."""
    n = len(columns[0])
    if n <= 1 or sum(c.nbytes for c in columns) <= most:
        yield columns
        return
    yield from pieces(tuple(c.slice(0, n // 2) for c in columns), most)
    yield from pieces(tuple(c.slice(n // 2) for c in columns), most)


def over(run: Callable[..., list], kind: pa.DataType) -> Callable[..., pa.Array]:
    """Arrow function that applies run, lists of values to a list of values, to the pieces of a batch."""

    def whole(*columns: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(run(*(c.to_pylist() for c in piece)), kind) for piece in pieces(columns)])

    return whole


def streamed(run: Callable[..., pa.Array], after: Callable[[], None] = lambda: None) -> Callable[[Iterator[tuple[pa.Array, ...]]], Iterator[pa.Array]]:
    """Arrow function over the batches of a task: run makes a column of each piece, which leaves by itself.

    For results of the size of their rows: a task holds one batch of input and one piece of results. after: called
    when the last batch is gone.
    """

    def work(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in pieces(batch if isinstance(batch, tuple) else (batch,)):  # Spark gives a single column bare
                yield run(*piece)
            del batch, piece
        after()

    return work


def batched(run: Callable[[list], list], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The batches with run applied to their last column. Each piece leaves as a batch by itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *kept, last in pieces(tuple(batch.columns)):
                yield pa.RecordBatch.from_arrays([*kept, pa.array(run(last.to_pylist()), kind)], names=batch.schema.names)

    return work


def replaced(df: DataFrame, kept: list[str], column: str, name: str, run: Callable[[list], list], kind: pa.DataType, ddl: str) -> DataFrame:
    """(kept, name): name is what run makes of the column, for results that are much larger than a row.

    A task holds one batch of input and one piece of the results.
    """
    rows = df.select(*kept, F.col(column).alias(name))
    schema = rows.withColumn(name, F.lit(None).cast(ddl)).schema
    return rows.mapInArrow(batched(run, kind), schema)
