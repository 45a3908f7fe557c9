"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut into two halves, and each half is quantised by its own codebook (k-means in numpy on a bounded
sample, on which the share below is measured as well). A cell is a pair of centroids. A query walks the pairs in the
order of their summed distances with a heap (the multi-sequence algorithm) until the cells it took hold the wanted
share of all entries, and the entries of these cells are reranked by the cosine of the original vectors.

Equal vectors are one entry with its few smallest ids, which loses nothing of a result of as many. Entries stand in
the order of their cells in blocks of about BLOCK; a cell with more of them spans several blocks. A query visits the
blocks that hold its cells, and a block's queries are dealt to groups of about GROUP, so no task meets more than a
block and a group at a time, and nothing is cut off.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import written

CENTROIDS = 128
#: Entries, and numbers in them, that the driver fits the codebooks on at most.
SAMPLE, SAMPLE_NUMBERS = 20_000, 4 << 20
#: The recall for which the share of entries that a query reranks is measured, and the queries that measure it.
RECALL, MEASURED = 0.95, 512
BLOCK, GROUP = 2048, 512


def usable(column: str):
    """True for vectors that take part."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def kmeans(points: np.ndarray, k: int, rounds: int = 15, seed: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = _distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0)


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells (left centroid * number of right ones + right centroid) by ascending summed distance, until they hold
    wanted entries; empty cells are passed over."""
    i_order, j_order = left.argsort(kind="stable"), right.argsort(kind="stable")
    heap, pushed, out, held = [(left[i_order[0]] + right[j_order[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(i_order[i]) * len(right) + int(j_order[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(left) and b < len(right) and (a, b) not in pushed:
                pushed.add((a, b))
                heapq.heappush(heap, (left[i_order[a]] + right[j_order[b]], a, b))
    return out


def reach(points: np.ndarray, books: list[np.ndarray], half: int, k: int, recall: float, queries: int = MEASURED, seed: int = 5) -> float:
    """The least share of entries whose cells hold that share of the k nearest of a sample's own points.

    Worked out on the sample by brute force. Among more entries the nearest are nearer, so a smaller share would do.
    """
    n = len(points)
    if n <= k + 1:
        return 1.0
    left, right = _distances(points[:, :half], books[0]), _distances(points[:, half:], books[1])
    cells = left.argmin(axis=1) * len(books[1]) + right.argmin(axis=1)
    sizes = np.bincount(cells, minlength=len(books[0]) * len(books[1]))
    shares = []
    for q in np.random.default_rng(seed).choice(n, min(queries, n), replace=False):
        near = points @ points[q]
        near[q] = -np.inf
        order = (left[q][:, None] + right[q]).ravel().argsort(kind="stable")
        held = np.empty(len(order))
        held[order] = sizes[order].cumsum()
        shares.append(held[cells[np.argpartition(-near, k - 1)[:k]]] / n)
    return float(np.quantile(np.concatenate(shares), recall, method="higher"))


def cosines(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Cosine of each query with each entry, in doubles and in one order of summing, whatever stands beside them."""
    q, e = (m / np.abs(m).max(axis=1, keepdims=True) for m in (queries, entries))
    top = np.stack([(q[i] * e).sum(axis=1) for i in range(len(q))]) if len(q) else np.zeros((0, len(e)))
    return top / np.sqrt((q * q).sum(axis=1))[:, None] / np.sqrt((e * e).sum(axis=1))


def search(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, centroids: int = CENTROIDS, share: float | None = None, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """The k nearest entries found for each query: query_id, rank from 1, vec_id, score (cosine in doubles).

    Nearest first, ties to the smaller id; all entries, if there are fewer than k besides the query's own id.
    queries and df share key and vector. Rows with a null id take no part, nor do vectors that are null, empty,
    zero, or hold a null or non-finite number, nor those of another length than most. Rows repeated with id and
    vector count once; an id with several vectors is an entry with each. Empty tables give no rows. Other columns
    of either table are not read. Ids that are not numbers are cast to long, and fail or count as null by the session.

    share: of the entries that a query reranks at least; if none is given, the one that holds recall of the nearest
    of a bounded sample, see reach. A query's vector goes to each block it visits, so what is shuffled grows with
    queries times share times entries.
    """
    spark = df.sparkSession
    good = lambda d: d.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    out = "query_id long, rank int, vec_id long, score double"
    widths = good(df).groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return spark.createDataFrame([], out)
    width = widths["width"]
    # one entry for equal vectors, with its k + 1 smallest ids: the query's own may be one of them
    ids = good(df).where(F.size("v") == width).withColumn("hash", F.xxhash64("v")).distinct()
    entries = written(_smallest_ids(ids, k + 1))

    drawn = entries.orderBy(F.xxhash64("hash"), "hash").limit(max(1, min(sample, SAMPLE_NUMBERS // width))).select("v").collect()
    points = _unit(np.array([r["v"] for r in drawn]))
    half = width // 2
    books = [kmeans(points[:, :half], centroids), kmeans(points[:, half:], centroids)] if half else [np.zeros((1, 0)), kmeans(points, centroids)]
    shape = (len(books[0]), len(books[1]))
    share = reach(points, books, half, k, recall) if share is None else share
    shared = spark.sparkContext.broadcast(books)

    def cell_of(vectors: pa.Array) -> pa.Array:
        unit = _unit(_matrix(vectors, width))
        a, b = (_distances(unit[:, part], book).argmin(axis=1) for part, book in zip((slice(0, half), slice(half, None)), shared.value))
        return pa.array((a * shape[1] + b).astype(np.int32))

    indexed = written(entries.withColumn("cell", F.arrow_udf(cell_of, "int")("v")))
    sizes = np.zeros(shape[0] * shape[1], np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        sizes[r["cell"]] = r["count"]
    wanted = max(k + 1, int(np.ceil(share * sizes.sum())))
    layout = spark.sparkContext.broadcast((sizes, np.concatenate([[0], np.cumsum(sizes)])))

    def block_of(cell: pa.Array, hashed: pa.Array) -> pa.Array:
        n, at = layout.value
        c = cell.to_numpy()
        return pa.array((at[c] + hashed.to_numpy() % n[c]) // block)

    def visits_of(vectors: pa.Array) -> pa.Array:
        unit = _unit(_matrix(vectors, width))
        a, b = (_distances(unit[:, part], book) for part, book in zip((slice(0, half), slice(half, None)), shared.value))
        return pa.array([_blocks(walk(x, y, layout.value[0], wanted), *layout.value, block) for x, y in zip(a, b)], pa.list_(pa.struct([("block", pa.int64()), ("cells", pa.list_(pa.int32()))])))

    placed = indexed.withColumn("block", F.arrow_udf(block_of, "long")("cell", "hash"))
    asked = good(queries).where(F.size("v") == width).distinct()
    # a walk costs much more than the row it starts from
    n = asked.count()
    asked = asked.repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 16), n // 2048), "id")
    visits = F.explode(F.arrow_udf(visits_of, "array<struct<block:bigint,cells:array<int>>>")("v"))
    asked = written(asked.select("id", "v", visits.alias("visit")).select("id", "v", "visit.block", "visit.cells"))
    groups = written(asked.groupBy("block").agg(F.ceil(F.count("*") / group).cast("int").alias("groups")))
    left = asked.join(groups, "block").select("block", F.pmod(F.xxhash64("id"), "groups").cast("int").alias("group"), "id", "v", "cells")
    right = placed.join(groups, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "cell", "ids", "v")
    near = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(_rerank(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """(hash, v, ids): the n smallest ids of each vector, first within parts of them, then over the parts.

    The parts bound what one task gathers of a vector that very many rows have.
    """
    parts = max(64, rows.count() // 1000)
    for name in ("part", None):
        by = ["hash", "v"] + ([name] if name else [])
        if name:
            rows = rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(parts)))
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("at") <= n).drop("at")
    return rows.groupBy("hash", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(cells: list[int], sizes: np.ndarray, at: np.ndarray, block: int) -> list[dict]:
    """The blocks that hold some of the cells, with these cells."""
    cells = np.sort(np.array(cells))
    first, last = at[cells] // block, (at[cells] + sizes[cells] - 1) // block
    spans = last - first + 1
    held = np.repeat(first, spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
    cell = np.repeat(cells, spans).astype(np.int32)
    heads = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    return [{"block": int(b), "cells": c} for b, c in zip(held[heads], np.split(cell, heads[1:]))]


def _rerank(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            entries, ids, cells = np.stack(right["v"].to_numpy()), right["ids"].to_list(), right["cell"].to_numpy()
            units = _unit(entries)
            asked = np.stack(left["v"].to_numpy())
            rough = _unit(asked) @ units.T
            for i, (query, own) in enumerate(zip(left["id"].tolist(), left["cells"])):
                inside = np.flatnonzero(np.isin(cells, own))
                row = rough[i, inside]
                # k + 1 entries at least, and all that may tie with the last of them
                cut = np.partition(row, -(k + 1))[-(k + 1)] - 1e-9 if len(row) > k + 1 else -np.inf
                close = inside[row >= cut]
                scores = cosines(asked[i : i + 1], entries[close])[0]
                found = [(-s, v) for s, e in zip(scores.tolist(), close.tolist()) for v in ids[e].tolist() if v != query]
                out += [(query, v, -s) for s, v in heapq.nsmallest(k, found)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run
