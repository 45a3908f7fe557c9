"""Near-dedup by the Jaccard similarity of word shingles: candidates by MinHash bands, then an exact check.

A text is the set of its runs of SHINGLE words. Two texts are near copies if their sets have a Jaccard similarity
of SIMILARITY at least. Each text has BANDS hashes of ROWS minima each; two texts of similarity s share one of them
with probability 1 - (1 - s^ROWS)^BANDS, which is 0.99993 at 0.8. In each group of texts that share a band, every
text becomes a candidate with the group's smallest text, in one of ORDERS orders by band, so candidates grow with
the texts and not with the square of a group. All candidates are checked on their whole sets.

SimHash at a radius for 0.8 would not do: such pairs differ in about ten of 64 bits, and shards that stay exact for
so many bits are so many or so large that their work grows with the square of the corpus.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.pieces import streamed
from vellum.llm.common import idle_memory, text_of, written
from vellum.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
ORDERS = 3
SEED = 42
#: Shingles whose minima are taken at a time.
RUN = 1 << 12
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, (1 << 64) - 1, BANDS * ROWS, np.uint64, endpoint=True) | np.uint64(1)
_C = np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of the word shingles of a text; of one with fewer words, of all its words. A-Z count as a-z."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0] + [e + 1 for e in ends[:-1]]
    ends = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends)]), dtype=np.uint64))


def band_hashes(hashes: np.ndarray) -> np.ndarray:
    """One signed hash for each band; none for a text without words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), RUN):
        np.minimum(low, (hashes[None, at : at + RUN] * _FACTORS[:, None]).min(axis=1), out=low)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ column) * _C
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two arrays of distinct hashes; two empty ones are alike."""
    same = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - same
    return same / union if union else 1.0


def links(texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of checked near copies. texts: (node, text), one text for each node; rows may be repeated."""

    def bands(column: pa.Array) -> pa.Array:
        return pa.array([band_hashes(shingle_hashes(t, shingle)) for t in column.to_pylist()], pa.list_(pa.int64()))

    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([jaccard(shingle_hashes(a, shingle), shingle_hashes(b, shingle)) for a, b in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    cut = written(texts.select("node", F.arrow_udf(streamed(bands, idle_memory), "array<long>")("text").alias("bands")))
    spread = written(cut.select("node", F.posexplode("bands").alias("at", "band")).distinct())
    first = F.min(F.struct(F.xxhash64("node", F.col("at") % ORDERS).alias("rank"), F.col("node").alias("to")))["to"]
    tops = written(spread.groupBy("at", "band").agg(F.count("*").alias("n"), first.alias("to")).where("n > 1").drop("n"))
    pairs = written(spread.join(tops, ["at", "band"]).where("node != to").select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct())
    ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
    held = written(texts.join(ends, F.col("node") == F.col("end")).groupBy("node").agg(F.first("text").alias("text")))
    both = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
    return both.where(F.arrow_udf(streamed(alike, idle_memory), "double")("x", "y") >= similarity).select("a", "b")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of df, with their columns, less those that near copies of a smaller key make superfluous.

    Of each group that near copies connect, the rows of its smallest key stay. Rows with a null key all stay unless
    their group has a key. Texts without words are copies only if they are equal; null counts as empty.
    """
    node = F.xxhash64(text_of(text))
    texts = df.select(node.alias("node"), text_of(text).alias("text"))
    roots = components(links(texts, similarity, shingle))
    keys = df.select(node.alias("node"), F.col(key).alias("key"))
    grouped = written(keys.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "key", F.coalesce("root", "node").alias("root")))
    smallest = written(grouped.groupBy("root").agg(F.min("key").alias("least")))
    lost = grouped.join(smallest, "root").where(F.col("least").isNotNull() & ~F.col("key").eqNullSafe(F.col("least")))
    lost = written(lost.select(F.col("node").alias("_node"), F.col("key").alias("_key")).distinct())
    return df.join(lost, (node == F.col("_node")) & F.col(key).eqNullSafe(F.col("_key")), "left_anti")
