"""SimHash near-dedup with BK-trees.

Fingerprints are compared per distinct value. Two of them that differ in at most two of 64 bits agree in at least
two of four blocks of 16 bits, so each fingerprint goes to six shards, one for each choice of two blocks, and
every link lies inside a shard. A shard's BK-tree hangs each fingerprint below its parent by their Hamming
distance, and a search follows only the edges within the radius of the distance at hand. Trees reach their probes
by the shuffle that makes the shards: broadcasting them would put the fingerprints of all documents through the
driver. A shard of more than TREE_SIZE fingerprints is dealt again by two of four blocks of its open bits, and
once more after that; the third deal leaves eight open bits, so a shard then has 256 distinct fingerprints at
most. All deals are exact, and no group is unbounded.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.pieces import streamed
from vellum.llm.common import free_name, idle_memory, text_of, written
from vellum.llm.components import components

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
TREE_SIZE = 512
#: Shingles hashed between two additions to the bit counts.
RUN = 1 << 15


def fingerprint_of(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, 0 without words. A-Z count as a-z."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    ends = ends[shingle - 1 :] or ends[-1:]
    counts, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_digest
    for at in range(0, len(ends), RUN):
        packed = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + RUN], ends[at : at + RUN])])
        counts += np.unpackbits(np.frombuffer(packed, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of each whole text as a signed long; null texts count as empty and have 0."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t.as_py() or "", shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return df.withColumn(out, F.arrow_udf(streamed(run, idle_memory), "long")(F.col(text)))


class BKTree:
    """Fingerprints below their parents, keyed by the Hamming distance to them."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while distance := (value ^ node[0]).bit_count():
            if distance not in node[1]:
                node[1][distance] = (value, {})
                return
            node = node[1][distance]

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            at, below = todo.pop()
            distance = (value ^ at).bit_count()
            if distance <= radius:
                found.append(at)
            todo += [child for d, child in below.items() if distance - radius <= d <= distance + radius]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest fingerprint of its component within the shard), for those that are not it."""
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    tree = BKTree()
    for v in values:
        for near in tree.within(v, radius):
            a, b = top(v), top(near)
            parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, top(v)) for v in values if top(v) != v]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _deals(fixed: int) -> list[int]:
    """The masks that fix two of four blocks of the bits that the mask leaves open, besides its own."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    width = len(free) // 4
    blocks = [sum(1 << i for i in free[k * width : (k + 1) * width]) for k in range(4)]
    return [fixed | a | b for a, b in combinations(blocks, 2)]


def _search(batches):
    """Sorted by shard, so that a shard's rows follow one another; a shard has TREE_SIZE rows at most."""
    held: tuple | None = None
    values: list[int] = []

    def flush(found):
        if len(values) > 1:
            found += shard_links(values, RADIUS)

    for batch in batches:
        found: list[tuple[int, int]] = []
        for mask, key, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (mask, key) != held:
                flush(found)
                held, values = (mask, key), []
            values.append(value & (1 << 64) - 1)
        yield _pairs(found)
    found = []
    flush(found)
    yield _pairs(found)


def _pairs(found) -> pa.RecordBatch:
    both = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def links(values: DataFrame, value: str = "fingerprint") -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within RADIUS of each other or in one shard's component.

    They connect exactly what the links at RADIUS connect: a shard's component is given as a star around its
    smallest fingerprint. values: distinct fingerprints.
    """
    spark = values.sparkSession
    found, masks = [], [0]
    level = values.select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("key"), F.col(value).alias("value"))
    for turn in range(3):
        deals = {m: _deals(m) for m in masks}
        masks = sorted({m for d in deals.values() for m in d})
        if turn == 0:
            dealt = level.withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)) for m in deals[0]])))
        else:
            # at most 216 rows, whatever the data
            step = spark.createDataFrame([(_signed(m), _signed(d)) for m, ds in deals.items() for d in ds], "mask long, deal long")
            dealt = level.join(F.broadcast(step), "mask").drop("mask").withColumnRenamed("deal", "mask")
        dealt = dealt.select("mask", F.col("value").bitwiseAND(F.col("mask")).alias("key"), "value").distinct() if turn else dealt.select("mask", F.col("value").bitwiseAND(F.col("mask")).alias("key"), "value")
        sizes = written(dealt.groupBy("mask", "key").count().where("count > 1"))
        shared = dealt.join(sizes, ["mask", "key"])
        last = turn == 2
        trees = (shared if last else shared.where(F.col("count") <= TREE_SIZE)).select("mask", "key", "value")
        found.append(trees.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_search, "a long, b long"))
        if last or sizes.where(F.col("count") > TREE_SIZE).isEmpty():
            break
        level = written(shared.where(F.col("count") > TREE_SIZE).select("mask", "key", "value"))
    return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of df: key, fingerprint (signed long) and component_id.

    component_id: the smallest key reachable over links, the row's own included; rows with a null key take part
    and have that of their group, null if it has no other key. Texts that are null, empty or white space have
    fingerprint 0 and link like any other. Repeated rows stay repeated. An empty table gives none.
    """
    slim = written(fingerprint(df.select(F.col(key).alias("key"), text_of(text).alias("text")), "text", "fingerprint", shingle).select("key", "fingerprint"))
    values = written(slim.groupBy("fingerprint").agg(F.min("key").alias("first")))
    roots = components(links(values))
    known = values.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    known = written(known)
    smallest = written(known.groupBy("root").agg(F.min("first").alias("component_id")))
    named = written(known.join(smallest, "root").select("fingerprint", "component_id"))
    return slim.join(named, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of df, with their columns, of one document for each component: the one whose key is smallest.

    Rows of one key are one document; of repeated rows of a kept key one stays. Rows whose component has no key
    but null all stay, as nothing tells them apart.
    """
    groups = near_duplicates(df, key, text, shingle)
    kept, times = free_name(df, "_kept"), free_name(df, "_times")
    chosen = groups.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(F.col(key).alias(kept)).agg(F.count("*").alias(times))
    chosen = written(chosen)
    # one plan at every size: texts and kept keys meet by a sort-merge join
    rows = df.join(chosen.hint("merge"), F.col(key).eqNullSafe(F.col(kept)))
    several = chosen.where((F.col(times) > 1) & F.col(kept).isNotNull())
    if several.isEmpty():
        return rows.select(*df.columns)
    single = rows.where((F.col(times) == 1) | F.col(key).isNull()).select(*df.columns)
    return single.unionByName(df.join(several, F.col(key) == F.col(kept)).select(*df.columns).dropDuplicates([key]))
