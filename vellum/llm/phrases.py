"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by deterministic coin tossing, the phrases get names that are hashes of what they hold,
and the row of names is cut again, level upon level. Where a cut falls depends only on a few neighbours, so equal
substrings are cut alike whatever their offset, and share all names but those at their rims.

A row of names is parsed so: runs of one name become one name with their length; of the rest, each name tosses
coins against its left neighbour (twice the position of the lowest bit in which they differ, plus that bit; done
twice, which leaves a small alphabet without equal neighbours), and a phrase begins where the coin is a local
minimum. Two neighbours are never both minima and minima are a bounded distance apart, so phrases hold two names
at least and a bounded number at most.

The fingerprint of a text is a bottom-k sketch (SKETCH smallest hashes) of the set of its names from the levels
whose phrases are long enough to be telling, a name's repeats counted apart; the levels are the same for texts of
any length. Likeness is the Jaccard similarity that two sketches estimate. A whole corpus is a map over rows; what needs the next document is
laid out by ranges of the key, a single shuffle.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import text_of

#: Hashes in a fingerprint, each of eight hex digits.
SKETCH = 64
#: Levels of phrases; names of level FIRST and above count. Level 2 phrases have about nine characters.
FIRST, LEVELS = 2, 5
#: Rows of a range, at most on average, and sampled keys for each range.
RANGE_ROWS, SAMPLED = 100_000, 64
#: Characters that are parsed at a time.
CHUNK = 1 << 17
_A, _B, _C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def _toss(row: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Coins of the names: twice the lowest bit that differs from the left neighbour's, plus the own bit there.

    A head, which has no left neighbour, tosses its lowest bit; so does, after a collision, a name equal to its left
    one. Of names without equal neighbours no coin equals its neighbour's.
    """
    one = row.dtype.type(1)
    differ = np.empty_like(row)
    differ[:1] = 1
    np.bitwise_xor(row[1:], row[:-1], out=differ[1:])
    differ[heads] = 1
    differ |= (differ == 0).astype(row.dtype)
    at = np.bitwise_count((differ & (~differ + one)) - one)
    own = ((row >> at.astype(row.dtype)) & one).astype(np.uint8)
    return at * np.uint8(2) + own


def next_level(row: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of several rows of names, one behind the other, and where each row begins.

    heads: where each row begins in row; no row is empty.
    """
    n = len(row)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(row[1:], row[:-1], out=first[1:])
    first[heads] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, n))
    names = row[starts]
    runs = np.flatnonzero(lengths > 1)
    names[runs] = _mix(names[runs] + _A * lengths[runs].astype(np.uint64))
    heads = np.searchsorted(starts, heads)
    coins = _toss(_toss(names, heads), heads)
    cut = np.zeros(len(names), bool)
    cut[1:-1] = (coins[1:-1] < coins[:-2]) & (coins[1:-1] <= coins[2:])
    cut[np.minimum(heads + 1, len(names) - 1)] = False
    cut[np.append(heads[1:], len(names)) - 1] = False
    cut[heads] = True
    cuts = np.flatnonzero(cut)
    inside = np.arange(len(names)) - np.repeat(cuts, np.diff(np.append(cuts, len(names))))
    mixed = _mix(names + _A * (inside + 1).astype(np.uint64))
    return _mix(np.add.reduceat(mixed, cuts)), np.searchsorted(cuts, heads)


def _sketches(texts: list[str]) -> list[np.ndarray]:
    """Ascending hashes of the telling names of each text, which must not be empty."""
    row = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = _mix(row + _A)
    sizes = np.array([len(t) for t in texts])
    owner, found = np.arange(len(texts)), []
    for level in range(LEVELS + 1):
        # a row of one name goes no further, so it counts whatever its level
        counts = np.full(len(owner), level >= FIRST) | (sizes == 1)
        if counts.any():
            value, held = (row, np.repeat(owner, sizes)) if counts.all() else (row[np.repeat(counts, sizes)], np.repeat(owner[counts], sizes[counts]))
            found.append(held.astype(np.uint64) << np.uint64(32) | _mix(value ^ _C) >> np.uint64(32))
        more = sizes > 1
        if level == LEVELS or not more.any():
            break
        if not more.all():
            row = row[np.repeat(more, sizes)]
            owner, sizes = owner[more], sizes[more]
        row, heads = next_level(row, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        sizes = np.diff(np.append(heads, len(row)))
    marks = np.sort(np.concatenate(found))
    # the second, third ... time that a text has a name counts as another name
    repeat = np.flatnonzero(marks[1:] == marks[:-1]) + 1
    if len(repeat):
        fresh = np.concatenate([[True], marks[1:] != marks[:-1]])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(marks)), 0))
        again = marks[repeat]
        marks[repeat] = again >> np.uint64(32) << np.uint64(32) | _mix((again & np.uint64(0xFFFFFFFF)) + _A * (repeat - at[repeat]).astype(np.uint64)) >> np.uint64(32)
        marks = np.unique(marks)
    begins = np.searchsorted(marks, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = marks.astype(np.uint32)
    return [low[a : min(b, a + SKETCH)] for a, b in zip(begins[:-1], begins[1:])]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The sketch of each text, that of an empty one empty; worked through in runs of about CHUNK characters."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    run, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if run and size + len(t) > CHUNK:
            for k, found in zip(run, _sketches([texts[k] for k in run])):
                out[k] = found
            run, size = [], 0
        run.append(i)
        size += len(t)
    if run:
        for k, found in zip(run, _sketches([texts[k] for k in run])):
            out[k] = found
    return out


def hexed(sketch: np.ndarray) -> str:
    """The sketch as a string: eight hex digits for each hash, ascending."""
    return sketch.astype(">u4").tobytes().hex()


def alike(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity that two sketches estimate, 0 to 1; two empty ones are alike."""
    both = np.sort(np.concatenate([x, y]))
    same = np.flatnonzero(both[1:] == both[:-1])
    union = len(both) - len(same)
    if not union:
        return 1.0
    if (len(x) >= SKETCH or len(y) >= SKETCH) and union > SKETCH:
        # of the SKETCH smallest of the union: the i-th value in common is at place same[i] - i of it
        return int(np.count_nonzero(same - np.arange(len(same)) < SKETCH)) / SKETCH
    return len(same) / union


def likeness(a: str, b: str) -> float:
    """alike for two fingerprints in hex."""
    return alike(*(np.frombuffer(bytes.fromhex(v), dtype=">u4") for v in (a, b)))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text; null counts as empty and has none (an empty string).

    Equal texts have equal fingerprints. A task holds about 60 bytes a character of the longest text.
    """
    return df.withColumn(out, F.arrow_udf(lambda texts: pa.array([hexed(s) for s in sketches([t or "" for t in texts.to_pylist()])], pa.string()), "string")(F.col(text)))


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as much of the beginning of following."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third] if third else text


COMPARED = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def _compare(batches):
    """Rows of one range after another, in descending order; each meets the row after it in its range."""
    held: list = []
    for batch in batches:
        buckets, keys, texts, guests = (batch.column(i).to_pylist() for i in range(4))
        own = sketches(texts)
        if held:
            buckets, keys, texts, guests, own = ([h, *rest] for h, rest in zip(held, (buckets, keys, texts, guests, own)))
        held = [column[-1] for column in (buckets, keys, texts, guests, own)]
        at = [i for i in range(len(keys) - 1) if not guests[i] and buckets[i] == buckets[i + 1]]
        new = [edited(texts[i], texts[i + 1]) for i in at]
        other = sketches(new)
        if at:
            columns = [
                pa.array([keys[i] for i in at], pa.int64()),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
                pa.array([hexed(own[i]) for i in at]),
                pa.array([hexed(o) for o in other]),
                pa.array([alike(own[i], o) for i, o in zip(at, other)], pa.float64()),
                pa.array([alike(own[i], own[i + 1]) for i in at], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=COMPARED.names)


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row for each row of df: key, n_chars, and how its fingerprint likens to its edited text's and the next's.

    The next document is that of descending key (after the last the first; a lone document is its own next). Null
    texts count as empty, null keys come last; rows of one key follow one another in the order of their texts' hashes.
    Keys are cast to long; one that is no number fails or counts as null by the session. An empty table gives no rows.
    near_edited, near_next: likeness, 0 to 1.

    A sample of (key, hash of the text), SAMPLED for each range, cuts the rows into ranges, so that rows of one key
    need not lie in one. A range's first row also goes, as a guest, to
    the end of the range before it, so that no task needs another's rows; the texts are shuffled once. The driver
    holds the sample, and of each range its bounds.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    # ascending in these three is descending in keys, null keys last
    order = [F.col("key").isNull().alias("unknown"), F.coalesce(F.bitwise_not("key"), F.lit(0)).alias("down"), "hash"]
    total = rows.count()
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_ROWS)
    sample = rows.where(F.pmod(F.xxhash64("key", "hash"), F.lit(max(1, total // (SAMPLED * ranges)))) == 0).select(*order).distinct()
    drawn = sorted(map(tuple, sample.collect()))
    edges = spark.sparkContext.broadcast(sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else [])

    def place(unknown: pa.Array, down: pa.Array, hashed: pa.Array) -> pa.Array:
        at = zip(unknown.to_pylist(), down.to_pylist(), hashed.to_pylist())
        return pa.array([bisect_right(edges.value, t) for t in at], pa.int32())

    placed = rows.withColumn("bucket", F.arrow_udf(place, "int")(*order))
    firsts = sorted((r["bucket"], *r["first"]) for r in placed.groupBy("bucket").agg(F.min(F.struct(*order)).alias("first")).collect())
    # a range's first row is the guest of the range before, that of the first one of the last
    leaders = spark.createDataFrame([(b, u, d, h, firsts[i - 1][0]) for i, (b, u, d, h) in enumerate(firsts)], "own int, unknown boolean, down long, first long, host int")
    first = (F.col("bucket") == F.col("own")) & (F.col("hash") == F.col("first")) & (F.col("key").isNull() == F.col("unknown")) & (F.coalesce(F.bitwise_not("key"), F.lit(0)) == F.col("down"))
    led = placed.join(F.broadcast(leaders), first, "left")
    stay = F.struct("bucket", F.lit(False).alias("guest"))
    go = F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    laid = led.select("key", "text", "hash", F.explode(F.when(F.col("host").isNull(), F.array(stay)).otherwise(F.array(stay, go))).alias("to"))
    laid = laid.select("to.bucket", "key", "text", "to.guest", "hash").repartitionById(len(edges.value) + 1, F.col("bucket"))
    laid = laid.sortWithinPartitions("guest", F.col("key").desc_nulls_last(), "hash", "text").drop("hash")
    return laid.mapInArrow(_compare, COMPARED).withColumnRenamed("key", key)
