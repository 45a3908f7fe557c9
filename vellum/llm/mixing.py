"""Mixing sources to target weights.

The words of a source, in a pseudorandom order of its documents, are packed end to end into blocks of BLOCK words.
An output shard has SLOTS slots and draws how many come from each source: multinomial draws, given that over all
shards every source ends at its target. A run of shards holds what its sources are due, and its first half draws its
slots from that, down to the single shard. Slots of a source are numbered
over all shards; slot i takes block permutation(i mod blocks), with another permutation for each round through the
blocks. Slots and documents meet by block number.

No task sees a whole source: its documents are dealt to chunks, a running sum over the chunks' totals (a row for
each chunk) gives a chunk's first word, and a window inside the chunk gives each document's. What reaches the
driver is one row for each source (MAX_SOURCES at most). It halves the shards into runs (MAX_DRAWS numbers at most);
tasks draw on from there.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.pieces import streamed
from vellum.llm.common import WORD, free_name, idle_memory, text_of, written

BLOCK = 128
SLOTS = 256
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
MAX_SOURCES = 100_000
MAX_DRAWS = 200_000
#: The driver stops at runs of so many shards.
RUN = 16
CHUNK_ROWS = 1000
SEED = 20


@dataclass
class Source:
    name: str | None
    words: int
    rows: int
    target: float
    blocks: int
    slots: float


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Divides share of all sizes by weight. No target passes most times its size; the excess is shared again."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while free:
        each = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * each > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * each
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def plan(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK) -> list[Source]:
    """The sources by code point, null last, with targets and slots. slim: (source, size)."""
    found = slim.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"there are more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goals = targets([r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share)
    out = []
    for r, goal in zip(found, goals):
        blocks = math.ceil(r["words"] / block)
        out.append(Source(r["source"], r["words"], r["rows"], goal, blocks, goal * blocks / r["words"] if r["words"] else 0.0))
    return out


#: numpy draws hypergeometric numbers from fewer than so many.
MANY = 1_000_000_000
#: Constants of the ratio-of-uniforms method: 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e).
_WIDE, _MORE = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, many: int = MANY) -> int:
    """How many of n that are drawn without putting back, from good and bad ones, are good; for any numbers.

    From MANY on by ratio of uniforms (Stadlober 1990): a point under the curve of the frequencies, relative to the
    most likely number, is accepted. Logarithms of factorials make it right to about 1e-3 of a frequency at 1e12.
    """
    whole = good + bad
    if whole < many:
        return int(rng.hypergeometric(good, bad, n))
    least, drawn_ones = min(good, bad), min(n, whole - n)
    if drawn_ones == 0 or least == 0:
        hits = 0
    elif drawn_ones <= 16:
        hits = 0
        for k in range(drawn_ones):
            hits += int(rng.integers(whole - k)) < least - hits
    else:
        rare = least / whole
        middle = drawn_ones * rare + 0.5
        spread = math.sqrt((whole - drawn_ones) / (whole - 1) * drawn_ones * rare * (1 - rare) + 0.5)
        top = (drawn_ones + 1) * (least + 1) // (whole + 2)
        log_of = lambda k: -(math.lgamma(k + 1) + math.lgamma(least - k + 1) + math.lgamma(drawn_ones - k + 1) + math.lgamma(whole - least - drawn_ones + k + 1))
        highest, limit = log_of(top), min(drawn_ones, least) + 1
        while True:
            u, v = 1.0 - rng.random(), rng.random()
            x = middle + (_WIDE * spread + _MORE) * (v - 0.5) / u
            if 0 <= x < limit and 2 * math.log(u) <= log_of(int(x)) - highest:
                hits = int(x)
                break
    # back from the rarer kind, and from what is left over, to what was asked
    hits = hits if good <= bad else drawn_ones - hits
    return hits if drawn_ones == n else good - hits


def drawn(rng: np.random.Generator, n: int, due: np.ndarray, many: int = MANY) -> np.ndarray:
    """How many of n slots come from each source, of which there are due: multinomial draws that end at their totals.

    Such draws, given their totals, are hypergeometric at every size: by numpy below a billion, else source by source.
    """
    if due.sum() < many:
        return rng.multivariate_hypergeometric(due, n, method="marginals")
    out, rest = np.zeros_like(due), int(due.sum())
    for i, own in enumerate(due.tolist()):
        rest -= own
        out[i] = hypergeometric(rng, own, rest, n, many) if own and n else 0
        n -= int(out[i])
    return out


@dataclass
class Run:
    """Shards in a row: the first one, how many, what each source is due there, and its slots in the shards before."""

    first: int
    shards: int
    due: np.ndarray
    before: np.ndarray

    def halves(self, seed: int) -> tuple[Run, Run]:
        n = self.shards // 2
        left = drawn(np.random.default_rng([seed, self.first, self.shards]), n * SLOTS, self.due)
        return Run(self.first, n, left, self.before), Run(self.first + n, self.shards - n, self.due - left, self.before + left)

    def single(self, seed: int):
        """Its shards, one by one, in order."""
        todo = [self]
        while todo:
            run = todo.pop()
            if run.shards > 1:
                todo += reversed(run.halves(seed))
            elif run.shards:
                yield run


def runs(sources: list[Source], seed: int = SEED) -> list[Run]:
    """All shards as runs of RUN at most, or fewer and longer runs beyond MAX_DRAWS numbers."""
    due = np.array([min(MOST * s.blocks, round(s.slots)) for s in sources], dtype=np.int64)
    out = [Run(0, math.ceil(due.sum() / SLOTS), due, np.zeros_like(due))]
    while any(r.shards > RUN for r in out) and 2 * len(out) * len(sources) <= MAX_DRAWS:
        out = [half for r in out for half in (r.halves(seed) if r.shards > 1 else (r,))]
    return out


def permuted(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Where pseudorandom permutations of 0..n-1 take the indexes: Feistel rounds, walked until inside."""
    index, n, seed = (np.asarray(a).astype(np.uint64) for a in (index, n, seed))
    half = np.array([(max(2, int(v - 1).bit_length()) + 1) // 2 for v in n.tolist()], dtype=np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, m, s = half[todo], mask[todo], seed[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(4):
            v = (right + s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((v >> np.uint64(31)) & m)
        x[todo] = left << h | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def slots(spark, sources: list[Source], seed: int = SEED) -> DataFrame:
    """The mix as (shard, src, slot, round, block), a row for each block that a shard takes."""
    parts = [(r.first, r.shards, r.due.tolist(), r.before.tolist()) for r in runs(sources, seed)]
    tasks = max(1, len(parts) // 4)
    spread = spark.createDataFrame(parts, "first long, shards long, due array<long>, before array<long>").repartition(tasks)

    def draw(batches):
        for batch in batches:
            for row in batch.to_pylist():
                run = Run(row["first"], row["shards"], *(np.array(row[c], dtype=np.int64) for c in ("due", "before")))
                for shard in run.single(seed):
                    src = np.flatnonzero(shard.due)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(src), shard.first)), pa.array(src.astype(np.int32)), pa.array(shard.before[src]), pa.array(shard.due[src])], names=["shard", "src", "first", "n"]
                    )

    rows = spread.mapInArrow(draw, "shard long, src int, first long, n long")
    # at most MAX_SOURCES rows of two numbers
    blocks = spark.createDataFrame([(i, s.blocks) for i, s in enumerate(sources)], "src int, blocks long")
    rows = rows.join(F.broadcast(blocks), "src").select("shard", "src", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    rows = rows.withColumn("round", F.floor(F.col("slot") / F.col("blocks")).cast("long"))

    def block_of(src: pa.Array, slot: pa.Array, n: pa.Array, turn: pa.Array) -> pa.Array:
        a, b, c, d = (x.to_numpy(zero_copy_only=False) for x in (slot, n, turn, src))
        return pa.array(permuted(a % b, b, (d.astype(np.int64) << 8) + c + seed))

    return rows.select("shard", "src", "slot", "round", F.arrow_udf(block_of, "long")("src", "slot", "blocks", "round").alias("block"))


def placed(slim: DataFrame, sources: list[Source], order: list[str]) -> DataFrame:
    """slim with src, the number of its source, and start, the number of its first word in the source.

    order: the columns that order documents of one hash; rows that agree in them are interchangeable.
    """
    spark = slim.sparkSession
    rows = max(CHUNK_ROWS, math.isqrt(sum(s.rows for s in sources)))
    names = spark.createDataFrame([(i, s.name, math.ceil(s.rows / rows)) for i, s in enumerate(sources)], "src int, name string, chunks int")
    dealt = slim.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    dealt = dealt.withColumn("hash", F.xxhash64(*order)).withColumn("chunk", F.pmod("hash", "chunks")).drop("chunks")
    sums = dealt.groupBy("src", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = written(sums.select("src", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("src", "chunk").orderBy("hash", *order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(base, ["src", "chunk"]).withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside", "hash", "chunk")


def pieces(rows: DataFrame, sources: list[Source], seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The blocks of each document that the mix takes: rows with word (its first in the document), n, times."""
    counts = slots(rows.sparkSession, sources, seed).groupBy("src", "block").agg(F.count("*").alias("times"))
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cut.withColumn("word", begin - F.col("start")).withColumn("n", end - begin).join(counts, ["src", "block"])


def measured(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(doc, source, size, version) of each row."""
    whole = text_of(text)
    return df.select(F.col(key).alias("doc"), F.col(source).cast("string").alias("source"), F.regexp_count(whole, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(whole).alias("version"))


def taken(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """One row for each row of df: key, size, source_size, target (its source's) and taken.

    size: words of the text (null: none). taken: the words that the mix takes of the document, repeats counted; at
    most twice its size. A null source is a source. Repeated rows are documents of their own. The same rows give
    the same mix, however they are partitioned. An empty table gives no rows.
    """
    spark = df.sparkSession
    slim = written(measured(df, key, text, source))
    sources = plan(slim)
    rows = written(placed(slim, sources, ["doc", "version", "size"]))
    got = pieces(rows, sources, seed).groupBy("src", "start", "doc", "size").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    same = ["src", "start", "size"]
    whole = rows.where("size > 0").select("src", "start", "size", "doc").join(got.drop("doc"), same, "left")
    whole = whole.unionByName(rows.where("size = 0").select("src", "start", "size", "doc", F.lit(0).cast("long").alias("taken")))
    goals = spark.createDataFrame([(i, s.words, s.target) for i, s in enumerate(sources)], "src int, source_size long, target double")
    return whole.join(F.broadcast(goals), "src").select(F.col("doc").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The documents of the mix, with the columns of df: what is taken of each, as its new text.

    The words stay in their order with the white space after them; what is taken twice follows a line end. A
    document of which nothing is taken goes. Rows that agree in key, text and source are told apart by nothing
    else, so all of them have the other columns of one. Cases as in taken.
    """
    slim = written(measured(df, key, text, source))
    sources = plan(slim)
    got = pieces(placed(slim, sources, ["doc", "version", "size"]), sources, seed).groupBy("src", "start", "doc", "version", F.col("source").alias("origin"))
    got = got.agg(F.sort_array(F.collect_list(F.struct("word", "n", "times"))).alias("taken"))
    names = {c: free_name(df, f"_{c}") for c in ("doc", "version", "origin", "taken")}
    got = got.select(*[F.col(c).alias(n) for c, n in names.items()])
    docs = df
    if not slim.where("size > 0").groupBy("doc", "version", "source").count().where("count > 1").isEmpty():
        docs = df.dropDuplicates([key, text, source])
    # one plan at every size: texts and what is taken of them meet by a sort-merge join
    met = docs.join(
        got.hint("merge"),
        F.col(key).eqNullSafe(F.col(names["doc"])) & (F.xxhash64(text_of(text)) == F.col(names["version"])) & F.col(source).cast("string").eqNullSafe(F.col(names["origin"])),
    )

    def cut(texts: pa.Array, taken: pa.Array) -> pa.Array:
        return pa.array([_cut(t, p) for t, p in zip(texts.to_pylist(), taken.to_pylist())], pa.string())

    new = F.arrow_udf(streamed(cut, idle_memory), "string")(F.col(text), F.col(names["taken"]))
    return met.withColumn(text, new).select(*df.columns)


_WORDS = re.compile(f"{WORD}[\\x20\\x09-\\x0D]*")


def _cut(text: str, taken: list[dict]) -> str:
    words = _WORDS.findall(text)
    turns = ("".join("".join(words[p["word"] : p["word"] + p["n"]]) for p in taken if p["times"] > k) for k in range(MOST))
    return "\n".join(t for t in turns if t)
