"""LM scoring with an interpolated modified Kneser-Ney bigram model.

Counting is two Spark jobs over the whole training texts. Tokens are 64-bit hashes. Each map task counts a run of
texts at a time and sends one packed row of sorted arrays to each shard, so what is shuffled grows with the
distinct words and pairs, and the reducers merge arrays instead of rows. A pair goes to the shard of its first
word; a word so frequent that it would fill a shard by itself has its pairs dealt by both words.

The model is a folder of sorted hash arrays under spark.checkpoint.dir: of each word its count, the number of
distinct words before it, and of the words after it how many there are, once, twice and more often; of each pair
its count. Workers map the arrays into memory and look a batch's distinct words and pairs up in sorted order, so
that pages come in as they are needed and the operating system shares them between workers. Where the folder is
in a store without local files, a worker copies an array before it maps it.

Order two, not three: the packed trigrams of a corpus and their arrays need more disk than the text; see README.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import idle_memory, shared_dir, text_of, until_exit

#: Characters of text for each shard, on average.
SHARD_CHARS = 1 << 25
#: Tokens counted before a map task sends its counts on, and tokens scored at a time.
RUN_TOKENS, SCORE_TOKENS = 1 << 21, 1 << 19
#: Bytes of text that are hashed at a time.
WINDOW = 1 << 18
_A, _B, _C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_known: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
#: What stands before the first token, and the token after the last word.
BEGIN, END = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA24BAED4963EE407)
WORDS = np.dtype([("hash", "<u8"), ("count", "<i8"), ("before", "<i8"), ("total", "<i8"), ("once", "<i8"), ("twice", "<i8"), ("more", "<i8")])
PACKED = "kind string, shard int, data binary"


def _mix(h):
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_known[0]) < n:
        up, down = np.full(max(n, WINDOW), _STEP), np.full(max(n, WINDOW), _BACK)
        up[0] = down[0] = 1
        _known[:] = np.cumprod(up), np.cumprod(down)
    return _known[0][:n], _known[1][:n]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the token before each, where each text begins): hashes of the words, then END, text after text."""
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.flatnonzero(~space[1:] & space[:-1]) + 1
    last = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    words = np.empty(len(first), dtype=np.uint64)
    at = 0
    while at < len(first):  # words of about WINDOW bytes at a time, one at least
        to = max(at + 1, int(np.searchsorted(last, first[at] + WINDOW, "right")))
        a, b = first[at:to] - first[at], last[at:to] - first[at]
        up, down = _powers(int(b[-1]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data[first[at] : last[to - 1]].astype(np.uint64) + np.uint64(1)) * _A * up)])
        words[at:to] = _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    begins = np.cumsum([1] + [len(p) + 1 for p in parts])
    before = np.searchsorted(first, begins)  # words before each text, and all of them
    out = np.empty(len(words) + len(parts), dtype=np.uint64)
    ends = before[1:] + np.arange(len(parts))
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, words
    starts = np.concatenate([[0], ends[:-1] + 1])
    previous = np.concatenate([[BEGIN], out[:-1]])
    previous[starts] = BEGIN
    return out, previous, starts


def _runs(batches, column: int, limit: int):
    """Lists of texts of about limit tokens (five bytes each); a longer text is a list by itself."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(column).to_pylist():
            text = text or ""
            if held and size + len(text) > 5 * limit:
                yield held
                held, size = [], 0
            held.append(text)
            size += len(text)
    if held:
        yield held


def _summed(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], order[heads], *(np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values)


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return ((_mix(words ^ _A) >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def _pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(before * _A + word)


def _pair_shard(before: np.ndarray, keys: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    own = _word_shard(before, shards)
    if not len(hot):
        return own
    at = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
    return np.where(hot[at] == before, ((keys >> np.uint64(33)) % np.uint64(shards)).astype(np.int32), own)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], dtype="<u8")
    return b"".join([head.tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<u8", len(kinds) + 1)[1:], 8 * (len(kinds) + 1), []
    for kind, n in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _rows(kind: str, shards: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """Arrays sorted by shard as one packed row for each shard."""
    at = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(shards))
    data = [_pack(*(a[i:j] for a in arrays)) for i, j in zip(at, ends)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(shards[at] if len(at) else [], pa.int32()), pa.array(data, pa.binary())], names=["kind", "shard", "data"])


def _count_words(shards: int):
    def run(batches):
        for texts in _runs(batches, 0, RUN_TOKENS):
            found, _, _ = tokens(texts)
            words, n = np.unique(found, return_counts=True)
            at = _word_shard(words, shards)
            order = np.argsort(at, kind="stable")
            yield _rows("words", at[order], [words[order], n[order].astype("<i8")])
            del found, words, n, at, order
            idle_memory()

    return run


def _merge_words(batches):
    """Of each shard: its words with their counts, how many there are, and the 64 most frequent."""
    held = [_unpack(d, "<u8", "<i8") for batch in batches for d in batch.column("data").to_pylist()]
    if not held:
        return
    words, _, n = _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
    top = np.argsort(-n, kind="stable")[:64]
    yield pa.RecordBatch.from_arrays(
        [pa.array([_pack(words, n)], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([words[top].view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([n[top].tolist()], pa.list_(pa.int64()))],
        names=["data", "distinct", "total", "top", "times"],
    )


def _count_pairs(shards: int, hot: np.ndarray):
    def run(batches):
        for texts in _runs(batches, 0, RUN_TOKENS):
            word, before, _ = tokens(texts)
            keys, at, n = _summed(_pair_key(before, word), np.ones(len(word), np.int64))
            before, word = before[at], word[at]
            shard = _pair_shard(before, keys, hot, shards)
            # by shard and first word, so that each first word is written once
            order = np.lexsort((before, shard))
            before, word, n, shard = before[order], word[order], n[order], shard[order]
            for s in np.unique(shard).tolist():
                i, j = np.searchsorted(shard, [s, s + 1])
                heads = np.flatnonzero(np.concatenate([[True], before[i + 1 : j] != before[i : j - 1]]))
                sizes = np.diff(np.append(heads, j - i))
                data = _pack(before[i:j][heads], sizes.astype("<u4"), word[i:j], n[i:j].astype("<u4"))
                yield pa.RecordBatch.from_arrays([pa.array(["pairs"]), pa.array([s], pa.int32()), pa.array([data], pa.binary())], names=["kind", "shard", "data"])
            del word, before, keys, n, shard, order, data
            idle_memory()

    return run


def _store(at: str, name: str, *arrays: np.ndarray) -> None:
    """Writes arrays as one file. A repeated attempt writes the same bytes and replaces the file."""
    store, path = fs.FileSystem.from_uri(at)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for a in arrays:
            out.write(a.tobytes())
    try:
        store.move(part, f"{path}/{name}")
    except OSError:
        store.delete_file(part)  # another attempt was first


def _merge_pairs(at: str, shards: int):
    def run(batches):
        held, shard = [], None
        for batch in batches:
            for s, d in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist()):
                shard = s
                before, sizes, word, n = _unpack(d, "<u8", "<u4", "<u8", "<u4")
                held.append((np.repeat(before, sizes), word, n.astype(np.int64)))
        if not held:
            return
        before, word, n = (np.concatenate(c) for c in zip(*held))
        held = None
        keys, first, n = _summed(_pair_key(before, word), n)
        before, word = before[first], word[first]
        _store(at, f"pairs-{shard}", keys, n.astype("<u8"))
        words, _, after = _summed(word, np.ones(len(word), np.int64))
        where = _word_shard(words, shards)
        order = np.argsort(where, kind="stable")
        yield _rows("before", where[order], [words[order], after[order]])
        firsts, _, total, once, twice, more = _summed(before, n, *(m.astype(np.int64) for m in (n == 1, n == 2, n > 2)))
        where = _word_shard(firsts, shards)
        order = np.argsort(where, kind="stable")
        yield _rows("after", where[order], [a[order] for a in (firsts, total, once, twice, more)])
        tally = np.array([(n == k).sum() for k in (1, 2, 3, 4)], dtype="<i8")
        del before, word, n, keys, first, firsts
        idle_memory()
        yield pa.RecordBatch.from_arrays([pa.array(["tally"]), pa.array([0], pa.int32()), pa.array([tally.tobytes()], pa.binary())], names=["kind", "shard", "data"])

    return run


def _join_words(at: str, shards: int):
    def run(batches):
        parts: dict[str, list] = {"words": [], "before": [], "after": []}
        for batch in batches:
            for kind, d in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist()):
                parts[kind].append(_unpack(d, "<u8", *["<i8"] * (4 if kind == "after" else 1)))
        every = [a[0] for p in parts.values() for a in p]
        if not every:
            return
        hashes = np.unique(np.concatenate(every))
        out = np.zeros(len(hashes), WORDS)
        out["hash"] = hashes
        for kind, names in (("words", ["count"]), ("before", ["before"]), ("after", ["total", "once", "twice", "more"])):
            for keys, *values in parts[kind]:
                where = np.searchsorted(hashes, keys)
                for name, v in zip(names, values):
                    np.add.at(out[name], where, v.astype(out[name].dtype))
        shard = int(_word_shard(hashes[:1], shards)[0])
        _store(at, f"words-{shard}", out)
        before = out["before"]
        tally = [int((before == k).sum()) for k in (1, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*tally, int((before > 2).sum()), int(before.sum()))], names=["n1", "n2", "n3", "n4", "more", "pairs"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What counts of one, two, and three or more are lowered by. Where a tally is zero: a half of 1, 2, 3."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))


@dataclass
class Model:
    """at: the folder of arrays. The rest are a few numbers."""

    at: str
    shards: int
    hot: np.ndarray
    train_tokens: int
    distinct: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    rest: float

    def __post_init__(self):
        self._open: dict = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"} | {"_open": {}}

    def _bytes(self, name: str) -> np.ndarray:
        if name not in self._open:
            store, path = fs.FileSystem.from_uri(f"{self.at}/{name}")
            info = store.get_file_info(path)
            if info.type == fs.FileType.NotFound or not info.size:
                self._open[name] = np.zeros(0, np.uint8)
            elif isinstance(store, fs.LocalFileSystem):
                self._open[name] = np.memmap(path, dtype=np.uint8, mode="r")
            else:
                # in the folder that Spark gives the worker and clears
                with tempfile.NamedTemporaryFile(dir=SparkFiles.getRootDirectory(), delete=False) as copy, store.open_input_stream(path) as source:
                    while block := source.read(1 << 24):
                        copy.write(block)
                self._open[name] = np.memmap(copy.name, dtype=np.uint8, mode="r")
                os.unlink(copy.name)
        return self._open[name]

    def _by_shard(self, shard: np.ndarray):
        order = np.argsort(shard, kind="stable")
        ids, at = np.unique(shard[order], return_index=True)
        yield from zip(ids.tolist(), np.split(order, at[1:]))

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """What is known of each word; hashes are distinct and ascending."""
        out = np.zeros(len(hashes), WORDS)
        for shard, at in self._by_shard(_word_shard(hashes, self.shards)):
            table = self._bytes(f"words-{shard}").view(WORDS)
            if len(table):
                keys = table["hash"]
                where = np.minimum(np.searchsorted(keys, hashes[at]), len(table) - 1)
                hit = keys[where] == hashes[at]
                out[at[hit]] = table[where[hit]]
        return out

    def pair_counts(self, before: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for shard, at in self._by_shard(_pair_shard(before, keys, self.hot, self.shards)):
            data = self._bytes(f"pairs-{shard}")
            n = len(data) // 16
            if n:
                table, counts = data[: 8 * n].view("<u8"), data[8 * n :].view("<u8")
                where = np.minimum(np.searchsorted(table, keys[at]), n - 1)
                out[at] = np.where(table[where] == keys[at], counts[where], 0)
        return out

    def score(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text: tokens, known tokens, base score, score."""
        columns: list[list] = [[], [], [], []]
        for run in _texts_in_runs(texts):
            word, before, starts = tokens(run)
            every, index = np.unique(np.concatenate([word, before]), return_inverse=True)
            table = self.words(every)
            own, past = index[: len(word)], index[len(word) :]
            count = table["count"][own]
            base = np.log10((count + 0.5) / (self.train_tokens + 0.5 * (self.distinct + 1)))
            low = self._low(table["before"])[own]
            d = np.array([0.0, *self.pair_discounts])
            total = table["total"]
            left = (d[1] * table["once"] + d[2] * table["twice"] + d[3] * table["more"]) / np.maximum(total, 1)
            keys, at, which = np.unique(_pair_key(before, word), return_index=True, return_inverse=True)
            seen = self.pair_counts(before[at], keys)[which]
            high = (seen - d[np.minimum(seen, 3)]) / np.maximum(total[past], 1)
            p = np.where(total[past] > 0, high + left[past] * low, low)
            sizes = np.diff(np.append(starts, len(word)))
            for c, v in zip(columns, (sizes, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts))):
                c.append(v)
        return [np.concatenate(c) if c else np.zeros(0) for c in columns]

    def _low(self, before: np.ndarray) -> np.ndarray:
        """The lower order: how many distinct words a word follows, discounted, over a uniform floor."""
        d = np.array([0.0, *self.word_discounts])
        return (before - d[np.minimum(before, 3)]) / max(self.pairs, 1) + self.rest / (self.distinct + 1)


def _texts_in_runs(texts: list[str]):
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > 5 * SCORE_TOKENS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def fit(train: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """Counts all whole texts of train; null counts as an empty text, which has the token END alone.

    An empty table gives a model in which every word is unknown.
    """
    spark = train.sparkSession
    texts = train.select(text_of(text).alias("text"))
    if shards is None:
        chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // SHARD_CHARS)
    at = shared_dir(spark)
    counted = texts.mapInArrow(_count_words(shards), PACKED).repartitionById(shards, F.col("shard"))
    counted.mapInArrow(_merge_words, "data binary, distinct long, total long, top array<long>, times array<long>").write.parquet(f"{at}/counted")
    until_exit(spark, at)
    words = spark.read.parquet(f"{at}/counted")
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    # a word of a tenth of a shard or more: at most 10 times as many as there are shards
    frequent = words.select(F.explode(F.arrays_zip("top", "times")).alias("w")).where(F.col("w.times") >= max(2.0, total / (10 * shards))).select("w.top").collect()
    hot = np.sort(np.array([BEGIN.view(np.int64), *(r[0] for r in frequent)], dtype=np.int64).view(np.uint64))

    pairs = texts.mapInArrow(_count_pairs(shards, hot), PACKED).repartitionById(shards, F.col("shard"))
    pairs.mapInArrow(_merge_pairs(at, shards), PACKED).write.parquet(f"{at}/merged")
    merged = spark.read.parquet(f"{at}/merged")
    tally = sum((np.frombuffer(r[0], "<i8") for r in merged.where("kind = 'tally'").select("data").collect()), np.zeros(4, np.int64))
    first = words.select(F.lit("words").alias("kind"), "data").withColumn("shard", F.arrow_udf(_shard_of(shards), "int")("data"))
    parts = first.select("kind", "shard", "data").unionByName(merged.where("kind != 'tally'"))
    joined = parts.repartitionById(shards, F.col("shard")).mapInArrow(_join_words(at, shards), "n1 long, n2 long, n3 long, n4 long, more long, pairs long")
    n1, n2, n3, n4, more, all_pairs = (int(v or 0) for v in joined.agg(*(F.sum(c) for c in joined.columns)).first())
    low = discounts(n1, n2, n3, n4)
    rest = (low[0] * n1 + low[1] * n2 + low[2] * more) / all_pairs if all_pairs else 1.0
    return Model(at, shards, hot, int(total), int(distinct), all_pairs, discounts(*tally.tolist()), low, rest)


def _shard_of(shards: int):
    return lambda column: pa.array([int(_word_shard(_unpack(d, "<u8", "<i8")[0][:1], shards)[0]) for d in column.to_pylist()], pa.int32())


SCORES = "struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>"


def score(df: DataFrame, model: Model, text: str = "text", out: str = "lm") -> DataFrame:
    """Adds a struct for each whole text: n_tokens (words and END), n_known, base_score and score, log10.

    A map over rows without a shuffle. Null counts as empty. Equal texts score alike; empty tables stay empty.
    Perplexity is 10 ** (-score / n_tokens).
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        n, known, base, full = shared.value.score([t or "" for t in texts.to_pylist()])
        idle_memory()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())], names=["n_tokens", "n_known", "base_score", "score"])

    return df.withColumn(out, F.arrow_udf(run, SCORES)(F.col(text)))
