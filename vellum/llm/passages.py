"""Substring dedup: words go that stand in a passage which occurs elsewhere, found by compressed full-text indexes.

A window is a passage of a fixed number of words. Equal windows hold the same least digest of short word runs, so
text is cut into segments, maximal runs of windows with one such digest, the segment's key; every window is whole in
just one segment, and equal windows meet under one key. A key that occurs once has nothing that recurs, and equal
segments are one content with its number. Of a content that stands more than once, all windows recur; only keys that
also have other contents go further, dealt by key to shards of about SHARD_WORDS words. A shard's FM-index
(fmindex.py) is built over its contents, and those that stand once are streamed against it: backward search finds how
far matches reach, and gives the intervals where windows recur. These are joined back to every occurrence.

What is dealt grows with the text. A key of more than CROWD contents (one passage between very many different
neighbours) is dealt again by whole windows: those whose digest recurs go through an index of their own, so no shard
outgrows its task; their words come with the contents, so texts are read once for both. Words are compared by 64-bit
digests.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import free_name, idle_memory, text_of, written
from vellum.llm.fmindex import Index

LEAST = 35
#: Words of the runs whose least digest is a key.
GRAM = 5
#: Windows of a segment, at most.
SEGMENT = 64
#: Words of which an index is built.
SHARD_WORDS = 500_000
#: Different contents of a key that one index takes, at most.
CROWD = 1024
#: Words that are cut into segments at once, and words of a text that are split at once (in bytes).
CHUNK, PIECE = 1 << 19, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = digest = xxhash.xxh64_intdigest(word)
        return digest


_digests = _Digests()


def words_of(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of a bounded number."""
    start = 0
    while len(text) - start > size:
        found = _SPACE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()].split()
        start = found.start()
    yield text[start:].split()


def digests(text: bytes | None) -> np.ndarray:
    """64-bit digest of each word."""
    found = [np.fromiter(map(_digests.__getitem__, words), np.uint64, len(words)) for words in words_of(text or b"")]
    return found[0] if len(found) == 1 else np.concatenate(found)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width numbers."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def run_digests(words: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A digest of each run words[first : first + length]."""
    n = len(words)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, n), dtype=np.uint64)])
    return _mixed((sums[first + lengths] - sums[first]) * _powers(_INVERSE, n)[first] + lengths.astype(np.uint64))


def segments(pieces: list[np.ndarray], least: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of all pieces: piece, first word, number of windows, key, digest of the content, whether the key
    occurs in it again."""
    words = np.concatenate([*pieces, np.zeros(0, np.uint64)])
    lengths = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(lengths)
    width = least - gram + 1
    if len(words) < least:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    rolled = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        rolled = rolled * np.uint64(_BASE) + words[k : len(words) - gram + 1 + k]
    rolled = _mixed(rolled)
    key = sliding_min(rolled, width)
    piece = np.repeat(np.arange(len(pieces)), lengths)
    place = np.flatnonzero(np.arange(len(key)) + least <= ends[piece[: len(key)]])
    if not len(place):
        return segments([], least, gram)
    fresh = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (key[place[1:]] != key[place[:-1]])])
    since = np.arange(len(place)) - np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
    heads = np.flatnonzero(since % SEGMENT == 0)
    first = place[heads]
    n = np.diff(np.append(heads, len(place)))
    # does the key's run of words stand in the segment more than once?
    spans = n + width - 1
    at = np.repeat(first - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
    same = rolled[at] == np.repeat(key[first], spans)
    twice = np.add.reduceat(same.astype(np.int32), np.cumsum(spans) - spans) > 1
    own = piece[first]
    return own, first - (ends - lengths)[own], n, _mixed(key[first]), run_digests(words, first, n + least - 1), twice


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _cut(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, marks, texts = batch.column("doc"), batch.column("mark"), batch.column("text").cast(pa.binary())
            held: list[tuple[int, int, np.ndarray]] = []
            size = 0
            for i in range(len(texts)):
                words = digests(texts[i].as_py())
                # a long text comes in pieces that share least - 1 words
                for start in range(0, max(1, len(words) - least + 1), CHUNK):
                    held.append((i, start, words[start : start + CHUNK + least - 1]))
                    size += len(held[-1][2])
                    if size >= CHUNK or i == len(texts) - 1 and start + CHUNK >= len(words) - least + 1:
                        own, first, n, key, content, twice = segments([w for _, _, w in held], least)
                        rows = pa.array(np.array([h[0] for h in held], np.int64)[own])
                        start_at = first + np.array([h[1] for h in held], np.int64)[own]
                        yield pa.RecordBatch.from_arrays(
                            [docs.take(rows), marks.take(rows), pa.array(start_at), pa.array(n.astype(np.int32)), _signed(key), _signed(content), pa.array(twice)],
                            names=["doc", "mark", "start", "n", "key", "content", "twice"],
                        )
                        held, size = [], 0
        idle_memory()

    return run


def _fetch(least: int):
    """Words of the wanted contents; of crowded ones the digest of each window as well."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        names = ["key", "content", "heavy", "crowded", "at", "window", "words"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            docs, marks, texts, wanted = (batch.column(c) for c in ("doc", "mark", "text", "wanted"))
            texts = texts.cast(pa.binary())
            rows: list[tuple] = []
            size = 0
            for i in range(len(texts)):
                doc, mark = docs[i].as_py(), marks[i].as_py()
                last = i == len(texts) - 1
                if (doc, mark) not in seen:  # of repeated rows one is enough
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen.add((doc, mark))
                    words = digests(texts[i].as_py())
                    for w in wanted[i].as_py():
                        start, n, own = w["start"], w["n"], (w["key"], w["content"], w["heavy"], w["crowded"])
                        content = words[start : start + n + least - 1]
                        rows.append((*own, None, None, content.view(np.int64)))
                        size += len(content)
                        if w["crowded"]:
                            windows = run_digests(content, np.arange(n), np.full(n, least)).view(np.int64)
                            rows += [(*own, k, x, None) for k, x in enumerate(windows.tolist())]
                            size += n
                if rows and (size >= CHUNK or last):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
        idle_memory()

    return run


def _search(least: int):
    def run(shard: pa.Table) -> pa.Table:
        lists = shard.column("words").combine_chunks()
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        texts = [values[a:b] for a, b in zip(cuts, cuts[1:])]
        index = Index(texts, shard.column("heavy").to_numpy())
        # of the others it is known that all their windows recur
        asked = np.flatnonzero(shard.column("asked").to_numpy())
        spans = []
        for recur in index.recurring([texts[i] for i in asked], least):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], recur.view(np.int8), [0]])))
            spans.append([{"at": a, "n": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())] or None)
        idle_memory()
        found = pa.array(spans, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))
        table = pa.table({"key": shard.column("key").take(asked), "content": shard.column("content").take(asked), "spans": found})
        return table.filter(found.is_valid())

    return run


def _kept(least: int):
    def run(texts: pa.Array, marks: pa.Array) -> pa.Array:
        n_words, n_removed, kept = [], [], []
        for text, found in zip(texts.cast(pa.binary()), marks):
            lists = words_of(text.as_py() or b"")
            spans = np.array([(f["start"] + s["at"], s["n"]) for f in found.as_py() or [] for s in f["spans"]], np.int64).reshape(-1, 2)
            order = np.argsort(spans[:, 0], kind="stable")
            first = spans[order, 0]
            last = np.maximum.accumulate(spans[order].sum(axis=1) + least - 1) if len(order) else first
            at = removed = 0
            out = []
            for words in lists:
                if len(first):
                    place = np.arange(at, at + len(words))
                    before = np.searchsorted(first, place, side="right")
                    stay = (before == 0) | (last[before - 1] <= place)
                    removed += len(words) - int(stay.sum())
                    out.append(b" ".join([w for w, s in zip(words, stay.tolist()) if s]))
                else:
                    out.append(b" ".join(words))
                at += len(words)
            n_words.append(at)
            n_removed.append(removed)
            kept.append(b" ".join([o for o in out if o]))
        done = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        del kept, out
        idle_memory()
        return pa.StructArray.from_arrays(done, ["n_words", "n_removed", "text"])

    return run


def drop_repeated(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, n_words: str = "n_words", n_removed: str = "n_removed", crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The same rows, their text without the words of any passage of least words that also starts anywhere else.

    Elsewhere is another row, or another place of the same row; passages may overlap. All places are judged on the
    given texts. Kept words are joined by one space. n_words: words of the text; n_removed: those that went; columns
    of these names are replaced, all others stay as they are. A null or empty text has no words and becomes empty.
    Repeated rows and keys, null keys among them, are rows of their own: a passage of a row that is there twice
    starts elsewhere. Texts of fewer words than least lose none. An empty table stays empty.
    """
    if least <= GRAM:
        raise ValueError(f"passages must have more than {GRAM} words")
    mark, found_name = free_name(df, "mark"), free_name(df, "found")
    docs = df.select(F.col(key).alias("doc"), F.xxhash64(text_of(text)).alias("mark"), F.col(text).alias("text"))
    kind = docs.schema["doc"].dataType.simpleString()
    cut = f"doc {kind}, mark long, start long, n int, key long, content long, twice boolean"
    all_segments = written(docs.mapInArrow(_cut(least), cut))
    recur = all_segments.groupBy("key").agg(F.count("*").alias("times"), F.max("twice").alias("again")).where("times > 1 or again").select("key")
    held = written(all_segments.join(recur, "key"), release=True)

    # one content for equal segments, and the first place where it stands
    place = F.min(F.struct("doc", "mark", "start", "n")).alias("place")
    contents = written(held.groupBy("key", "content").agg((F.count("*") > 1).alias("heavy"), place), release=True)
    # of a content that stands more than once all windows recur; a key that has no other ones is done
    sure = contents.where("heavy").select("key", "content", F.array(F.struct(F.lit(0).alias("at"), F.col("place.n").alias("n"))).alias("spans"))
    keys = contents.groupBy("key").agg((F.count("*") > crowd).alias("crowded"), F.bool_and("heavy").alias("done"))
    keys = written(keys.where("NOT done").select("key", "crowded"))
    fetched = _fetched(docs, contents.join(keys, "key").select("place.*", "key", "content", "heavy", "crowded"), least)

    normal = fetched.where("words IS NOT NULL AND NOT crowded").select("key", "content", "heavy", (~F.col("heavy")).alias("asked"), "words")
    spans = sure.unionByName(_searched(normal, least, shard_words))
    if not keys.where("crowded").isEmpty():
        windows = fetched.where("words IS NULL").select("key", "content", "heavy", "at", "window")
        place = F.min(F.struct("key", "content", "at")).alias("place")
        again = windows.groupBy("window").agg((F.count("*") > 1).alias("more"), F.max("heavy").alias("heavy"), place).where("more or heavy").select("place.*", "window")
        again = again.join(fetched.where("words IS NOT NULL AND crowded").select("key", "content", "words"), ["key", "content"])
        again = again.select(F.col("window").alias("key"), F.col("window").alias("content"), F.lit(True).alias("heavy"), F.lit(True).alias("asked"), F.slice("words", F.col("at") + 1, least).alias("words"))
        found = _searched(written(again, release=True), least, shard_words).select(F.col("key").alias("window")).distinct()
        hit = windows.where("NOT heavy").join(found, "window").groupBy("key", "content")
        spans = spans.unionByName(hit.agg(F.collect_set(F.struct("at", F.lit(1).alias("n"))).alias("spans")))
    of = held.join(written(spans, release=True), ["key", "content"]).groupBy("doc", "mark")
    marks = written(of.agg(F.collect_set(F.struct("start", "spans")).alias("spans")), release=True)

    rows = df.withColumn(mark, F.xxhash64(text_of(text))).alias("rows")
    marks = marks.select(F.col("doc"), F.col("mark"), F.col("spans").alias(found_name)).alias("marks")
    joined = rows.join(marks, F.col(f"rows.`{key}`").eqNullSafe(F.col("marks.doc")) & (F.col(f"rows.`{mark}`") == F.col("marks.mark")), "left")
    joined = joined.select("rows.*", f"marks.`{found_name}`").drop(mark)
    done = joined.withColumn(found_name, F.arrow_udf(_kept(least), "struct<n_words:bigint,n_removed:bigint,text:string>")(F.col(text), F.col(found_name)))
    return done.withColumns({n_words: F.col(f"{found_name}.n_words"), n_removed: F.col(f"{found_name}.n_removed"), text: F.col(f"{found_name}.text")}).drop(found_name)


def _fetched(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """The wanted contents with their words, read where they stand first; of crowded ones also their windows."""
    of = wanted.groupBy(F.col("doc").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_list(F.struct("start", "n", "key", "content", "heavy", "crowded")).alias("wanted"))
    joined = docs.join(of, F.col("doc").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")))
    schema = "key long, content long, heavy boolean, crowded boolean, at int, window long, words array<long>"
    return written(joined.select("doc", "mark", "text", "wanted").mapInArrow(_fetch(least), schema), release=True)


def _searched(contents: DataFrame, least: int, shard_words: int) -> DataFrame:
    total = contents.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = -(-total // shard_words) or 1
    dealt = contents.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_search(least), "key long, content long, spans array<struct<at:int,n:int>>")


#: drop_repeated in SQL: windows as strings.
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + {LEAST - 1}], ' ') AS s FROM docs, LATERAL (SELECT unnest(range(1, len(w) - {LEAST - 2})) AS i)),
again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {LEAST})) AS j FROM windows JOIN again USING (s)),
lost AS (SELECT r, count(*) AS n, list(j) AS js FROM gone GROUP BY r),
words AS (SELECT docs.r, j, w[j] AS word FROM docs, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS j)),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.j) AS t FROM words LEFT JOIN gone ON gone.r = words.r AND gone.j = words.j WHERE gone.j IS NULL GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN lost ON lost.r = docs.r LEFT JOIN kept ON kept.r = docs.r
"""
