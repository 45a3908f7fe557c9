"""Size-bounded packing that keeps the order: batches of segments, parts of texts, blocks and chapters."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import BATCH_CHARS, BATCH_ITEMS, MAX_SPLIT_KB, MIN_SPLIT_BYTES, MIN_SPLIT_KB
from vellum.functions.files import part_name
from vellum.functions.pieces import replaced

SPANS = "array<struct<start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def next_fit(sizes: list[int], items: int, total: int) -> list[int]:
    """Batch of each size, from 1: a batch ends before it has more than items or more than total; a size beyond
    total is a batch by itself."""
    out, batch, n, held = [], 1, 0, 0
    for size in sizes:
        if n and (n >= items or held + size > total):
            batch, n, held = batch + 1, 0, 0
        n, held = n + 1, held + size
        out.append(batch)
    return out


def batches(df: DataFrame, bodies: str, items: int = BATCH_ITEMS, chars: int = BATCH_CHARS) -> DataFrame:
    """Batch of each distinct body of a job. df: a row for each job, bodies: its array of strings in order.

    Packing is sequential within a job and runs over arrays of sizes, a job in one row, without a shuffle.
    """
    unique = F.array_distinct(bodies)

    def pack(sizes: pa.Array) -> pa.Array:
        return pa.array([None if s is None else next_fit(s, items, chars) for s in sizes.to_pylist()], pa.list_(pa.int32()))

    sizes = F.transform(unique, lambda b: F.char_length(b))
    packed = df.withColumn("_unique", unique).withColumn("_batch", F.arrow_udf(pack, "array<int>")(sizes))
    kept = [c for c in df.columns if c != bodies]
    return packed.select(*kept, F.posexplode(F.arrays_zip("_unique", "_batch")).alias("bpos", "z")).select(*kept, "bpos", F.col("z._unique").alias("body"), F.col("z._batch").alias("batch"))


def split_size(kb: Column, most: int = MAX_SPLIT_KB) -> Column:
    """Verdict on a wished part size in KB: null for none (0), error for one out of bounds or below zero."""
    return F.when(kb == 0, None).when(kb.between(MIN_SPLIT_KB, most), "ok").otherwise("error")


def _after_blank(blanks: list[int], start: int, stop: int) -> int:
    """Where a part from start ends that must end at stop: after its last blank line, if that is in its second half."""
    i = bisect_left(blanks, stop) - 1
    return blanks[i] + 1 if i >= 0 and blanks[i] - start > (stop - start) // 2 else stop


def cut_text(text: str, limit: int) -> list[str]:
    """Parts of whole lines, each of at most limit bytes with its line ends unless it is a single line."""
    end = "\r\n" if "\r\n" in text else "\n"
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    upto = list(accumulate((len(line.encode()) + len(end) for line in lines), initial=0))
    blanks = [i for i, line in enumerate(lines) if not line.strip()]
    parts, start = [], 0
    while start < len(lines):
        stop = max(start + 1, bisect_right(upto, upto[start] + limit) - 1)
        if stop < len(lines):
            stop = _after_blank(blanks, start, stop)
        parts.append(end.join(lines[start:stop]))
        start = stop
    return parts


def split_error(largest: Column, parts: Column, limit: int) -> Column:
    """Why a document cannot be split as wished; null where all parts fit, or where there is one part only."""
    return F.when((parts > 1) & (largest > limit), F.concat(F.lit("no part can be smaller than "), largest.cast("string"), F.lit(" bytes")))


def split_texts(df: DataFrame, limit: int, name: str = "name", text: str = "text", least: int = MIN_SPLIT_BYTES) -> DataFrame:
    """A row for each part of each text: part, parts, part_name, body, size in bytes, error. Texts that fit stay whole."""
    if limit < least:
        raise ValueError(f"a part has {least} bytes at least")

    def run(texts: list) -> list:
        return [[t] if t is not None and len(t.encode()) <= limit else cut_text(t or "", limit) for t in texts]

    kept = [c for c in df.columns if c != text]
    parts = replaced(df, kept, text, "_parts", run, pa.list_(pa.string()), "array<string>")
    error = split_error(F.array_max(F.transform("_parts", lambda p: F.octet_length(p))), F.size("_parts"), limit)
    parts = parts.select(*kept, F.size("_parts").alias("parts"), error.alias("error"), F.posexplode("_parts").alias("part", "body"))
    parts = parts.withColumn("part", F.col("part") + 1).withColumn("size", F.octet_length("body"))
    return parts.withColumn("part_name", part_name(F.col(name), F.col("part"), F.col("parts")))


def _fitting(start: int, n: int, limit: int, build: Callable[[int, int], int]) -> int:
    """How many of n items from start fit when they are built together, by the ratio of limit and real size."""
    while n > 1 and (real := build(start, start + n)) > limit:
        n = min(n - 1, max(1, int(0.9 * n * limit / real)))
    return n


def packed(sizes: list[int], limit: int, overhead: int, build: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Spans of items whose built size is at most limit, unless it is one item.

    Estimated sizes fill a budget of nine tenths of the limit less the overhead (a quarter of the limit at least);
    build(start, stop) tells the real size of such a span.
    """
    upto, budget = list(accumulate(sizes, initial=0)), max(limit * 9 // 10 - overhead, limit // 4)
    spans, start = [], 0
    while start < len(sizes):
        n = max(1, bisect_right(upto, upto[start] + budget) - 1 - start)
        n = _fitting(start, n, limit, build)
        spans.append((start, start + n))
        start += n
    return spans


def _spans(limit: int, overhead: int, joint: int):
    """Column function: sizes of pieces -> spans. joint: bytes that stand between two pieces."""

    def one(sizes: list[int]) -> list[dict]:
        upto = list(accumulate(sizes, initial=0))
        real = lambda a, b: upto[b] - upto[a] + joint * (b - a - 1) + overhead
        return [{"start": a, "stop": b} for a, b in packed(sizes, limit, overhead, real)]

    return F.arrow_udf(lambda sizes: pa.array([one(s) for s in sizes.to_pylist()], _SPANS), SPANS)


def split_blocks(blocks: DataFrame, limit: int, overhead: int, key: str = "path", piece: str = "piece") -> DataFrame:
    """(key, part, parts, body, size, error): ordered pieces of a document in parts of at most limit bytes.

    What stands in every part (overhead) counts; a piece beyond the limit is a part by itself. blocks: key, pos, piece.
    """
    docs = blocks.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", piece))), lambda s: s[piece]).alias("_pieces"))
    docs = docs.withColumn("_spans", _spans(limit, overhead, 1)(F.transform("_pieces", lambda p: F.octet_length(p))))
    bodies = F.transform("_spans", lambda s: F.array_join(F.slice("_pieces", s["start"] + 1, s["stop"] - s["start"]), "\n"))
    docs = docs.select(key, bodies.alias("_bodies"))
    error = split_error(F.array_max(F.transform("_bodies", lambda b: F.octet_length(b))) + overhead, F.size("_bodies"), limit)
    rows = docs.select(key, F.size("_bodies").alias("parts"), error.alias("error"), F.posexplode("_bodies").alias("part", "body"))
    return rows.select(key, (F.col("part") + 1).alias("part"), "parts", "body", F.octet_length("body").alias("size"), "error")


def chapter_slices(chapters: DataFrame, limit: int, key: str = "path") -> DataFrame:
    """Chapters beyond a third of the limit cut between their blocks: key, ch, k, title, blocks, estimate.

    chapters: key, ch, title, blocks (array of markup), media (bytes of its images). A cut chapter's slices are titled
    with their number. The estimate takes a third of the markup, 600 bytes and the media, which stay with slice 1.
    """
    ends = F.arrow_udf(lambda sizes: pa.array([_bounds(next_fit(s, 1 << 30, max(1, limit // 3))) for s in sizes.to_pylist()], _SPANS), SPANS)
    cut = chapters.withColumn("_spans", ends(F.transform("blocks", lambda b: F.octet_length(b))))
    rows = cut.select(key, "ch", "title", "media", "blocks", F.size("_spans").alias("_n"), F.posexplode_outer("_spans").alias("_k", "_s"))
    k = F.coalesce(F.col("_k"), F.lit(0)) + 1
    some = F.when(F.col("_s").isNotNull(), F.slice("blocks", F.col("_s.start") + 1, F.col("_s.stop") - F.col("_s.start"))).otherwise(F.col("blocks"))
    title = F.when(F.col("_n") > 1, F.format_string("%s (%d)", "title", k)).otherwise(F.col("title"))
    rows = rows.select(key, "ch", k.alias("k"), title.alias("title"), some.alias("blocks"), F.when(k == 1, F.col("media")).otherwise(0).alias("_media"))
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b))
    return rows.withColumn("estimate", F.floor(size / 3).cast("long") + 600 + F.col("_media")).drop("_media")


def _bounds(groups: list[int]) -> list[dict]:
    """Spans of equal neighbours."""
    edges = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
    return [{"start": a, "stop": b} for a, b in zip(edges, edges[1:]) if b > a]


def split_chapters(chapters: DataFrame, limit: int, css: int = 0, cover: int = 0, key: str = "path") -> DataFrame:
    """(key, part, parts, ch, k, title, estimate): a book's chapters in parts of about limit bytes, in order.

    css, cover: bytes of the style sheets, which stand in every part, and of the cover, which the first part has.
    """
    slices = chapter_slices(chapters, limit, key).drop("blocks")
    books = slices.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ch", "k", "title", "estimate"))).alias("_s"))
    sizes = F.transform("_s", lambda s, i: s["estimate"] + F.when(i == 0, cover).otherwise(0))
    books = books.withColumn("_spans", _spans(limit, css // 3 + 4096, 0)(sizes))
    rows = books.select(key, "_s", F.size("_spans").alias("parts"), F.posexplode("_spans").alias("_p", "_span"))
    rows = rows.select(key, (F.col("_p") + 1).alias("part"), "parts", F.explode(F.slice("_s", F.col("_span.start") + 1, F.col("_span.stop") - F.col("_span.start"))).alias("s"))
    return rows.select(key, "part", "parts", "s.ch", "s.k", "s.title", "s.estimate")
