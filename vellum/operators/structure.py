"""Paragraphs, headings, boundaries, boilerplate and numbering of lines and blocks."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import files
from vellum.functions import text as T


def paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, para, n_lines, body, heading): lines between blank ones, trimmed and joined by a space.

    Worked out inside the row, so nothing is shuffled.
    """
    joined = F.array_join(F.transform(T.lines(F.col(text)), lambda x: T.trim(x)), "\n")
    blocks = F.filter(F.split(joined, "\n{2,}"), lambda b: b != "")
    rows = df.select(key, F.posexplode(F.transform(blocks, lambda b: F.regexp_replace(b, "^\n|\n$", ""))).alias("para", "block")).where("block != ''")
    n = F.size(F.split("block", "\n"))
    body = F.replace(F.col("block"), F.lit("\n"), F.lit(" "))
    return rows.select(key, "para", n.alias("n_lines"), body.alias("body"), T.is_heading(body, n).alias("heading"))


def split_at(df: DataFrame, keys: list[str], order: str, boundary: Column, filled: Column | None = None) -> DataFrame:
    """Adds group, from 1: a boundary row opens a group unless the open one has nothing in it yet.

    filled: rows that count as content (all by default); leading rows without content join the first group.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    content = F.lit(True) if filled is None else filled
    before = F.coalesce(F.max(content.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    opens = (boundary & before).cast("int")
    return df.withColumn("group", 1 + F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))


SPANS = "array<struct<group:int,start:int,n:int>>"
_SPANS = pa.list_(pa.struct([("group", pa.int32()), ("start", pa.int32()), ("n", pa.int32())]))


def spans_at(boundaries: Column, filled: Column) -> Column:
    """Groups of a row's items by the rule of split_at, without a shuffle: group from 1, first item from 0, number.

    boundaries, filled: for each item whether it begins a group, and whether it counts as content (array<boolean>).
    """

    def run(edges: pa.Array, content: pa.Array) -> pa.Array:
        out = []
        for e, c in zip(edges.to_pylist(), content.to_pylist()):
            starts, seen = [], False
            for i, (edge, full) in enumerate(zip(e or [], c or [])):
                if not i or edge and seen:
                    starts.append(i)
                seen = seen or bool(full)
            out.append([{"group": g, "start": a, "n": b - a} for g, (a, b) in enumerate(zip(starts, [*starts[1:], len(e or [])]), 1)])
        return pa.array(out, _SPANS)

    return F.arrow_udf(run, SPANS)(boundaries, filled)


def heading_level(counts: dict[str, Column] | None = None) -> Column:
    """First of h1, h2, h3 that occurs at least twice; null if none does. counts: how often each does, else columns."""
    counts = counts or {h: F.col(h) for h in ("h1", "h2", "h3")}
    return F.when(counts["h1"] >= 2, "h1").when(counts["h2"] >= 2, "h2").when(counts["h3"] >= 2, "h3")


def promoted(blocks: DataFrame, key: str, title: Column, fallback: Column) -> DataFrame:
    """Adds ch and chapter: blocks of a document as titled chapters.

    A chapter begins at each heading of the first level among h1, h2, h3 that two direct children of the body or more
    have. It is titled by its first heading, else by fallback and its number; without such a level there is one, titled
    by its first heading or title. A chapter without text or picture goes but is counted. blocks: key, pos, tag, body,
    direct; title and fallback are columns of them.
    """
    w = Window.partitionBy(key)
    n = lambda tag: F.count_if((F.col("tag") == tag) & F.col("direct")).over(w)
    level = heading_level({h: n(h) for h in ("h1", "h2", "h3")})
    counted = blocks.withColumns({"_title": title, "_fallback": fallback, "_level": level})
    grouped = split_at(counted, [key], "pos", F.coalesce((F.col("tag") == F.col("_level")) & F.col("direct"), F.lit(False))).withColumnRenamed("group", "ch")
    heading = F.when(F.col("tag").rlike("^h[1-6]$"), F.struct("pos", F.left(T.collapse(F.col("body")), F.lit(150)).alias("t")))
    each = Window.partitionBy(key, "ch")
    named = grouped.withColumns({"_head": F.min(heading).over(each)["t"], "_filled": F.max((F.col("tag") != "hr").cast("int")).over(each)})
    own = F.when(F.col("_level").isNull(), F.col("_title")).otherwise(F.concat_ws(" ", "_fallback", F.col("ch").cast("string")))
    return named.where("_filled = 1").withColumn("chapter", F.coalesce("_head", own)).drop("_title", "_fallback", "_level", "_head", "_filled")


def boilerplate(pages: DataFrame, doc: str, page: str, line: str, short: int = 80, least_pages: int = 4, least: int = 3, share: float = 0.3) -> DataFrame:
    """(doc, line_key, n_pages): short lines, digits masked, that stand on enough of a document's pages."""
    lines = pages.select(doc, page, T.trim(F.col(line)).alias("t")).where((F.col("t") != "") & (F.char_length("t") < short))
    counted = lines.select(doc, page, T.mask_digits(F.col("t")).alias("line_key")).distinct().groupBy(doc, "line_key").agg(F.count("*").alias("n_pages"))
    total = pages.select(doc, page).distinct().groupBy(doc).agg(F.count("*").alias("pages"))
    kept = counted.join(total, doc).where((F.col("pages") >= least_pages) & (F.col("n_pages") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))))
    return kept.select(doc, "line_key", "n_pages")


def continuation(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Adds group: a row that begins in lower case after a row without closing punctuation, or after a hyphen,
    continues the paragraph. Only the end of the row before matters, however much was merged."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = T.trim(F.lag(text).over(w))
    goes_on = before.isNotNull() & (before != "") & F.col(text).rlike(r"^\p{Ll}") & (~before.rlike(r"[.!?:;]$") | before.endswith("-"))
    return df.withColumn("group", F.sum((~goes_on).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def dehyphenate(c: Column) -> Column:
    """Joins words cut by a hyphen at a line end before a lower-case letter; other line ends become spaces."""
    return F.regexp_replace(F.regexp_replace(c, r"-\n(?=\p{Ll})", ""), "\n", " ")


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds i of n within the keys."""
    w = Window.partitionBy(*keys)
    return df.withColumn("i", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))


def first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """First row of each value within the keys."""
    return df.groupBy(*keys, value).agg(F.min(order).alias(order))


def _beside(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """df with what was found of its keys, null keys being keys."""
    named = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(named, met).drop(*[f"_{k}" for k in keys])


def keep_last(df: DataFrame, keys: list[str], order: str, remove: str) -> DataFrame:
    """Takes the last removal back where all rows of a key would be removed."""
    ends = df.groupBy(*keys).agg(F.min(F.col(remove).cast("int")).alias("_every"), F.max(order).alias("_last"))
    last = (F.col("_every") == 1) & (F.col(order) == F.col("_last"))
    return _beside(df, ends, keys).withColumn(remove, F.col(remove) & ~last).drop("_every", "_last")


def clamp_levels(levels: Column) -> Column:
    """Outline levels such that none is more than one deeper than the one before; the first is 1."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for row in column.to_pylist():
            depth, found = 0, []
            for level in row or []:
                depth = min(level, depth + 1)
                found.append(depth)
            out.append(None if row is None else found)
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(levels.cast("array<int>"))


def ranged(bookmarks: DataFrame, parts: DataFrame, doc: str) -> DataFrame:
    """Bookmarks of each part (start < page <= end), with pages counted from the part's start."""
    b, p = bookmarks.alias("b"), parts.alias("p")
    hit = (F.col(f"b.{doc}") == F.col(f"p.{doc}")) & (F.col("b.page") > F.col("p.start")) & (F.col("b.page") <= F.col("p.end"))
    return b.join(p, hit).select(F.col(f"p.{doc}"), "p.part", "b.title", (F.col("b.page") - F.col("p.start")).alias("page"))


def image_order(images: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Pictures of a package with their place (ix, from 1) by name; files of other kinds are left out."""
    return images.where(files.is_image(F.col(name))).withColumn("ix", F.row_number().over(Window.partitionBy(*keys).orderBy(name)))


def image_names(images: DataFrame, doc: str, order: list[str], data: str, least: int = 64) -> DataFrame:
    """(doc, sha1, name, uses): distinct images of a document, named by first use; tiny ones are left out."""
    kept = images.where(F.octet_length(data) >= least).withColumn("sha1", F.sha1(F.col(data).cast("binary")))
    found = kept.groupBy(doc, "sha1").agg(F.count("*").alias("uses"), F.min(F.struct(*order)).alias("first"))
    n = F.row_number().over(Window.partitionBy(doc).orderBy("first"))
    return found.select(doc, "sha1", F.format_string("img_%04d", n).alias("name"), "uses")


def size_estimates(pages: DataFrame, doc: str, estimate: str, total: str) -> DataFrame:
    """Page estimates scaled to the document's real size, plus 200, at least 512."""
    summed = pages.groupBy(doc).agg(F.sum(estimate).alias("_sum"))
    scaled = F.greatest(F.lit(512), F.floor(F.col(estimate) * (F.col(total) / F.col("_sum"))) + 200).cast("long")
    return _beside(pages, summed, [doc]).withColumn("scaled", scaled).drop("_sum")


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median, upper_median): the middle value, interpolated, and the upper one of an even number.

    Works on how often each value occurs, so no group is gathered.
    """
    times = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_times"))
    w = Window.partitionBy(key)
    upto = times.withColumn("_upto", F.sum("_times").over(w.orderBy(value))).withColumn("_all", F.sum("_times").over(w))
    at = lambda place: F.min(F.when(F.col("_upto") >= place, F.col(value)))
    low, high = at(F.floor((F.col("_all") + 1) / 2)), at(F.floor(F.col("_all") / 2) + 1)
    return upto.groupBy(key).agg(((low + high) / 2).alias("median"), high.alias("upper_median"))


def book_sizes(images: DataFrame, chapters: DataFrame, doc: str) -> DataFrame:
    """(doc, image_bytes, chars): bytes of a book's images (doc, data) and characters of its chapters (doc, text)."""
    a = images.groupBy(doc).agg(F.sum(F.octet_length("data")).alias("image_bytes"))
    b = chapters.groupBy(doc).agg(F.sum(F.char_length("text")).alias("chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, doc, "full_outer").select(doc, zero("image_bytes"), zero("chars"))


def unused(media: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Media that nothing uses."""
    return media.join(used.select(key), key, "left_anti")


def pooled(labels: dict[str, DataFrame]) -> DataFrame:
    """Frames of equal columns in one, told apart by origin, for a pass over all of them."""
    frames = [df.withColumn("origin", F.lit(name)) for name, df in labels.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def runs(events: DataFrame, keys: list[str], order: str, kind: str = "kind", text: str = "text") -> DataFrame:
    """(keys, run, body): neighbouring text pieces of a paragraph, kept apart by tabs and breaks.

    events: keys (the paragraph), order, kind (text, tab, br or cr), text.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("run", F.sum((F.col(kind) != "text").cast("int")).over(w)).where(F.col(kind) == "text")
    joined = marked.groupBy(*keys, "run").agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("t"))
    return joined.select(*keys, "run", F.array_join(F.transform("t", lambda s: s[text]), "").alias("body"))


def flat_row(cells: Column) -> Column:
    """Filled cells of a table row as one line."""
    return F.array_join(F.filter(F.transform(cells, lambda c: T.collapse(c)), lambda c: c != ""), "  |  ")


def rewritten(uses: DataFrame, images: DataFrame, doc: str, source: str = "src") -> DataFrame:
    """Uses of images with their stored names; a use of an unknown image goes. images: doc, src, name."""
    return uses.join(images, [doc, source]).withColumn(source, F.concat(F.lit("images/"), F.col("name"))).drop("name")
