"""Finished files changed in place: texts, pages and packages with new texts, books after clean-up, conversions.

What changes is worked out as tables; a file is then rebuilt in its row, with all that does not change byte for byte.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import files
from vellum.functions import text as T
from vellum.operators import cleanup, markup, translate
from vellum.shared import written
from vellum.sources import packages, parts, writers

PAGE = "array<struct<name:string,data:binary>>"


def rezipped(content: bytes, changed: dict[str, bytes | None]) -> bytes:
    """The package with changed entries (null: removed); folders and later namesakes go, order and packing stay."""
    out, seen = io.BytesIO(), set()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            if info.is_dir() or info.filename in seen:
                continue
            seen.add(info.filename)
            data = changed[info.filename] if info.filename in changed else old.read(info)
            if data is not None:
                new.writestr(info, data, info.compress_type)
    return out.getvalue()


def translated_texts(texts: DataFrame, provider, key: str = "path", text: str = "text") -> DataFrame:
    """(key, text): texts with their lines translated, white space around them and line ends as they were.

    A line that the provider gives back untranslated stays. Distinct bodies are translated once.
    """
    end = F.when(F.contains(text, F.lit("\r\n")), "\r\n").otherwise("\n")
    lines = texts.select(key, F.posexplode(T.lines(F.col(text))).alias("pos", "line")).where(T.translatable(F.col("line"))).withColumn("body", T.trim(F.col("line")))
    found = translate.finished(lines.select("body").distinct(), provider).where("translated IS NOT NULL").select("body", "translated")
    new = F.concat(T.lead(F.col("line")), F.col("translated"), T.trail(F.col("line")))
    done = lines.join(found, "body").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", new.alias("new")))).alias("_new"))
    rows = texts.select(key, text, end.alias("_end")).join(done, key, "left")
    whole = F.transform(T.lines(F.col(text)), lambda line, i: F.coalesce(F.try_element_at("_new", i), line))
    return rows.select(key, F.when(F.col("_new").isNull(), F.col(text)).otherwise(F.concat_ws("", F.array_join(whole, "\x00"))).alias("_t"), "_end").select(key, F.replace("_t", F.lit("\x00"), F.col("_end")).alias(text))


def translated_pages(pages: DataFrame, provider, key: str = "path", page: str = "html") -> DataFrame:
    """pages with their text nodes translated; prolog, markup and all other columns stay."""
    held = markup.text_nodes(pages.select(key, page), page).select(key, F.posexplode("texts").alias("pos", "raw"))
    some = held.where(T.translatable(F.col("raw"))).withColumn("body", T.trim(F.col("raw")))
    found = translate.finished(some.select("body").distinct(), provider).where("translated IS NOT NULL").select("body", "translated")
    new = F.concat(T.lead(F.col("raw")), F.col("translated"), T.trail(F.col("raw")))
    done = held.join(some.join(found, "body").select(key, "pos", new.alias("new")), [key, "pos"], "left")
    done = done.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda s: s["new"]).alias("_new"))
    rows = pages.join(done, key, "left")
    return rows.withColumn(page, markup.replaced_texts(F.col(page), F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")


def translated_books(packed: DataFrame, provider, key: str = "path", content: str = "content") -> DataFrame:
    """(key, content): packages whose pages are translated in place, those outside the reading order too; the rest of
    the package stays."""
    found = packages.kept_entries(packages.entries(packed, key, content), key)
    pages = found.where(files.page_entry(F.col("name"), F.col("data"))).select(key, "name", packages.decoded_markup(F.col("data")).alias("html"))
    pages = pages.withColumn("_page", F.concat_ws("\x00", key, "name"))
    return rebuilt(packed, translated_pages(pages, provider, "_page").select(key, "name", F.encode("html", "UTF-8").alias("data")), key, content)


def rebuilt(packed: DataFrame, changed: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, content): packages with their changed entries (key, name, data); one without any keeps its bytes."""
    new = changed.groupBy(key).agg(F.collect_list(F.struct("name", "data")).alias("_pages"))

    def run(contents: pa.Array, pages: pa.Array) -> pa.Array:
        return pa.array([c if p is None else rezipped(c, {e["name"]: e["data"] for e in p}) for c, p in zip(contents.to_pylist(), pages.to_pylist())], pa.binary())

    rows = packed.select(key, content).join(new, key, "left")
    return rows.select(key, F.arrow_udf(run, "binary")(F.col(content), F.col("_pages")).alias(content))


def cleaned_books(packed: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, content, notes): packages after clean-up. A package without extras keeps its bytes and has no notes.

    Pages that leave go with their entries in the manifest, the spine and the contents lists of both kinds; marked
    blocks are cut out of the pages that stay. Prolog, comments and all other bytes of the edited entries stay.
    """
    # what goes is worked out from the pages in several passes
    pages = written(packages.spine(packages.entries(packed, key, content), key).withColumn("html", packages.decoded_markup(F.col("data"))))
    removed = written(cleanup.removed_pages(pages, key))
    staying = pages.join(removed.select(key, "name"), [key, "name"], "left_anti")
    single = Window.partitionBy(key)
    staying = staying.withColumn("_n", F.count("*").over(single)).join(removed.select(key).distinct().withColumn("_some", F.lit(True)), key, "left").where("_n > 1 OR _some").drop("_n", "_some")
    dropped = written(cleanup.dropped_blocks(staying, key).join(pages.select(key, "spine_ix", "name"), [key, "spine_ix"]))
    gone = removed.groupBy(key).agg(F.collect_list("name").alias("_gone"))
    cut = dropped.groupBy(key, "name").agg(F.collect_list("node").alias("nodes")).groupBy(key).agg(F.collect_list(F.struct("name", "nodes")).alias("_cut"))
    notes = cleanup.notes(removed, dropped, key).groupBy(key).agg(F.sort_array(F.collect_list("note")).alias("notes"))

    def run(contents: pa.Array, gone: pa.Array, cut: pa.Array) -> pa.Array:
        return pa.array([c if g is None and n is None else _cleaned(c, set(g or []), {e["name"]: set(e["nodes"]) for e in n or []}) for c, g, n in zip(contents.to_pylist(), gone.to_pylist(), cut.to_pylist())], pa.binary())

    rows = packed.select(key, content).join(gone, key, "left").join(cut, key, "left").join(notes, key, "left")
    return rows.select(key, F.arrow_udf(run, "binary")(F.col(content), F.col("_gone"), F.col("_cut")).alias(content), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))


def _cleaned(content: bytes, gone: set[str], cut: dict[str, set[int]]) -> bytes:
    changed: dict[str, bytes | None] = dict.fromkeys(gone)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            name = info.filename
            if name in changed or info.is_dir():
                continue
            kind = name.lower().rsplit(".", 1)[-1]
            if kind not in ("opf", "ncx") and name not in cut and not kind.endswith("html"):
                continue
            page = packages.decode_markup(z.read(info))
            rows = markup.Elements(page).rows
            spans = [(rows[i]["start"], rows[i]["stop"]) for i in cut.get(name, ())]
            spans += _pruned(rows, posixpath.dirname(name), gone, kind)
            if spans:
                changed[name] = markup.without(page, spans).encode()
    return rezipped(content, changed)


def _pruned(rows: list[dict], base: str, gone: set[str], kind: str) -> list[tuple[int, int]]:
    """Spans of what refers to removed pages: manifest items and their places in the spine, entries of contents lists."""

    def target(href: str | None) -> str:
        return posixpath.normpath(posixpath.join(base, unquote((href or "").split("#")[0])))

    def around(i: int, tag: str, top: str) -> dict:
        """The nearest enclosing entry of a list, or the element itself."""
        at = rows[i]
        while at["parent"] is not None and rows[at["parent"]]["tag"] != top:
            at = rows[at["parent"]]
            if at["tag"] == tag:
                return at
        return rows[i]

    out = []
    if kind == "opf":
        ids = {a.get("id") for r in rows if r["tag"] == "item" and target((a := dict(r["attrs"])).get("href")) in gone}
        for r in rows:
            a = dict(r["attrs"])
            if (r["tag"] == "item" and a.get("id") in ids) or (r["tag"] == "itemref" and a.get("idref") in ids):
                out.append((r["start"], r["stop"]))
    elif kind == "ncx":
        for i, r in enumerate(rows):
            if r["tag"] == "content" and target(dict(r["attrs"]).get("src")) in gone:
                entry = around(i, "navpoint", "navmap")
                out.append((entry["start"], entry["stop"]))
    else:
        inside = [(i, r["until"]) for i, r in enumerate(rows) if r["tag"] == "nav"]
        for first, until in inside:
            for i in range(first, until):
                if rows[i]["tag"] == "a" and target(dict(rows[i]["attrs"]).get("href")) in gone:
                    entry = around(i, "li", "nav")
                    out.append((entry["start"], entry["stop"]))
    return out


def convert(documents: DataFrame, to: str) -> DataFrame:
    """(path, name, content): files as the kind of the extension to (.txt, .html, .epub or .docx).

    documents: path, name, ext, kind, content. A file of that kind is copied byte for byte; others are read as blocks
    and written anew, with their marks, lists, tables, pictures, cover and styles as far as the kind has them. Rows of
    an unknown or unreadable kind have null content. Pictures beside pages are found if they are among the documents.
    """
    same = files.same_kind(F.col("ext"), F.lit(to))
    name = F.concat(F.regexp_replace("name", r"\.[^./]+$", ""), F.lit(to))
    copies = documents.where(same).select("path", "name", "content")
    others = documents.where(~F.coalesce(same, F.lit(False)))
    # read once: writers go over the blocks for text, pictures and names
    blocks = written(packages.any_blocks(others))
    titles = written(_titles(others).join(blocks.select("path").distinct(), "path", "left_semi"))
    if to == ".txt":
        made = writers.as_text(blocks, titles)
    else:
        shown = blocks.unionByName(_covers(titles), allowMissingColumns=True)
        images = written(packages.pictures(documents.where(~F.coalesce(same, F.lit(False))), shown))
        covers = titles.select("path", F.lower("cover").alias("source")).where("source IS NOT NULL").join(images.withColumn("source", F.lower("source")).select("path", "source", F.col("name").alias("cover_name")), ["path", "source"])
        titles = titles.drop("cover").join(covers.select("path", F.col("cover_name").alias("cover")).dropDuplicates(["path"]), "path", "left")
        made = {".html": writers.as_html, ".epub": writers.as_epub, ".docx": writers.as_word}[to](blocks, titles, images=images)
    data = F.col(made.columns[1])
    made = made.select("path", (data if to in (".epub", ".docx") else F.encode(data, "UTF-8")).alias("content"))
    return copies.unionByName(others.select("path", name.alias("name")).join(made, "path", "left").select("path", "name", "content"))


def _covers(titles: DataFrame) -> DataFrame:
    """Covers as pictures behind all others, so that they are read too."""
    last = F.lit(2**31 - 1)
    return titles.where("cover IS NOT NULL").select("path", last.alias("ch"), last.cast("long").alias("pos"), F.lit("img").alias("tag"), F.col("cover").alias("body"))


def _titles(documents: DataFrame) -> DataFrame:
    """(path, title, author, lang, css, cover): what documents say of themselves; a title is at least the file's name."""
    stem = F.regexp_replace("name", r"\.[^./]+$", "")
    of = lambda kind: documents.where(F.col("kind") == kind)
    books = packages.extras(packages.entries(of("epub")))
    pages = of("html").select("path", packages.decoded_markup(F.col("content")).alias("html"))
    sheets = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<style\b[^>]*>(.*?)</style\s*>"), 1), lambda s: s), "\n")
    pages = markup.titles(pages.withColumn("css", sheets)).select("path", "title", "css")
    word = parts.core_facts(packages.kept_entries(packages.entries(of("docx"))))
    found = books.unionByName(pages, allowMissingColumns=True).unionByName(word, allowMissingColumns=True)
    rows = documents.select("path", stem.alias("stem")).join(found, "path", "left")
    return rows.select("path", F.coalesce(F.when(F.col("title") != "", F.col("title")), "stem").alias("title"), "author", "lang", "css", "cover")


def text_only(pages: Column) -> Column:
    """Pages without their images."""
    return F.regexp_replace(pages, r"(?is)<(?:img|image)\b[^>]*>", "")
