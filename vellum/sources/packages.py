"""Files and zipped packages as tables: bytes, entries, manifests, spines, paragraphs.

Python opens zips and XML, a file in a row; which entries, pages and media belong together is joins and windows.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import files
from vellum.functions import text as T
from vellum.operators import blocks, markup, structure
from vellum.sources import markdown, parts
from vellum.sources.wordblocks import docx_blocks

#: A package with more entries or more unpacked bytes is not opened.
MAX_ENTRIES, MAX_BYTES = 20_000, 1 << 30
#: Unpacked bytes that leave a worker together.
PIECE = 32 << 20


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, ext, kind, content) of the files under a path; unknown kinds have a null kind."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = files.detect_format(name, F.lit(None).cast("string"))
    return raw.select("path", name.alias("name"), ext.alias("ext"), F.when(ext.isNotNull(), files.kind_of(F.coalesce(ext, F.lit(".txt")))).alias("kind"), "content")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-16 with its mark, UTF-8, Windows-1252, Latin-1, whichever fits first."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else _decode(v) for v in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(content)


def _decode(data: bytes) -> str:
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


_DECLARED = re.compile(rb"(?:charset|encoding)\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def decode_markup(data: bytes) -> str:
    """Text of HTML or XML bytes: by the encoding that the first 4 KiB declare, if it is a known one, else as _decode."""
    declared = _DECLARED.search(data[:4096])
    if declared and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return data.decode(codecs.lookup(declared[1].decode()).name, "replace").removeprefix("\ufeff")
        except (LookupError, ValueError):
            pass
    return _decode(data)


def decoded_markup(content: Column) -> Column:
    return F.arrow_udf(lambda column: pa.array([None if v is None else decode_markup(v) for v in column.to_pylist()], pa.string()), "string")(content)


def entries(packed: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, ix, name, stored, data, error): a row for each entry of each zip; one with an error if it is no whole zip.

    A worker holds PIECE bytes of a package, or its largest entry, at a time.
    """
    columns = [key, "ix", "name", "stored", "data"]

    def run(frames):
        for frame in frames:
            for k, data in zip(frame[key], frame[content]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        infos = z.infolist()
                        if len(infos) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_BYTES:
                            raise ValueError("package is too large")
                        if not infos or (bad := z.testzip()) is not None:
                            raise ValueError("package is empty" if not infos else f"{bad} is damaged")
                        rows, held = [], 0
                        for ix, i in enumerate(infos):
                            rows.append((k, ix, i.filename, i.compress_type == zipfile.ZIP_STORED, z.read(i)))
                            held += i.file_size
                            if held >= PIECE or ix + 1 == len(infos):
                                yield pd.DataFrame(rows, columns=columns).assign(error=None)
                                rows, held = [], 0
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, ValueError, TypeError, RuntimeError, OSError) as e:
                    yield pd.DataFrame([(k, 0, None, None, None)], columns=columns).assign(error=str(e))

    return packed.select(key, content).mapInPandas(run, f"{key} string, ix int, name string, stored boolean, data binary, error string")


def kept_entries(rows: DataFrame, key: str = "path") -> DataFrame:
    """Entries without folders and later namesakes."""
    w = Window.partitionBy(key, "name").orderBy("ix")
    return rows.where(F.col("name").isNotNull() & ~F.col("name").endswith("/")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


PACKAGE = "struct<title:string,author:string,lang:string,cover:string,manifest:array<struct<id:string,href:string,media:string,properties:string>>,spine:array<string>>"


def _package(data: bytes | None):
    try:
        root = ElementTree.fromstring(data or b"")
    except ElementTree.ParseError:
        return None
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = {"title": None, "author": None, "lang": None, "cover": None, "manifest": [], "spine": []}
    for e in root.iter():
        match local(e):
            case "title" if out["title"] is None:
                out["title"] = (e.text or "").strip() or None
            case "creator" if out["author"] is None:
                out["author"] = (e.text or "").strip() or None
            case "language" if out["lang"] is None:
                out["lang"] = (e.text or "").strip() or None
            case "meta" if e.get("name") == "cover" and out["cover"] is None:
                out["cover"] = e.get("content")
            case "item":
                out["manifest"].append({"id": e.get("id"), "href": e.get("href"), "media": e.get("media-type"), "properties": e.get("properties") or ""})
            case "itemref":
                out["spine"].append(e.get("idref"))
    return out


def _books(found: DataFrame, key: str) -> DataFrame:
    """(key, base, p): folder and content of each book's package file."""
    container = parts.root_files(found, key)
    opf = found.where("lower(name) like '%.opf'").join(container, key, "left")
    first = Window.partitionBy(key).orderBy(F.when(F.lower("name") == F.lower("named"), 0).otherwise(1), "ix")
    opf = opf.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    types = pa.struct([("title", pa.string()), ("author", pa.string()), ("lang", pa.string()), ("cover", pa.string()), ("manifest", pa.list_(pa.struct([(c, pa.string()) for c in ("id", "href", "media", "properties")]))), ("spine", pa.list_(pa.string()))])
    parsed = F.arrow_udf(lambda c: pa.array([_package(v) for v in c.to_pylist()], types), PACKAGE)
    base = F.regexp_replace("name", "/?[^/]*$", "")
    return opf.select(key, base.alias("base"), parsed("data").alias("p"))


def spine(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, spine_ix, name, nav, data): pages of EPUB packages in reading order.

    The package file is the one that container.xml names, else the first *.opf. A page listed twice counts once;
    an empty spine gives every page of the manifest.
    """
    found = kept_entries(rows, key)
    books = _books(found, key)
    items = books.select(key, "base", F.inline("p.manifest")).select(key, F.col("id"), files.normal_path(F.col("base"), F.col("href")).alias("target"), F.col("media"), F.col("properties").contains("nav").alias("nav"))
    listed = books.select(key, F.posexplode("p.spine").alias("pos", "id")).groupBy(key, "id").agg(F.min("pos").alias("pos"))
    joined = listed.join(items, [key, "id"]).select(key, "pos", "target", "nav")
    whole = items.where(F.col("media").contains("html")).join(joined.select(key).distinct(), key, "left_anti").select(key, F.row_number().over(Window.partitionBy(key).orderBy("target")).alias("pos"), "target", "nav")
    pages = joined.unionByName(whole).withColumn("low", F.lower("target"))
    data = found.select(key, F.col("name"), "data", F.lower("name").alias("low"))
    hit = pages.join(data, [key, "low"])
    return hit.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).alias("spine_ix"), "name", "nav", "data")


def extras(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, title, author, lang, cover, css): facts of EPUB packages, the entry of the cover, and all style sheets joined.

    The cover is the item that says so, else the one that the metadata name.
    """
    found = kept_entries(rows, key)
    books = _books(found, key)
    items = books.select(key, "base", F.col("p.cover").alias("named"), F.posexplode("p.manifest").alias("pos", "i"))
    own = F.array_contains(F.split("i.properties", " "), "cover-image")
    wanted = own | (F.col("i.id") == F.col("named")) | (F.col("i.media") == "text/css")
    paths = items.where(wanted).select(key, "pos", (F.col("i.media") == "text/css").alias("sheet"), own.alias("own"), F.lower(files.normal_path(F.col("base"), F.col("i.href"))).alias("low"))
    data = found.select(key, "name", F.lower("name").alias("low"), F.when(F.lower("name").endswith(".css"), F.col("data")).alias("data"))
    hit = paths.join(data, [key, "low"]).withColumn("css", F.when(F.col("sheet"), decoded(F.col("data"))))
    facts = hit.groupBy(key).agg(
        F.min_by("name", F.when(~F.col("sheet"), F.struct(~F.col("own"), "pos"))).alias("cover"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("sheet"), F.struct("pos", "css")))), lambda x: x["css"]), "\n").alias("css"),
    )
    return books.select(key, "p.title", "p.author", "p.lang").join(facts, key, "left")


def chapters(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, ch, name, title, html): pages with content, titled by first heading, page title or number."""
    html = pages.withColumn("html", decoded_markup(F.col("data"))).drop("data")
    page = F.concat_ws("\x00", F.col(key), F.col("spine_ix").cast("string"))
    read = blocks.of_pages(html.withColumn("_page", page), "_page", hidden=markup.DROPPED).where("tag != 'hr'")
    heads = read.groupBy("_page").agg(F.min_by(T.collapse(F.col("body")), F.when(F.col("tag").rlike("^h[1-6]$"), F.col("pos"))).alias("head"))
    joined = markup.titles(html.withColumn("_page", page)).withColumnRenamed("title", "page_title").join(heads, "_page")
    ch = F.row_number().over(Window.partitionBy(key).orderBy("spine_ix"))
    titled = joined.withColumn("ch", ch)
    named = F.coalesce("head", F.when(F.col("page_title") != "", F.col("page_title")), F.concat(F.lit("Chapter "), F.col("ch").cast("string")))
    return titled.select(key, "ch", "name", F.left(named, F.lit(150)).alias("title"), "html")


def text_blocks(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, pos, tag, body): paragraphs of plain texts, headings as h2."""
    return structure.paragraphs(texts, key, text).select(key, F.col("para").alias("pos"), F.when(F.col("heading"), "h2").otherwise("p").alias("tag"), "body")


def markdown_blocks(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, pos, and the columns of blocks): headings, list items, rules and paragraphs of Markdown with their marks."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([markdown.blocks(t or "") for t in column.to_pylist()], pa.list_(blocks._BLOCK))

    read = texts.select(key, F.posexplode(F.arrow_udf(run, f"array<{blocks.BLOCK}>")(F.col(text))).alias("pos", "b"))
    return read.select(key, "pos", *[F.col(f"b.{c}").alias(c) for c in blocks.COLUMNS])


def html_blocks(pages: DataFrame, key: str = "path", page: str = "html") -> DataFrame:
    """(key, pos, and the columns of blocks): all text of pages outside scripts, styles and heads, see blocks.of_pages."""
    return blocks.of_pages(pages, key, page)


def any_blocks(documents: DataFrame) -> DataFrame:
    """(path, ch, chapter, pos, and the columns of blocks): files of any readable kind as titled chapters.

    documents: path, name, ext, kind, content. Elements that plain markup has not are not read. Pages of a book are
    its chapters; other files have one for each heading of the highest level that recurs, see structure.promoted.
    A picture is named by its source: an entry of the package, a path beside the file, or data.
    """
    of = lambda kind: documents.where(F.col("kind") == kind)
    texts = of("txt").select("path", "ext", decoded(F.col("content")).alias("text"))
    pages = chapters(spine(entries(of("epub"))))
    part = F.concat_ws("\x00", "path", F.col("ch").cast("string"))
    book = blocks.of_pages(pages.withColumn("part", part), "part", hidden=markup.DROPPED, keep=("path", "ch", "title", "name"))
    base = F.regexp_replace("name", "/?[^/]*$", "")
    inside = lambda source: F.when(source.startswith("data:"), source).otherwise(files.normal_path(base, source))
    book = renamed_pictures(book, inside).drop("part", "name").withColumnRenamed("title", "chapter")
    named = documents.select("path", F.regexp_replace("name", r"\.[^./]+$", "").alias("stem"))
    kept = lambda f: f.select("path", F.col("pos").cast("int").alias("pos"), *blocks.COLUMNS)
    plain = kept(blocks.whole(text_blocks(texts.where("ext != '.md'").drop("ext")))).unionByName(kept(markdown_blocks(texts.where("ext = '.md'").drop("ext"))))
    plain = structure.promoted(plain.join(named, "path"), "path", F.col("stem"), F.lit("Part"))
    html = of("html").select("path", decoded_markup(F.col("content")).alias("html"))
    html_title = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("stem"))
    html = markup.titles(html).join(named, "path").withColumn("stem", html_title)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    beside = lambda source: F.when(source.rlike("^(?:data:|https?://)"), source).otherwise(F.concat_ws("/", folder, files.normal_path(F.lit(""), source)))
    pages = renamed_pictures(blocks.of_pages(html, "path", hidden=markup.DROPPED, keep=("stem",)), beside)
    packed = kept_entries(entries(of("docx")))
    word = docx_blocks(packed).join(named.join(parts.core_facts(packed), "path", "left").select("path", F.coalesce("title", "stem").alias("stem")), "path")
    found = [plain, *(structure.promoted(f, "path", F.col("stem"), F.col("stem")) for f in (pages, word)), book]
    return reduce(lambda a, b: a.unionByName(b), [f.select("path", "ch", "chapter", F.col("pos").cast("long").alias("pos"), *blocks.COLUMNS) for f in found])


def renamed_pictures(rows: DataFrame, name) -> DataFrame:
    """Blocks with the sources of their pictures changed by a column function; a null source takes the picture out."""
    changed = F.transform("marks", lambda m: m.withField("value", F.when(m["mark"] == "img", name(m["value"])).otherwise(m["value"])))
    changed = F.filter(changed, lambda m: (m["mark"] != "img") | m["value"].isNotNull())
    body = F.when(F.col("tag") == "img", name(F.col("body"))).otherwise(F.col("body"))
    return rows.withColumns({"marks": changed, "body": body}).where("body IS NOT NULL")


def pictures(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, source, name, media, data): the pictures that blocks of documents show, named by first use.

    Equal pictures have one name. A picture of an unknown type, of fewer than 64 bytes or without data is none.
    documents: path, kind, content of all files, among them pictures beside pages (of less than 20 MiB).
    """
    single = rows.where("tag = 'img'").select("path", "ch", "pos", F.lit(0).alias("at"), F.col("body").alias("source"))
    inline = rows.select("path", "ch", "pos", F.explode(F.filter("marks", lambda m: m["mark"] == "img")).alias("m")).select("path", "ch", "pos", F.col("m.at").alias("at"), F.col("m.value").alias("source"))
    used = single.unionByName(inline).groupBy("path", "source").agg(F.min(F.struct("ch", "pos", "at")).alias("first"))
    packed = kept_entries(entries(documents.where("kind IN ('epub', 'docx')"))).select("path", F.lower("name").alias("low"), "data")
    beside = documents.where("kind IS NULL AND octet_length(content) < 20971520").select(F.lower("path").alias("low"), F.col("content").alias("data"))
    data = F.col("source").startswith("data:")
    found = [
        used.where(data).withColumn("data", files.data_of_uri(F.col("source"))),
        used.where(~data).withColumn("low", F.lower("source")).join(packed, ["path", "low"]).drop("low"),
        used.where(~data).withColumn("low", F.lower("source")).join(beside, "low").drop("low"),
    ]
    held = reduce(lambda a, b: a.unionByName(b.select(a.columns)), found)
    kind = files.image_type(F.col("data"), F.when(data, "").otherwise(files.extension(F.col("source"))))
    held = held.withColumn("type", kind).where("octet_length(data) >= 64 AND type.ext != '.bin'").withColumn("sha1", F.sha1("data"))
    names = structure.image_names(held, "path", ["first"], "data").select("path", "sha1", F.col("name").alias("stem"))
    return held.join(names, ["path", "sha1"]).select("path", "source", F.concat("stem", "type.ext").alias("name"), F.col("type.mime").alias("media"), "data")
