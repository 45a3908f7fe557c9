"""Word packages changed in place and split.

Edits replace byte spans of the XML parts, so that prefixes, declarations and all that is not edited stay as they were.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.config import MIN_SPLIT_BYTES
from vellum.functions import files
from vellum.functions import text as T
from vellum.operators import packing, translate
from vellum.sources import packages, rewrite

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main "
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships "
_SPACE = "http://www.w3.org/XML/1998/namespace space"
#: Parts with text, and what parts the texts of a paragraph.
TEXT_PARTS = r"^word/(?:document|header[0-9]*|footer[0-9]*|footnotes|endnotes)\.xml$"
BREAKS = (f"{_W}tab", f"{_W}br", f"{_W}cr")
MAIN, LINKS = "word/document.xml", "word/_rels/document.xml.rels"


def text_groups(data: bytes | None) -> list[list[dict]]:
    """Texts that belong together: the runs of a paragraph between tabs and breaks, by their spans of bytes.

    A text box is a paragraph of its own. Parts that are not well-formed UTF-8 XML have no groups.
    """
    found, paragraphs, text = [], [], None
    p = expat.ParserCreate(namespace_separator=" ")

    def start(name, attrs):
        nonlocal text
        if name == f"{_W}p":
            paragraphs.append([])
        elif name == f"{_W}t" and paragraphs:
            text = {"start": -1, "kept": _SPACE in attrs, "body": ""}
        elif name in BREAKS and paragraphs and paragraphs[-1]:
            found.append(paragraphs[-1])
            paragraphs[-1] = []

    def chars(piece):
        if text is not None:
            text["start"] = p.CurrentByteIndex if text["start"] < 0 else text["start"]
            text["body"] += piece

    def end(name):
        nonlocal text
        if name == f"{_W}p":
            found.extend([group] if (group := paragraphs.pop()) else [])
        elif name == f"{_W}t" and text is not None:
            if text["body"]:
                paragraphs[-1].append({**text, "stop": p.CurrentByteIndex})
            text = None

    p.StartElementHandler, p.CharacterDataHandler, p.EndElementHandler = start, chars, end
    return found if _parsed(p, data) else []


def _parsed(p, data: bytes | None) -> bool:
    if not data or data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return False
    try:
        p.Parse(data, True)
    except expat.ExpatError:
        return False
    return True


def with_texts(data: bytes, new: dict[int, str]) -> bytes:
    """The part with new texts of some groups: each stands in the first run of its group, the others become empty."""
    edits = []
    for i, group in enumerate(text_groups(data)):
        for n, t in enumerate(group if i in new else ()):
            body = escape(new[i]).encode() if n == 0 else b""
            if n == 0 and not t["kept"] and data[t["start"] - 1 : t["start"]] == b">":
                edits.append((t["start"] - 1, t["start"], b' xml:space="preserve">'))
            edits.append((t["start"], t["stop"], body))
    out, at = [], 0
    for start, stop, body in sorted(edits):
        out += [data[at:start], body]
        at = stop
    return b"".join([*out, data[at:]])


def translated_words(packed: DataFrame, provider, key: str = "path", content: str = "content") -> DataFrame:
    """(key, content): Word packages with the texts of the document, headers, footers and notes translated in place.

    A group keeps the format of its first run and the white space around it. Distinct texts are translated once; what
    the provider gives back untranslated stays, and so does what is no Word package.
    """
    bodies = F.arrow_udf(lambda c: pa.array([["".join(t["body"] for t in g) for g in text_groups(v)] for v in c.to_pylist()], pa.list_(pa.string())), "array<string>")
    parts = packages.kept_entries(packages.entries(packed, key, content), key).where(F.col("name").rlike(TEXT_PARTS)).select(key, "name", "data")
    texts = parts.select(key, "name", F.posexplode(bodies("data")).alias("pos", "raw")).where(T.translatable(F.col("raw"))).withColumn("body", T.trim(F.col("raw")))
    found = translate.finished(texts.select("body").distinct(), provider).where("translated IS NOT NULL").select("body", "translated")
    new = F.concat(T.lead(F.col("raw")), F.col("translated"), T.trail(F.col("raw")))
    done = texts.join(found, "body").groupBy(key, "name").agg(F.collect_list(F.struct("pos", new.alias("new"))).alias("_new"))

    def run(data: pa.Array, new: pa.Array) -> pa.Array:
        return pa.array([with_texts(d, {e["pos"]: e["new"] for e in n}) for d, n in zip(data.to_pylist(), new.to_pylist())], pa.binary())

    edited = parts.join(done, [key, "name"]).select(key, "name", F.arrow_udf(run, "binary")("data", "_new").alias("data"))
    return rewrite.rebuilt(packed, edited, key, content)


def _children(data: bytes | None, parent: str) -> tuple[list[dict], int] | None:
    """Children of the first element of that local name (start, stop, name, attrs, ids: relationships inside), its end."""
    found, depth, inside, ended = [], 0, 0, -1
    p = expat.ParserCreate(namespace_separator=" ")

    def start(name, attrs):
        nonlocal depth, inside
        depth += 1
        if not inside and name.rsplit(" ", 1)[-1] == parent:
            inside = depth
        elif inside and ended < 0:
            if depth == inside + 1:
                found.append({"start": p.CurrentByteIndex, "name": name.rsplit(" ", 1)[-1], "attrs": attrs, "ids": set()})
            found[-1]["ids"].update(v for k, v in attrs.items() if k.startswith(_R))

    def end(name):
        nonlocal depth, ended
        if depth == inside and ended < 0:
            ended = p.CurrentByteIndex
        depth -= 1

    p.StartElementHandler, p.EndElementHandler = start, end
    if not _parsed(p, data) or ended < 0:
        return None
    for child, after in zip(found, [*(c["start"] for c in found[1:]), ended]):
        child["stop"] = after
    return found, ended


def _target(relation: dict) -> str:
    to = relation.get("Target", "")
    return to.lstrip("/") if to.startswith("/") else posixpath.normpath(posixpath.join("word", to))


def _is_image(relation: dict) -> bool:
    return "/image" in relation.get("Type", "") and relation.get("TargetMode") != "External"


def cut_words(content: bytes, limit: int):
    """Packages of at most limit bytes, unless they hold one block of the body, in order; each is built as it is taken.

    Every part keeps the section properties, styles and other files; pictures that it does not use go with their links,
    unless headers, footers or notes use them.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > packages.MAX_BYTES:
            raise ValueError("package is too large")
        infos = {i.filename: i for i in z.infolist() if not i.is_dir()}
        if MAIN not in infos or (read := _children(data := z.read(MAIN), "body")) is None:
            raise ValueError("not a Word package")
        blocks, ended = read
        links = z.read(LINKS) if LINKS in infos else b""
        relations = (_children(links, "Relationships") or ([], 0))[0]
        others = [r["attrs"] for n in infos if n.startswith("word/_rels/") and n != LINKS for r in (_children(z.read(n), "Relationships") or ([], 0))[0]]
    section = blocks.pop() if blocks and blocks[-1]["name"] == "sectPr" else None
    tail = data[section["start"] if section else ended :]
    images = {r["attrs"].get("Id"): _target(r["attrs"]) for r in relations if _is_image(r["attrs"])}
    shared = {_target(r) for r in others if _is_image(r)}
    media = {n: infos[n].compress_size for n in images.values() if n in infos}
    used = [{images[i] for i in b["ids"] if i in images} for b in blocks]
    sizes = [(b["stop"] - b["start"]) // 4 + 40 + sum(media.get(n, 0) for n in u) for b, u in zip(blocks, used)]
    overhead = sum(i.compress_size for n, i in infos.items() if n != MAIN and n not in media) + 2048

    def build(start: int, stop: int) -> bytes:
        kept = shared.union(*used[start:stop])
        changed: dict[str, bytes | None] = {n: None for n in images.values() if n not in kept}
        if changed:
            gone = [(r["start"], r["stop"]) for r in relations if _is_image(r["attrs"]) and _target(r["attrs"]) in changed]
            edges = [0, *(x for span in gone for x in span), len(links)]
            changed[LINKS] = b"".join(links[a:b] for a, b in zip(edges[::2], edges[1::2]))
        changed[MAIN] = data[: blocks[0]["start"]] + data[blocks[start]["start"] : blocks[stop - 1]["stop"]] + tail
        return rewrite.rezipped(content, changed)

    spans = packing.packed(sizes, limit, overhead, lambda a, b: len(build(a, b)))
    return len(spans), (build(a, b) for a, b in spans)


def split_words(packed: DataFrame, limit: int, key: str = "path", name: str = "name", content: str = "content", least: int = MIN_SPLIT_BYTES) -> DataFrame:
    """(key, part, parts, part_name, content, size, error): Word packages in parts of at most limit bytes.

    Packages that fit stay byte for byte. One that cannot be read is a whole part with an error; a part of one block
    may be larger than the limit, which its error tells. A null package has no parts. Parts are sent on one by one.
    """
    if limit < least:
        raise ValueError(f"a part has {least} bytes at least")

    def run(frames):
        for frame in frames:
            for k, n, data in zip(frame[key], frame[name], frame[content]):
                if data is None:
                    continue
                count, parts, error = 1, iter([data]), None
                if len(data) > limit:
                    try:
                        count, parts = cut_words(data, limit)
                        count, parts = (count, parts) if count > 1 else (1, iter([data]))
                    except (zipfile.BadZipFile, ValueError, RuntimeError, OSError) as e:
                        error = str(e)
                for i, part in enumerate(parts, 1):
                    yield pd.DataFrame([(k, n, i, count, part, len(part), error)], columns=[key, name, "part", "parts", "content", "size", "error"])

    rows = packed.select(key, name, content).mapInPandas(run, f"{key} string, {name} string, part int, parts int, content binary, size long, error string")
    error = F.coalesce("error", packing.split_error(F.col("size"), F.col("parts"), limit))
    return rows.select(key, "part", "parts", files.part_name(F.col(name), F.col("part"), F.col("parts")).alias("part_name"), "content", "size", error.alias("error"))
