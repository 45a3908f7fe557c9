"""Block tables (key, pos, tag, body, marks ...) as finished documents: text, HTML, EPUB and Word packages, one in a row.

Blocks may have chapters (ch, chapter); without them structure.promoted makes them. images: (key, name, media, data)
and, if blocks name pictures otherwise, source; a picture that images lack is left out. Without images a picture's
name stands where it would be.
"""

from __future__ import annotations

import base64
import io
import re
import zipfile
from html import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import files
from vellum.functions.pieces import over
from vellum.operators import structure
from vellum.operators.blocks import BLOCK, COLUMNS, cells, nested, tables, tree_markup, whole

BASE_CSS = "body{max-width:40em;margin:auto}img{max-width:100%}"
PICTURES = "array<struct<source:string,name:string,media:string,data:binary>>"


def gathered(blocks: DataFrame, titles: DataFrame, key: str, images: DataFrame | None) -> DataFrame:
    """(key, title, author, lang, css, cover, chapters, images): a document's chapters and pictures in its row.

    titles: key, title, author, and optionally lang, css and cover (the name of an image).
    """
    for c in ("lang", "css", "cover"):
        titles = titles if c in titles.columns else titles.withColumn(c, F.lit(None).cast("string"))
    blocks = whole(blocks)
    if "ch" not in blocks.columns:
        named = titles.select(key, F.coalesce("title", F.lit("")).alias("_doc_title"))
        blocks = structure.promoted(blocks.join(named, key, "left"), key, F.col("_doc_title"), F.lit("Chapter")).drop("_doc_title")
    each = blocks.groupBy(key, "ch", "chapter").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*COLUMNS).cast(BLOCK).alias("b")))).alias("b"))
    one = F.struct("ch", "chapter", F.transform("b", lambda x: x["b"]).alias("blocks"))
    books = titles.select(key, "title", "author", "lang", "css", "cover").join(each.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("chapters")), key, "left")
    if images is None:
        return books.withColumn("images", F.lit(None).cast(PICTURES))
    source = F.col("source") if "source" in images.columns else F.col("name")
    shown = blocks.where("tag = 'img'").select(key, F.col("body").alias("source"))
    shown = shown.unionAll(blocks.select(key, F.explode(F.filter("marks", lambda m: m["mark"] == "img")).alias("m")).select(key, "m.value"))
    images = images.select(key, source.alias("source"), "name", "media", "data").dropDuplicates([key, "source"])
    covers = books.where("cover IS NOT NULL").select(key, F.col("cover").alias("name"))
    used = images.join(shown, [key, "source"], "left_semi").unionByName(images.join(covers, [key, "name"], "left_semi").select(images.columns)).dropDuplicates([key, "source"])
    return books.join(used.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("source", "name", "media", "data"))).alias("images")), key, "left")


def _built(books: DataFrame, key: str, name: str, kind: str, make) -> DataFrame:
    """(key, name): what make makes of each document's row."""
    columns = ("title", "author", "lang", "css", "cover", "chapters", "images")
    types = {"string": pa.string(), "binary": pa.binary()}

    def run(*parts: list) -> list:
        return [make(dict(zip(columns, row))) for row in zip(*parts)]

    return books.select(key, F.arrow_udf(over(run, types[kind]), kind)(*columns).alias(name))


def piece() -> Column:
    """Markup of each block by itself, from the columns of blocks."""

    def run(*parts: list) -> list:
        return [tree_markup([dict(zip(COLUMNS, row))]) for row in zip(*parts)]

    return F.arrow_udf(over(run, pa.string()), "string")(*COLUMNS)


def _collapsed(text: str) -> str:
    return " ".join(text.split())


def text_lines(rows: list[dict]) -> list[str]:
    """Blocks as lines, a blank one behind each but list items: h1 in capitals, bullets, rows of cells after bars."""
    out: list[str] = []
    for r, table in tables(rows):
        if table is not None:
            for line in cells(table):
                filled = ["" if not held else " ".join(_collapsed(b["body"]) for b in held if b["tag"] != "img") for _, _, held in line]
                out += [" ".join(f"| {c}".rstrip() for c in filled), ""] if any(filled) else []
        elif r["tag"] == "hr":
            out += ["* * *", ""]
        elif r["tag"] == "li":
            out.append(f"• {_collapsed(r['body'])}")
        elif r["tag"] != "img":
            text = _collapsed(r["body"])
            out += [text.upper() if r["tag"] == "h1" else text, ""]
    while out and not out[-1]:
        out.pop()
    return out


def _text(doc: dict) -> str:
    """Title and author, then chapters, each underlined unless its text begins with its title."""
    rule = lambda title, sign: sign * min(len(title), 60)
    lines = [doc["title"], rule(doc["title"], "="), ""] if doc["title"] else []
    lines += [doc["author"], ""] if doc["author"] else []
    for c in doc["chapters"] or []:
        body, title = text_lines(c["blocks"]), c["chapter"]
        if title and (not body or body[0].strip().lower() != title.strip().lower()):
            lines += ["", title, rule(title, "-"), ""]
        elif lines:
            lines.append("")
        lines += body
    return "\n".join(lines).strip() + "\n"


def as_text(blocks: DataFrame, titles: DataFrame, key: str = "path") -> DataFrame:
    """(key, text): documents as plain text, see _text and text_lines. Pictures are left out."""
    return _built(gathered(blocks, titles, key, None), key, "text", "string", _text)


def _html(doc: dict) -> str:
    held = {i["source"]: i for i in doc["images"] or []}

    def address(i: dict) -> str:
        return f"data:{i['media']};base64,{base64.b64encode(i['data']).decode()}"

    def picture(source: str) -> str:
        if doc["images"] is None:
            return f'<img src="images/{escape(source)}" alt=""/>'
        return f'<img src="{address(held[source])}" alt=""/>' if source in held else ""

    title, cover = doc["title"] or "", next((i for i in held.values() if i["name"] == doc["cover"]), None)
    out = [f'<!DOCTYPE html>\n<html lang="{escape(doc["lang"] or "en")}">\n<head>\n<meta charset="utf-8"/>\n<title>{escape(title)}</title>\n']
    out.append(f'<meta name="viewport" content="width=device-width, initial-scale=1"/>\n<style>{BASE_CSS}\n{doc["css"] or ""}</style>\n</head>\n<body>\n')
    out.append(f'<div class="cover"><img src="{address(cover)}" alt="cover"/></div>\n' if cover else "")
    out += [f'<div class="chapter" id="ch{n}">{tree_markup(c["blocks"], picture)}</div>\n' for n, c in enumerate(doc["chapters"] or [], 1)]
    return "".join([*out, "</body>\n</html>\n"])


def as_html(blocks: DataFrame, titles: DataFrame, key: str = "path", images: DataFrame | None = None) -> DataFrame:
    """(key, html): one page for each document with its pictures inside and its own styles, made safe; chapters are ch1 on."""
    books = gathered(blocks, titles, key, images).withColumn("css", files.safe_css(F.col("css")))
    return _built(books, key, "html", "string", _html)


def as_epub(blocks: DataFrame, titles: DataFrame, key: str = "path", images: DataFrame | None = None) -> DataFrame:
    """(key, content): EPUB packages with a page for each chapter; the media type comes first and unpacked.

    Of images those that blocks or the cover name are written, by name; a cover without image is none.
    """
    return _built(gathered(blocks, titles, key, images).where("chapters IS NOT NULL"), key, "content", "binary", epub)


def epub(doc: dict) -> bytes:
    """A package of one document's row, see gathered."""
    held = {i["source"]: i["name"] for i in doc["images"] or []}

    def picture(source: str) -> str:
        name = held.get(source) if doc["images"] is not None else source
        return f'<img src="images/{escape(name)}" alt=""/>' if name else ""

    pages = [{"group": n, "title": c["chapter"] or f"Chapter {n}", "body": tree_markup(c["blocks"], picture)} for n, c in enumerate(doc["chapters"], 1)]
    named = {i["name"]: i for i in doc["images"] or []}
    return _epub(doc["title"], doc["author"], pages, doc["css"], doc["cover"], [named[n] for n in sorted(named)], doc["lang"])


def _epub(title: str | None, author: str | None, pages: list[dict], css: str | None, cover: str | None, images: list[dict], lang: str | None = None) -> bytes:
    from xml.sax.saxutils import escape, quoteattr

    title = title or ""
    cover_id = next((f"img{n}" for n, i in enumerate(images) if i["name"] == cover), None)
    names = [f"ch{p['group']}" for p in pages]
    item = lambda ident, href, media, more="": f'<item id="{ident}" href={quoteattr(href)} media-type={quoteattr(media)}{more}/>'
    items = [item("nav", "nav.xhtml", "application/xhtml+xml", ' properties="nav"'), item("ncx", "toc.ncx", "application/x-dtbncx+xml")]
    items += [item("css", "style.css", "text/css")] if css else []
    items += [item(f"img{n}", f"images/{i['name']}", i["media"], ' properties="cover-image"' if f"img{n}" == cover_id else "") for n, i in enumerate(images)]
    items += [item(n, f"{n}.xhtml", "application/xhtml+xml") for n in names]
    meta = f'<dc:title>{escape(title)}</dc:title><dc:language>{escape(lang or 'en')}</dc:language><dc:identifier id="id">{escape(title or "book")}</dc:identifier>'
    meta += f"<dc:creator>{escape(author)}</dc:creator>" if author else ""
    meta += f'<meta name="cover" content="{cover_id}"/>' if cover_id else ""
    refs = "".join(f'<itemref idref="{n}"/>' for n in names)
    links = "".join(f'<li><a href="{n}.xhtml">{escape(p["title"])}</a></li>' for n, p in zip(names, pages))
    points = "".join(f'<navPoint id="{n}" playOrder="{i}"><navLabel><text>{escape(p["title"])}</text></navLabel><content src="{n}.xhtml"/></navPoint>' for i, (n, p) in enumerate(zip(names, pages), 1))
    xml = '<?xml version="1.0" encoding="utf-8"?>'
    page = xml + '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{}</title>{}</head><body>{}</body></html>'
    style = '<link rel="stylesheet" type="text/css" href="style.css"/>' if css else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", f'{xml}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest>{"".join(items)}</manifest><spine toc="ncx">{refs}</spine></package>')
        z.writestr("OEBPS/nav.xhtml", page.format("Contents", "", f'<nav epub:type="toc"><ol>{links}</ol></nav>'))
        z.writestr("OEBPS/toc.ncx", f'{xml}<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content={quoteattr(title or "book")}/></head><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>')
        if css:
            z.writestr("OEBPS/style.css", css)
        for n, p in zip(names, pages):
            z.writestr(f"OEBPS/{n}.xhtml", page.format(escape(p["title"]), style, p["body"]))
        for i in images:
            z.writestr(f"OEBPS/images/{i['name']}", i["data"], zipfile.ZIP_STORED)
    return out.getvalue()


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


#: Characters that XML has not.
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
#: Largest width of a picture, in 914400ths of an inch.
MAX_WIDTH = 5_486_400
#: Run properties of marks, in the order that the format wants.
_RUN = {"code": '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>', "b": "<w:b/>", "i": "<w:i/>", "s": "<w:strike/>", "u": '<w:u w:val="single"/>', "sup": '<w:vertAlign w:val="superscript"/>', "sub": '<w:vertAlign w:val="subscript"/>'}


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height of a PNG, GIF, BMP or JPEG in pixels; a square if they are not found."""
    if data[:4] == b"\x89PNG" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"GIF8" and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM" and len(data) >= 26:
        return int.from_bytes(data[18:22], "little", signed=True), abs(int.from_bytes(data[22:26], "little", signed=True))
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        if data[at + 1] in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 300, 300


class _Word:
    """The body of a Word package, part by part."""

    def __init__(self, images: dict[str, dict] | None):
        self.images, self.out, self.shown = images, [], {}

    def _picture(self, source: str) -> str:
        """A run with a picture; drawings in SVG are left out."""
        image = (self.images or {}).get(source)
        if image is None or image["media"] == "image/svg+xml":
            return ""
        ident = self.shown.setdefault(image["name"], (len(self.shown) + 10, image))[0]
        width, height = (max(1, n) for n in image_size(image["data"]))
        wide = min(width * 9525, MAX_WIDTH)
        size = f'cx="{wide}" cy="{max(1, wide * height // width)}"'
        return (
            f'<w:r><w:drawing><wp:inline distT="0" distB="0" distL="0" distR="0"><wp:extent {size}/><wp:docPr id="{ident}" name="{escape(image["name"])}"/>'
            f'<a:graphic><a:graphicData uri="{_DRAWING}/picture"><pic:pic><pic:nvPicPr><pic:cNvPr id="{ident}" name="{escape(image["name"])}"/><pic:cNvPicPr/></pic:nvPicPr>'
            f'<pic:blipFill><a:blip r:embed="rId{ident}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
            f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
        )

    def _runs(self, body: str, marks: list[dict] | None, always: tuple = ()) -> str:
        out = []
        for start, stop, own in nested(marks or [], len(body)):
            if start == stop:
                out.append(self._picture(own[-1][1]))
                continue
            names = {m for m, _ in own} | set(always)
            how = "".join(x for n, x in _RUN.items() if n in names)
            pieces = []
            for line in _NOT_XML.sub("", body[start:stop]).split("\n"):
                pieces.append("<w:br/>" if pieces else "")
                for k, text in enumerate(line.split("\u2003")):
                    pieces.append("<w:tab/>" if k else "")
                    pieces.append(f'<w:t xml:space="preserve">{escape(text)}</w:t>' if text else "")
            out.append(f"<w:r>{f'<w:rPr>{how}</w:rPr>' if how else ''}{''.join(pieces)}</w:r>")
        return "".join(out)

    def paragraph(self, style: str, runs: str, more: str = "") -> None:
        self.out.append(f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{more}</w:pPr>{runs}</w:p>')

    def line(self, style: str, text: str) -> None:
        self.paragraph(style, self._runs(text, None))

    def block(self, r: dict, more: str = "", bold: bool = False) -> None:
        tag = r["tag"]
        if tag == "img":
            shown = self._picture(r["body"])
            if shown:
                self.paragraph("Picture", shown, more)
            return
        body, always = ("* * *" if tag == "hr" else r["body"] or ""), ("code",) if tag == "pre" else ("b",) if bold else ()
        style = f"Heading{tag[1]}" if re.fullmatch("h[1-6]", tag) else "Break" if tag == "hr" else "Code" if tag == "pre" else "Normal"
        if tag == "li":
            style = "ListBullet" if r["number"] is None else "ListNumber"
            level = min(max(r["depth"] or 1, 1), 9) - 1
            more += f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{1 if r["number"] is None else 2}"/></w:numPr>'
        elif r["quote"]:
            style = "Quote"
        self.paragraph(style, self._runs(body, r["marks"], always), more)

    def table(self, rows: list[dict]) -> None:
        lines = cells(rows)
        columns = max(line[-1][0] + line[-1][1] for line in lines)
        self.out.append('<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/><w:tblW w:w="0" w:type="auto"/></w:tblPr><w:tblGrid>' + "<w:gridCol/>" * columns + "</w:tblGrid>")
        for line in lines:
            self.out.append("<w:tr>")
            end = line[-1][0] + line[-1][1]
            for _, span, held in [*line, *([(end, columns - end, [])] if end < columns else [])]:
                self.out.append(f'<w:tc><w:tcPr>{f"<w:gridSpan w:val={chr(34)}{span}{chr(34)}/>" if span > 1 else ""}</w:tcPr>')
                for r in held:
                    self.block(r | {"quote": 0}, bold=r["tag"] == "th")
                if not held or not self.out[-1].startswith("<w:p>"):
                    self.paragraph("Normal", "")
                self.out.append("</w:tc>")
            self.out.append("</w:tr>")
        self.out.append("</w:tbl>")
        self.paragraph("Normal", "")


def word(doc: dict) -> bytes:
    """A Word package of one document's row, see gathered: title, author, cover, then chapters, each on a new page."""
    held = {i["source"]: i for i in doc["images"] or []}
    body = _Word(held)
    if doc["title"]:
        body.line("Title", doc["title"])
    if doc["author"]:
        body.line("Author", doc["author"])
    cover = next((s for s, i in held.items() if i["name"] == doc["cover"]), None)
    if cover:
        body.block({"tag": "img", "body": cover})
    for n, chapter in enumerate(doc["chapters"] or []):
        opens = "<w:pageBreakBefore/>" if n or doc["title"] or cover else ""
        for k, (r, table) in enumerate(tables(chapter["blocks"])):
            if table is None:
                body.block(r, "" if k else opens)
            else:
                if opens and not k:
                    body.paragraph("Normal", "", opens)
                body.table(table)
    return _word(doc["title"], doc["author"], "".join(body.out), list(body.shown.values()))


def as_word(blocks: DataFrame, titles: DataFrame, key: str = "path", images: DataFrame | None = None) -> DataFrame:
    """(key, content): Word packages with run formats, nested lists, tables and the pictures that images have."""
    return _built(gathered(blocks, titles, key, images), key, "content", "binary", word)


def _style(ident: str, name: str, paragraph: str = "", run: str = "", based: str = '<w:basedOn w:val="Normal"/>') -> str:
    return f'<w:style w:type="paragraph" w:styleId="{ident}"><w:name w:val="{name}"/>{based}<w:pPr>{paragraph}</w:pPr><w:rPr>{run}</w:rPr></w:style>'


def _styles() -> str:
    centred = '<w:jc w:val="center"/>'
    out = ['<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>']
    out += [_style(f"Heading{n}", f"heading {n}", f'<w:keepNext/><w:outlineLvl w:val="{n - 1}"/>', f'<w:b/><w:sz w:val="{36 - 2 * n}"/>') for n in range(1, 7)]
    out += [_style(n, n, centred, f'<w:sz w:val="{size}"/>') for n, size in (("Title", 48), ("Author", 24), ("Break", 22), ("Picture", 22))]
    out += [_style("ListBullet", "List Bullet"), _style("ListNumber", "List Number"), _style("Quote", "Quote", '<w:ind w:left="720"/>'), _style("Code", "Code", "", '<w:sz w:val="18"/>')]
    edges = "".join(f'<w:{side} w:val="single" w:sz="4"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
    out.append(f'<w:style w:type="table" w:styleId="TableGrid"><w:name w:val="Table Grid"/><w:tblPr><w:tblBorders>{edges}</w:tblBorders></w:tblPr></w:style>')
    return f'<w:styles xmlns:w="{_WORD}">{"".join(out)}</w:styles>'


def _numbering() -> str:
    def levels(kind: str, text) -> str:
        one = '<w:lvl w:ilvl="{0}"><w:start w:val="1"/><w:numFmt w:val="{1}"/><w:lvlText w:val="{2}"/><w:pPr><w:ind w:left="{3}" w:hanging="360"/></w:pPr></w:lvl>'
        return "".join(one.format(n, kind, text(n), 720 * (n + 1)) for n in range(9))

    kinds = (("bullet", lambda n: "•"), ("decimal", lambda n: f"%{n + 1}."))
    lists = "".join(f'<w:abstractNum w:abstractNumId="{k}">{levels(*kind)}</w:abstractNum>' for k, kind in enumerate(kinds))
    return f'<w:numbering xmlns:w="{_WORD}">{lists}' + "".join(f'<w:num w:numId="{k + 1}"><w:abstractNumId w:val="{k}"/></w:num>' for k in range(2)) + "</w:numbering>"


def _word(title: str | None, author: str | None, body: str, images: list[tuple[int, dict]]) -> bytes:
    override = "".join(f'<Override PartName="/{name}" ContentType="{kind}+xml"/>' for name, kind in (
        ("word/document.xml", f"{_KIND}.document.main"), ("word/styles.xml", f"{_KIND}.styles"), ("word/numbering.xml", f"{_KIND}.numbering"),
        ("docProps/core.xml", "application/vnd.openxmlformats-package.core-properties"),
    ))
    media = {i["name"].rsplit(".", 1)[-1]: i["media"] for _, i in images}
    defaults = "".join(f'<Default Extension="{e}" ContentType="{m}"/>' for e, m in {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml", **media}.items())
    relation = '<Relationship Id="{}" Type="{}" Target="{}"/>'
    relations = lambda rows: f'<Relationships xmlns="{_PACK}/relationships">{"".join(relation.format(*r) for r in rows)}</Relationships>'
    space = f'xmlns:w="{_WORD}" xmlns:r="{_OFFICE}" xmlns:wp="{_DRAWING}/wordprocessingDrawing" xmlns:a="{_DRAWING}/main" xmlns:pic="{_DRAWING}/picture"'
    page = '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440" w:header="720" w:footer="720" w:gutter="0"/></w:sectPr>'
    facts = f"<dc:title>{escape(_NOT_XML.sub('', title or ''))}</dc:title><dc:creator>{escape(_NOT_XML.sub('', author or ''))}</dc:creator>"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACK}/content-types">{defaults}{override}</Types>',
        "_rels/.rels": relations([("rId1", f"{_OFFICE}/officeDocument", "word/document.xml"), ("rId2", f"{_PACK}/relationships/metadata/core-properties", "docProps/core.xml")]),
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="{_PACK}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">{facts}</cp:coreProperties>',
        "word/_rels/document.xml.rels": relations([("rId1", f"{_OFFICE}/styles", "styles.xml"), ("rId2", f"{_OFFICE}/numbering", "numbering.xml"), *((f"rId{n}", f"{_OFFICE}/image", f"media/{escape(i['name'])}") for n, i in images)]),
        "word/styles.xml": _styles(),
        "word/numbering.xml": _numbering(),
        "word/document.xml": f"<w:document {space}><w:body>{body}{page}</w:body></w:document>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts.items():
            z.writestr(name, _XML + part)
        for _, i in images:
            z.writestr(f"word/media/{i['name']}", i["data"], zipfile.ZIP_STORED)
    return out.getvalue()


def save(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Writes each row's content as a file in the folder and returns (name, bytes); run by the action on it.

    A repeated task writes the same file again.
    """

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names, data = (batch.column(i).to_pylist() for i in (0, 1))
            for n, d in zip(names, data):
                with store.open_output_stream(f"{root}/{n}") as out:
                    out.write(d.encode() if isinstance(d, str) else d)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(d) for d in data], pa.int64())], names=["name", "bytes"])

    return df.select(name, content).mapInArrow(run, "name string, bytes long")
