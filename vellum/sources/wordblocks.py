"""Word packages as blocks: paragraphs with their run formats, headings and lists by style, tables by their grid."""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import blocks
from vellum.sources import parts

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_V = "{urn:schemas-microsoft-com:vml}"
#: Elements whose runs belong to the paragraph, and those that stand around blocks.
AROUND_RUNS = frozenset("p hyperlink ins smartTag sdtContent fldSimple".split())
AROUND_BLOCKS = frozenset("sdt sdtContent customXml ins moveTo".split())
#: What marks a run, from the outside in.
FORMATS = ("b", "i", "u", "s", "code", "sub", "sup")


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _on(properties, name: str, off=("0", "false")) -> bool:
    e = properties.find(f"{_W}{name}") if properties is not None else None
    return e is not None and e.get(f"{_W}val", "") not in off


def _formats(run) -> tuple:
    p = run.find(f"{_W}rPr")
    height = p.find(f"{_W}vertAlign") if p is not None else None
    raised = {"superscript": "sup", "subscript": "sub"}.get(height.get(f"{_W}val") if height is not None else None)
    font = p.find(f"{_W}rFonts") if p is not None else None
    mono = font is not None and font.get(f"{_W}ascii") == "Courier New"
    found = {"b": _on(p, "b"), "i": _on(p, "i"), "u": _on(p, "u", ("none",)), "s": _on(p, "strike"), "code": mono, "sub": raised == "sub", "sup": raised == "sup"}
    return tuple((f, None) for f in FORMATS if found[f])


class Document:
    """rows: the blocks of word/document.xml in order. levels, listed: heading levels and list styles by style id.

    Pictures are the ids of their relationships. Tabs are em spaces, line breaks line ends; what was deleted is not
    read. A paragraph without text or picture is none.
    """

    def __init__(self, data: bytes | None, levels: dict[str, int], listed: set[str]):
        self.levels, self.listed, self.rows, self.tables = levels, listed, [], 0
        try:
            root = ElementTree.fromstring(data or b"")
        except ElementTree.ParseError:
            return
        self.parents = {child: e for e in root.iter() for child in e}
        body = root.find(f"{_W}body")
        if body is not None:
            self._walk(body, {})

    def _walk(self, around, place: dict) -> None:
        for e in around:
            name = _local(e)
            if name == "p":
                self._paragraph(e, place)
            elif name == "tbl":
                self._table(e)
            elif name in AROUND_BLOCKS:
                self._walk(e, place)

    def _table(self, table) -> None:
        number, self.tables = self.tables, self.tables + 1
        lines = [tr for tr in table.iter(f"{_W}tr") if self._above(tr, "tbl") is table]
        for row, tr in enumerate(lines):
            col = 0
            for cell in (tc for tc in tr.iter(f"{_W}tc") if self._above(tc, "tr") is tr):
                grid = cell.find(f"{_W}tcPr/{_W}gridSpan")
                said = grid.get(f"{_W}val", "1") if grid is not None else "1"
                span = max(1, int(said)) if said.isdigit() else 1
                self._walk(cell, {"table": number, "row": row, "col": col, "span": span})
                col += span

    def _above(self, e, name: str):
        while e in self.parents:
            e = self.parents[e]
            if _local(e) == name:
                return e
        return None

    def _paragraph(self, p, place: dict) -> None:
        inline = blocks.Inline()
        for run in p.iter(f"{_W}r"):
            if _local(self.parents[run]) not in AROUND_RUNS:
                continue
            marks = _formats(run)
            for e in run:
                match _local(e):
                    case "t":
                        inline.add(e.text or "", marks, kept=True)
                    case "tab":
                        inline.add("\u2003", marks, kept=True)
                    case "br" | "cr":
                        inline.add("\n", (), kept=True)
                    case "drawing" | "pict" | "object":
                        for x in e.iter():
                            if x.tag == f"{_A}blip":
                                inline.picture(x.get(f"{_R}embed") or x.get(f"{_R}link") or "")
                            elif x.tag == f"{_V}imagedata":
                                inline.picture(x.get(f"{_R}id") or "")
        body, marks = inline.done(kept=True)
        if not body.strip():
            body = ""
            if not inline.objects:
                return
        tag, depth = self._kind(p)
        cell = place.get("table") is not None
        row = {"quote": 0, "number": None, "table": None, "row": None, "col": None, "span": None, "direct": tag != "li" and not cell, "depth": depth, **place}
        tag = "td" if cell and tag == "p" else tag
        if body:
            self.rows.append({"tag": tag, "body": body, "marks": marks, **row})
        else:
            self.rows += [{"tag": "img", "body": source, "marks": [], **row, "depth": 0} for _, source in inline.objects]

    def _kind(self, p) -> tuple[str, int]:
        properties = p.find(f"{_W}pPr")
        style = properties.find(f"{_W}pStyle") if properties is not None else None
        name = style.get(f"{_W}val", "") if style is not None else ""
        level = self.levels.get(name)
        if level is None and name[-1:].isdigit() and name[:-1] in ("Heading", "heading", "Titre", "Ttulo"):
            level = int(name[-1])
        if level is None and name.lower() == "title":
            level = 1
        if level:
            return f"h{min(level, 6)}", 0
        numbered = properties.find(f"{_W}numPr") if properties is not None else None
        if numbered is not None or name in self.listed:
            deep = numbered.find(f"{_W}ilvl") if numbered is not None else None
            said = deep.get(f"{_W}val", "0") if deep is not None else "0"
            return "li", 1 + (min(int(said), 8) if said.isdigit() else 0)
        return "p", 0


def docx_blocks(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, pos, and the columns of blocks): the main text of Word packages. rows: their entries.

    Headings and list items go by the package's own styles, then by style names; cells of a table carry their place in
    the grid. A picture is named by the entry that the package's relationships give for it.
    """
    from vellum.sources.packages import kept_entries

    found = kept_entries(rows, key)
    styles = parts.word_styles(found, key).groupBy(key).agg(F.collect_list(F.struct("style", "level", "listed")).alias("styles"))

    def run(data: pa.Array, styles: pa.Array) -> pa.Array:
        out = []
        for d, own in zip(data.to_pylist(), styles.to_pylist()):
            own = own or []
            out.append(Document(d, {s["style"]: s["level"] for s in own if s["level"]}, {s["style"] for s in own if s["listed"]}).rows)
        return pa.array(out, pa.list_(blocks._BLOCK))

    main = found.where("name = 'word/document.xml'").join(styles, key, "left")
    read = main.select(key, F.posexplode(F.arrow_udf(run, f"array<{blocks.BLOCK}>")("data", "styles")).alias("pos", "b"))
    targets = parts.relations(found, key).where("part = 'word/document.xml'").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("id", "target"))).alias("targets"))
    joined = read.join(targets, key, "left")
    entry = lambda rid: F.coalesce(F.try_element_at("targets", rid), rid)
    named = F.transform("b.marks", lambda m: m.withField("value", F.when(m["mark"] == "img", entry(m["value"])).otherwise(m["value"])))
    body = F.when(F.col("b.tag") == "img", entry(F.col("b.body"))).otherwise(F.col("b.body"))
    return joined.select(key, "pos", F.col("b.tag").alias("tag"), body.alias("body"), named.alias("marks"), *[F.col(f"b.{c}").alias(c) for c in blocks.COLUMNS[3:]])
