"""Pages as blocks: headings, paragraphs, list items, table cells and quotations with their whole inline text and marks.

One pass over a page inside its row, with the end tags that markup may leave out. Each character of the page that
stands outside hidden elements is in one block; no block holds another's text, whatever is nested in what.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.pieces import replaced
from vellum.operators.markup import BLOCKS, EMPTY, ENDS, HEADINGS

#: Elements that show no text, those that a head may hold, and inline ones that mark their text.
HIDDEN = frozenset("script style head title template meta link base".split())
HEAD_ONLY = frozenset("script style title template meta link base noscript".split())
MARKS = {
    "b": "b", "strong": "b", "i": "i", "em": "i", "cite": "i", "var": "i", "dfn": "i", "u": "u", "ins": "u", "s": "s", "strike": "s", "del": "s",
    "code": "code", "kbd": "code", "samp": "code", "tt": "code", "sub": "sub", "sup": "sup", "a": "a",
}
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
SCOPE = frozenset("table td th caption".split())

MARK = "array<struct<at:int,len:int,mark:string,value:string>>"
BLOCK = f"struct<tag:string,body:string,marks:{MARK},depth:int,number:int,quote:int,table:int,row:int,col:int,span:int,direct:boolean>"
_MARK = pa.list_(pa.struct([("at", pa.int32()), ("len", pa.int32()), ("mark", pa.string()), ("value", pa.string())]))
_BLOCK = pa.struct([("tag", pa.string()), ("body", pa.string()), ("marks", _MARK), *((n, pa.int32()) for n in ("depth", "number", "quote", "table", "row", "col", "span")), ("direct", pa.bool_())])
#: Columns of a block table, besides key and pos.
COLUMNS = [f.name for f in _BLOCK]


class Inline:
    """Text that gathers with its marks; white space collapses unless it is kept."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.last = ""
        self.runs: list[tuple[int, int, tuple]] = []
        self.objects: list[tuple[int, str]] = []

    def _append(self, text: str, marks: tuple = ()) -> None:
        if text:
            self.parts.append(text)
            if marks:
                self.runs.append((self.size, self.size + len(text), marks))
            self.size += len(text)
            self.last = text[-1]

    def add(self, text: str, marks: tuple, kept: bool = False) -> None:
        if kept:
            self._append(text, marks)
            return
        text = re.sub(r"\s+", " ", text)
        self._append(text[1:] if text[:1] == " " and self.last in ("", " ", "\n") else text, marks)

    def line_end(self) -> None:
        if self.last == " ":
            self.parts[-1] = self.parts[-1][:-1]
            self.size -= 1
        self._append("\n")

    def picture(self, source: str) -> None:
        if source:
            self.objects.append((self.size, source))

    def done(self, kept: bool = False) -> tuple[str, list[dict]]:
        """The text without white space at its ends, and its marks by place; what marks nothing goes."""
        whole = "".join(self.parts)
        body = whole.strip("\r\n") if kept else whole.strip()
        first = whole.find(body) if body else 0
        spans: list[list] = []
        open_at: dict = {}
        for start, stop, marks in self.runs:
            start, stop = max(start - first, 0), min(stop - first, len(body))
            for mark in marks if start < stop else ():
                if mark in open_at and spans[open_at[mark]][1] == start:
                    spans[open_at[mark]][1] = stop
                else:
                    open_at[mark] = len(spans)
                    spans.append([start, stop, *mark])
        out = [{"at": a, "len": b - a, "mark": m, "value": v} for a, b, m, v in spans]
        out += [{"at": min(max(a - first, 0), len(body)), "len": 0, "mark": "img", "value": v} for a, v in self.objects]
        return body, sorted(out, key=lambda s: (s["at"], -s["len"], s["mark"]))


class _Open:
    __slots__ = ("tag", "mark", "used", "number", "table", "row", "col", "span")

    def __init__(self, tag: str, mark: tuple | None = None):
        self.tag, self.mark, self.used, self.number, self.row, self.col, self.span = tag, mark, False, 0, -1, -1, 1


class Reader(HTMLParser):
    """rows: the blocks of a page in order. hidden: elements whose text is not read."""

    def __init__(self, page: str, hidden: frozenset[str] = HIDDEN):
        super().__init__(convert_charrefs=True)
        self.hidden, self.rows, self.open, self.skipping = hidden, [], [], []
        self.inline, self.tables = Inline(), 0
        self.feed(page)
        self.close()
        self._flush()

    def _nearest(self, tags, until=()) -> int | None:
        """Place of the innermost open element with one of the tags, looked for inside the innermost of until."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in until:
                return None
        return None

    def _flush(self) -> None:
        inline = self.inline
        if not inline.parts and not inline.objects:
            return
        self.inline = Inline()
        body, marks = inline.done(any(o.tag == "pre" for o in self.open))
        if not body and not inline.objects:
            return
        tag, at = "p", None
        for i in range(len(self.open) - 1, -1, -1):
            o = self.open[i]
            if o.tag in HEADINGS or o.tag in ("pre", "li", "td", "th"):
                tag, at = o.tag, i
                break
            if o.tag in BLOCKS and at is None:
                at = i
        lists = [o for o in self.open if o.tag in ("ul", "ol", "menu", "dir")]
        number = None
        if tag == "li":
            if self.open[at].used:
                tag = "p"
            elif lists and lists[-1].tag == "ol":
                number = lists[-1].number
            self.open[at].used = True
        table, cell = self._nearest({"table"}), self._nearest({"td", "th"}, {"table"})
        parent = self.open[at - 1].tag if at else None
        place = {
            "depth": len(lists), "number": number, "quote": sum(o.tag == "blockquote" for o in self.open),
            "table": self.open[table].number if cell is not None and table is not None else None, "row": self.open[table].row if cell is not None and table is not None else None,
            "col": self.open[cell].col if cell is not None and table is not None else None, "span": self.open[cell].span if cell is not None and table is not None else None,
            "direct": parent in ("body", None) and (at is None or self.open[at].tag not in ("body", "html")),
        }
        if body:
            self.rows.append({"tag": tag, "body": body, "marks": marks, **place})
        else:
            self.rows += [{"tag": "img", "body": source, "marks": [], **place} for _, source in inline.objects]

    def _close(self, to: int) -> None:
        if any(o.tag in BLOCKS for o in self.open[to:]):
            self._flush()
        del self.open[to:]

    def handle_starttag(self, tag, attrs):
        if self.skipping == ["head"] and tag not in HEAD_ONLY:
            self.skipping = []
        given = {k: v or "" for k, v in attrs}
        if self.skipping == ["svg"] and tag == "image":
            self.inline.picture(given.get("xlink:href") or given.get("href") or "")
            return
        if self.skipping or tag in self.hidden:
            if tag in self.hidden and tag not in EMPTY:
                self.skipping.append(tag)
            return
        if tag in BLOCKS:
            self._flush()
            inner = self._nearest(BLOCKS)
            if inner is not None and (self.open[inner].tag == "p" or tag in HEADINGS and self.open[inner].tag in HEADINGS):
                self._close(inner)
            if tag in ENDS:
                ended = self._nearest(*ENDS[tag])
                if ended is not None:
                    self._close(ended)
        if tag == "br":
            self.inline.line_end()
        elif tag in ("img", "image"):
            self.inline.picture(given.get("src") or given.get("href") or given.get("xlink:href") or "")
        elif tag == "hr":
            self.rows.append({"tag": "hr", "body": "", "marks": [], "depth": 0, "number": None, "quote": 0, "table": None, "row": None, "col": None, "span": None, "direct": not self.open or self.open[-1].tag == "body"})
        elif tag not in EMPTY:
            self._begin(tag, given)

    def _begin(self, tag: str, given: dict) -> None:
        mark = (MARKS[tag], given.get("href") if tag == "a" else None) if tag in MARKS and (tag != "a" or "href" in given) else None
        opened = _Open(tag, mark)
        if tag == "table":
            opened.number, self.tables = self.tables, self.tables + 1
        elif tag == "ol":
            opened.number = _number(given.get("start"), 1) - 1
        elif tag in ("tr", "td", "th"):
            table = self._nearest({"table"})
            if table is not None:
                t = self.open[table]
                if tag == "tr":
                    t.row, t.col = t.row + 1, 0
                else:
                    t.row, opened.col, opened.span = max(t.row, 0), max(t.col, 0), max(1, _number(given.get("colspan"), 1))
                    t.col = opened.col + opened.span
        elif tag == "li":
            above = self._nearest({"ul", "ol", "menu", "dir"})
            if above is not None:
                self.open[above].number = _number(given.get("value"), self.open[above].number + 1)
        self.open.append(opened)

    def handle_startendtag(self, tag, attrs):
        # as browsers read it: only empty elements close themselves, but well-formed pages close any
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skipping:
            if tag in self.skipping:
                del self.skipping[self.skipping.index(tag) :]
            return
        found = self._nearest({tag}, () if tag in TABLE or tag in ("body", "html") else SCOPE)
        if found is not None:
            self._close(found)

    def handle_data(self, data):
        if self.skipping == ["head"] and data.strip():
            self.skipping = []
        if not self.skipping:
            marks = tuple(dict.fromkeys(o.mark for o in self.open if o.mark))
            self.inline.add(data, marks, any(o.tag == "pre" for o in self.open))


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d{1,6}", value.strip()) else default


def of_pages(df: DataFrame, key: str = "path", page: str = "html", hidden: frozenset[str] = HIDDEN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, tag, body, marks, depth, number, quote, table, row, col, span, direct): the blocks of each page.

    hidden: elements that are not read. keep: more columns of the page that its blocks get.

    tag: h1 to h6, p, li, td, th, pre, hr, or img (a picture that stands alone; body: its source). body: the whole
    inline text, white space collapsed but for pre, line breaks kept as line ends. marks: places of b, i, u, s, code,
    sub, sup, a (value: the address) and img (len 0; value: the source). depth: lists around the block; number: of an
    item of a numbered list; the second and later blocks of an item are p. quote: quotations around it. table, row,
    col, span: cell of the innermost table. direct: the block's element is a child of the body. Null pages have none.
    """

    run = lambda pages: [Reader(p or "", hidden).rows for p in pages]
    found = replaced(df, [key, *keep], page, "_blocks", run, pa.list_(_BLOCK), f"array<{BLOCK}>").select(key, *keep, F.posexplode("_blocks").alias("pos", "b"))
    return found.select(key, *keep, "pos", *[F.col(f"b.{c}").alias(c) for c in COLUMNS])


def whole(blocks: DataFrame) -> DataFrame:
    """Blocks with all columns; those that a plain table lacks say: no marks, list, quotation or table, a child of the body."""
    plain = {"marks": F.array().cast(MARK), "depth": (F.col("tag") == "li").cast("int"), "quote": F.lit(0), "direct": F.col("tag") != "li"}
    for c in COLUMNS:
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, plain.get(c, F.lit(None).cast("int")))
    return blocks


def nested(marks: list[dict], size: int) -> list[tuple[int, int, tuple]]:
    """Pieces (start, stop, marks from the outside in) of a text whose marks may cross; a picture is an empty piece whose
    last mark is its source."""
    spans = [m for m in marks if m["len"] > 0]
    edges = sorted({0, size, *(m["at"] for m in marks), *(m["at"] + m["len"] for m in spans)})
    edges = [e for e in edges if 0 <= e <= size]
    out = []
    named = lambda own: tuple((m["mark"], m["value"]) for m in sorted(own, key=lambda m: (m["at"], -m["len"], m["mark"])))
    for start, stop in zip(edges, [*edges[1:], size]):
        around = named(m for m in spans if m["at"] < start < m["at"] + m["len"])
        out += [(start, start, (*around, ("img", m["value"]))) for m in marks if m["len"] == 0 and m["mark"] == "img" and m["at"] == start]
        if stop > start:
            out.append((start, stop, named(m for m in spans if m["at"] <= start and stop <= m["at"] + m["len"])))
    return out


def outside(address: str | None) -> bool:
    return (address or "").startswith(("http://", "https://", "mailto:"))


def inline_markup(body: str, marks: list[dict] | None, picture=lambda source: f'<img src="{escape(source)}" alt=""/>', line_end: str = "<br/>") -> str:
    """A block's text as well-formed inline markup, with links to the outside only. picture: the markup of a source, or ''."""
    out: list[str] = []
    open_now: list[tuple] = []
    for start, stop, wanted in [*nested(marks or [], len(body)), (len(body), len(body), ())]:
        shown = picture(wanted[-1][1]) if start == stop and wanted else ""
        wanted = [w for w in wanted if w[0] != "img" and (w[0] != "a" or outside(w[1]))]
        same = 0
        while same < min(len(open_now), len(wanted)) and open_now[same] == wanted[same]:
            same += 1
        out += [f"</{m}>" for m, _ in reversed(open_now[same:])]
        out += [f'<a href="{escape(v)}">' if m == "a" else f"<{m}>" for m, v in wanted[same:]]
        open_now = wanted
        out.append(shown or escape(body[start:stop], quote=False).replace("\n", line_end))
    return "".join(out)


def cells(rows: list[dict]) -> list[list[tuple[int, int, list[dict]]]]:
    """Neighbouring blocks of a table as rows of cells (first column, columns, blocks); gaps are empty cells."""
    out: list[list] = []
    last = None
    for r in rows:
        if last is None or r["row"] != last:
            out.append([])
            last = r["row"]
        line = out[-1]
        if line and line[-1][0] == r["col"]:
            line[-1][2].append(r)
            continue
        at = line[-1][0] + line[-1][1] if line else 0
        if r["col"] > at:
            line.append((at, r["col"] - at, []))
        line.append((r["col"], max(1, r["span"] or 1), [r]))
    return out


def tables(rows: list[dict]):
    """Blocks in order, those of a table together: (block, None) or (None, blocks of a table)."""
    i = 0
    while i < len(rows):
        j = i
        while rows[i]["table"] is not None and j < len(rows) and rows[j]["table"] == rows[i]["table"]:
            j += 1
        yield (rows[i], None) if j == i else (None, rows[i:j])
        i = max(j, i + 1)


class _Tree:
    def __init__(self, picture):
        self.out, self.picture, self.quote = [], picture, 0
        self.lists: list[list] = []  # kind, whether an item is open, its number

    def _lists(self, depth: int) -> None:
        while len(self.lists) > depth:
            kind, item, _ = self.lists.pop()
            self.out.append(f"{'</li>' if item else ''}</{kind}>")

    def _quotes(self, quote: int) -> None:
        if quote != self.quote:
            self._lists(0)
            self.out.append("</blockquote>" * (self.quote - quote) or "<blockquote>" * (quote - self.quote))
            self.quote = quote

    def _item(self, r: dict) -> None:
        depth, number = max(1, r["depth"] or 1), r["number"]
        kind = "ul" if number is None else "ol"
        self._lists(depth)
        if len(self.lists) == depth and (self.lists[-1][0] != kind or number is not None and number <= self.lists[-1][2]):
            self._lists(depth - 1)
        while len(self.lists) < depth:
            if self.lists and not self.lists[-1][1]:
                self.out.append("<li>")
                self.lists[-1][1] = True
            inner = len(self.lists) == depth - 1
            start = f' start="{number}"' if inner and number not in (None, 1) else ""
            self.out.append(f"<{kind if inner else 'ul'}{start}>")
            self.lists.append([kind if inner else "ul", False, 0])
        top = self.lists[-1]
        value = f' value="{number}"' if number is not None and top[1] and number != top[2] + 1 else ""
        self.out.append(f"{'</li>' if top[1] else ''}<li{value}>{inline_markup(r['body'], r['marks'], self.picture)}")
        top[1:] = [True, number or 0]

    def add(self, r: dict) -> None:
        tag = r["tag"]
        self._quotes(r["quote"] or 0)
        if tag == "li":
            self._item(r)
            return
        self._lists(min(r["depth"] or 0, len(self.lists)))
        if tag == "img":
            shown = self.picture(r["body"])
            self.out.append(f"<p>{shown}</p>" if shown else "")
        elif tag == "hr":
            self.out.append("<hr/>")
        else:
            name = "p" if tag in ("td", "th") else tag
            self.out.append(f"<{name}>{inline_markup(r['body'], r['marks'], self.picture, chr(10) if name == 'pre' else '<br/>')}</{name}>")

    def table(self, rows: list[dict]) -> None:
        self._quotes(rows[0]["quote"] or 0)
        self._lists(min(rows[0]["depth"] or 0, len(self.lists)))
        self.out.append("<table>")
        for line in cells(rows):
            self.out.append("<tr>")
            for _, span, held in line:
                name = "th" if held and all(r["tag"] == "th" for r in held) else "td"
                self.out.append(f"<{name}{f' colspan={chr(34)}{span}{chr(34)}' if span > 1 else ''}>")
                if len(held) == 1 and held[0]["tag"] in ("td", "th"):
                    self.out.append(inline_markup(held[0]["body"], held[0]["marks"], self.picture))
                else:
                    self.out.append(tree_markup([r | {"table": None, "quote": 0, "depth": 0 if r["tag"] != "li" else 1} for r in held], self.picture))
                self.out.append(f"</{name}>")
            self.out.append("</tr>")
        self.out.append("</table>")


def tree_markup(rows: list[dict], picture=lambda source: f'<img src="{escape(source)}" alt=""/>') -> str:
    """Blocks in order as well-formed markup: lists and quotations nested by their depths, tables by their cells.

    A table inside a cell stands between two parts of the outer one.
    """
    tree = _Tree(picture)
    for block, table in tables(rows):
        if table is None:
            tree.add(block)
        else:
            tree.table(table)
    tree._quotes(0)
    tree._lists(0)
    return "".join(tree.out)
