"""HTML and XML as text nodes, element nodes and titles, and edits in place, from parser events."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from html import escape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.pieces import over, replaced

#: Elements whose text is not translated, and elements without an end tag.
SKIPPED = frozenset("script style code pre svg math head title meta link".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that plain markup has not, and the attributes that it keeps.
DROPPED = frozenset("script style noscript template iframe object embed video audio canvas form input button select textarea head title meta link base svg".split())
KEPT = ("src", "href", "style", "class", "colspan", "rowspan", "alt", "dir", "lang")
#: Elements that begin a block and end an open paragraph, and headings.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend"
    " li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag ends if it is open, and how far out that is looked for.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}


def _line_starts(page: str) -> list[int]:
    starts = [0]
    while (at := page.find("\n", starts[-1])) >= 0:
        starts.append(at + 1)
    return starts


class TextNodes(HTMLParser):
    """Text between tags, outside skipped elements; unclosed elements do no harm.

    found: the texts; places: where each begins in the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.places: list[int] = []
        self.skipping: list[str] = []
        self.title: list[str] | None = None
        self.in_title = False

    def feed(self, page: str) -> None:
        self.lines = _line_starts(page)
        super().feed(page)

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        if tag in SKIPPED and tag not in EMPTY:
            self.skipping.append(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.skipping:
            del self.skipping[self.skipping.index(tag) :]

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.skipping and data.strip():
            self.found.append(data)
            self.places.append(self._here())


def _parsed(page: str | None) -> TextNodes:
    parser = TextNodes()
    parser.feed(page or "")
    parser.close()
    return parser


def text_nodes(df: DataFrame, page: str) -> DataFrame:
    """Adds texts: the text nodes of each page in order."""
    return df.withColumn("texts", F.arrow_udf(over(lambda pages: [_parsed(p).found for p in pages], pa.list_(pa.string())), "array<string>")(F.col(page)))


def with_texts(page: str, texts: list[str | None]) -> str:
    """The page with its text nodes replaced, in order; null leaves one as it is. All markup stays untouched."""
    parser, out, at = _parsed(page), [], 0
    for start, new in zip(parser.places, texts):
        if new is None:
            continue
        # a < that begins no tag is a text by itself
        stop = start + 1 if page[start] == "<" else page.find("<", start)
        out += [page[at:start], escape(new, quote=False)]
        at = stop if stop >= 0 else len(page)
    return "".join([*out, page[at:]])


def replaced_texts(page: Column, texts: Column) -> Column:
    """Pages with their text nodes replaced, see with_texts."""

    def run(pages: list, news: list) -> list:
        return [None if p is None else with_texts(p, n or []) for p, n in zip(pages, news)]

    return F.arrow_udf(over(run, pa.string()), "string")(page, texts)


def titles(df: DataFrame, page: str = "html") -> DataFrame:
    """Adds title: that of the page, white space collapsed, at most 150 characters."""
    raw = F.arrow_udf(over(lambda pages: ["".join(_parsed(p).title or []) for p in pages], pa.string()), "string")(F.col(page))
    return df.withColumn("title", F.left(T.collapse(raw), F.lit(150)))


class Elements(HTMLParser):
    """Elements in the order of their start tags: parent, depth, tag, attrs, own text, the element after the last one
    inside (until), where the element begins and ends in the page, and where what is inside begins and ends.

    A paragraph ends where a block begins, and items, cells and rows where the next one does."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.names: Counter = Counter()
        self.lines, self.page = _line_starts(page), page
        self.feed(page)
        self.close()
        self._end(0, len(page))

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, to: int, at: int) -> None:
        while len(self.open) > to:
            row = self.rows[self.open.pop()]
            self.names[row["tag"]] -= 1
            row["until"], row["stop"], row["inner_stop"] = len(self.rows), at, at

    def _ended(self, tag: str, start: int) -> None:
        """Ends what the start tag of a block ends without an end tag."""
        if self.names["p"] or tag in HEADINGS:
            i = len(self.open) - 1
            while i >= 0 and self.rows[self.open[i]]["tag"] not in BLOCKS:
                i -= 1
            if i >= 0 and ((inner := self.rows[self.open[i]]["tag"]) == "p" or tag in HEADINGS and inner in HEADINGS):
                self._end(i, start)
        if tag in ENDS and any(self.names[t] for t in ENDS[tag][0]):
            i = len(self.open) - 1
            while i >= 0 and self.rows[self.open[i]]["tag"] not in ENDS[tag][1]:
                if self.rows[self.open[i]]["tag"] in ENDS[tag][0]:
                    self._end(i, start)
                    break
                i -= 1

    def _start(self, tag, attrs, closed: bool):
        start = self._here()
        if tag in BLOCKS:
            self._ended(tag, start)
        stop = start + len(self.get_starttag_text() or "")
        parent = self.open[-1] if self.open else None
        self.rows.append({"parent": parent, "depth": len(self.open), "tag": tag, "attrs": [(k, v or "") for k, v in dict(attrs).items()], "texts": [], "until": len(self.rows) + 1, "start": start, "stop": stop, "inner": stop, "inner_stop": stop})
        if not closed:
            self.open.append(len(self.rows) - 1)
            self.names[tag] += 1

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, tag in EMPTY)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, True)

    def handle_endtag(self, tag):
        if not self.names[tag]:
            return
        i = len(self.open) - 1
        while self.rows[self.open[i]]["tag"] != tag:
            i -= 1
        here, row = self._here(), self.rows[self.open[i]]
        self._end(i, here)
        row["stop"] = self.page.find(">", here) + 1 or len(self.page)

    def handle_data(self, data):
        if self.open:
            self.rows[self.open[-1]]["texts"].append(data)


class Bodies:
    """The text of each element and all inside it, white space collapsed: its length, and as much as is wanted.

    Worked out from sums before each element, so a page takes memory in proportion to its size, not to its depth."""

    def __init__(self, rows: list[dict], texts: list[str]):
        self.rows = rows
        self.words = [t.split() for t in texts]
        self.filled = [i for i, w in enumerate(self.words) if w]
        self.n = list(accumulate((len(w) for w in self.words), initial=0))
        self.chars = list(accumulate((sum(map(len, w)) for w in self.words), initial=0))

    def size(self, i: int) -> int:
        until = self.rows[i]["until"]
        n = self.n[until] - self.n[i]
        return self.chars[until] - self.chars[i] + max(0, n - 1)

    def head(self, i: int, most: int) -> str:
        out, size = [], 0
        for k in self.filled[bisect_left(self.filled, i) : bisect_left(self.filled, self.rows[i]["until"])]:
            for word in self.words[k]:
                out.append(word)
                size += len(word) + 1
                if size > most:
                    return " ".join(out)[:most]
        return " ".join(out)


NODE = "array<struct<parent:int,depth:int,tag:string,attrs:map<string,string>,text:string,until:int,body:string,chars:int,owner:int>>"
_NODE = pa.list_(pa.struct([("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("until", pa.int32()), ("body", pa.string()), ("chars", pa.int32()), ("owner", pa.int32())]))


def _owners(rows: list[dict], tags: frozenset[str]) -> list[int | None]:
    """The innermost element with one of the tags around each element."""
    out: list[int | None] = []
    for row in rows:
        above = row["parent"]
        out.append(None if above is None else above if rows[above]["tag"] in tags else out[above])
    return out


def nodes(df: DataFrame, page: str, key: str, bodies: int = 0, tops: int = 0, owners: tuple[str, ...] = ()) -> DataFrame:
    """(key, node, parent, depth, tag, attrs, text, until): the elements of each page in the order of their start tags.

    An element is inside another if its number lies between that one's and its until; see inside and children.
    bodies: also body, the text of the element and all inside it, white space collapsed, of which the first so many
    characters are given (tops, if more, for body elements and those without parent), and chars, its whole length.
    owners: also owner, the innermost element with one of these tags around. One pass over the page, inside its row.
    """
    tags = frozenset(owners)

    def run(pages: list) -> list:
        out = []
        for p in pages:
            rows = Elements(p or "").rows
            texts = ["".join(r.pop("texts")) for r in rows]
            around = _owners(rows, tags)
            held = Bodies(rows, texts) if bodies else None
            for i, (row, text) in enumerate(zip(rows, texts)):
                most = max(bodies, tops) if row["tag"] == "body" or row["parent"] is None else bodies
                row |= {"text": text, "body": held.head(i, most) if held else None, "chars": held.size(i) if held else None, "owner": around[i]}
            out.append(rows)
        return out

    found = replaced(df, [key], page, "_nodes", run, _NODE, NODE).select(key, F.posexplode("_nodes").alias("node", "n"))
    kept = ["parent", "depth", "tag", "attrs", "text", "until", *(["body", "chars"] if bodies else []), *(["owner"] if owners else [])]
    return found.select(key, "node", *[F.col(f"n.{c}").alias(c) for c in kept])


def inside(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Pairs of elements of a page, one inside the other: the columns of inner, and around, the number of the outer one."""
    o = outer.select(F.col(key).alias("_k"), F.col("node").alias("around"), F.col("until").alias("_until"))
    hit = F.col(key).eqNullSafe(F.col("_k")) & (F.col("node") > F.col("around")) & (F.col("node") < F.col("_until"))
    return inner.join(o, hit).drop("_k", "_until")


def children(rows: DataFrame, key: str, tags: list[str]) -> DataFrame:
    """(key, node, and a column for each tag): how many children with each tag the elements that have children have."""
    count = [F.count_if(F.col("tag") == t).alias(t) for t in tags]
    return rows.where("parent IS NOT NULL").groupBy(key, F.col("parent").alias("node")).agg(*count)


def without(page: str, spans: list[tuple[int, int]]) -> str:
    """The page without some spans of it, which may lie inside one another."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if start >= at:
            out.append(page[at:start])
        at = max(at, stop)
    return "".join([*out, page[at:]])


class _Clean(HTMLParser):
    """Plain markup: lower-case names, no comments, no dropped elements, few attributes, outside links only."""

    def __init__(self, images: frozenset[str] | None):
        super().__init__(convert_charrefs=True)
        self.images, self.out, self.open, self.dropped = images, [], [], []

    def handle_starttag(self, tag, attrs, closed=False):
        tag, given = tag.rsplit(":", 1)[-1], dict(attrs)
        if tag in DROPPED:
            if not closed and tag not in EMPTY:
                self.dropped.append(tag)
            return
        href = next((v or "" for k, v in attrs if k.rsplit(":", 1)[-1] in ("href", "src")), "")
        if tag == "image":
            tag, given = "img", {"src": href}
        if self.dropped and not (tag == "img" and self.dropped == ["svg"]):
            return
        if tag == "img":
            if self.images is None or href in self.images:
                self._write("img", {"src": href, "alt": given.get("alt")}, True)
            return
        shown = tag != "a" or href.startswith(("http://", "https://", "mailto:"))
        empty = closed or tag in EMPTY
        if shown:
            self._write(tag, {k: given[k] for k in KEPT if k in given}, empty)
        if not empty:
            self.open.append((tag, shown))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        tag = tag.rsplit(":", 1)[-1]
        if self.dropped:
            if tag in self.dropped:
                del self.dropped[self.dropped.index(tag) :]
        elif any(t == tag for t, _ in self.open):
            while True:
                last, shown = self.open.pop()
                if shown:
                    self.out.append(f"</{last}>")
                if last == tag:
                    return

    def _write(self, tag, attrs, empty):
        said = "".join(f' {k}="{escape(v or "")}"' for k, v in attrs.items() if v is not None)
        self.out.append(f"<{tag}{said}/>" if empty and tag in EMPTY else f"<{tag}{said}></{tag}>" if empty else f"<{tag}{said}>")

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(escape(data, quote=False))


def cleaned(page: Column, images: Column | None = None) -> Column:
    """Pages as plain well-formed markup, see _Clean; the text after a dropped element stays, and so do the first
    images of drawings. images: the sources that may stay (array), all if not given."""

    def one(p: str | None, kept) -> str | None:
        if p is None:
            return None
        parser = _Clean(None if kept is None else frozenset(kept))
        parser.feed(p)
        parser.close()
        return "".join([*parser.out, *(f"</{t}>" for t, shown in reversed(parser.open) if shown)])

    if images is None:
        return F.arrow_udf(over(lambda pages: [one(p, None) for p in pages], pa.string()), "string")(page)
    return F.arrow_udf(over(lambda pages, kept: [one(p, k or []) for p, k in zip(pages, kept)], pa.string()), "string")(page, images)
