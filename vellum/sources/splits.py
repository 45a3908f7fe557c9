"""Pages and books cut into finished files of bounded size, each of which can be read by itself.

Where a page may be cut is worked out from where its elements begin and end, so no text is written anew: what the
parts hold between their heads and ends is, joined, the page's own text. Books are cut into packages that are built
and measured.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.config import MIN_SPLIT_BYTES
from vellum.functions.files import part_name
from vellum.functions.pieces import replaced
from vellum.operators import markup
from vellum.operators.blocks import tree_markup
from vellum.operators.packing import next_fit, packed, split_error
from vellum.sources import writers

#: Elements that are opened if they are large, and bytes that a part has beside its head and blocks.
CONTAINERS = frozenset("div section article body main header footer aside nav figure form fieldset center blockquote details ul ol dl li dd table tbody".split())
OVERHEAD = 200


class Page:
    """A page with the places where it may be cut: between the children of its body, and between those of containers
    of more than half the limit, whatever their depth."""

    def __init__(self, page: str, limit: int):
        self.page = page
        self.rows = markup.Elements(page).rows
        self.upto = None if page.isascii() else list(accumulate((len(c.encode("utf-8", "replace")) for c in page), initial=0))
        body = next((i for i, r in enumerate(self.rows) if r["tag"] == "body"), None)
        head = next((r for r in self.rows if r["tag"] == "head"), None)
        if body is not None:
            self.first, self.last = self.rows[body]["inner"], self.rows[body]["inner_stop"]
        else:
            self.first, self.last = head["stop"] if head else 0, len(page)
        inner: dict[int | None, list[int]] = {}
        for i, r in enumerate(self.rows):
            inner.setdefault(r["parent"], []).append(i)
        #: Places in order, with the containers that are open there.
        self.cuts: list[tuple[int, tuple[int, ...]]] = [(self.first, ())]
        top = inner.get(body, []) if body is not None else [i for i in inner.get(None, []) if self.rows[i]["start"] >= self.first]
        waiting = [(i, ()) for i in reversed(top)]
        while waiting:
            i, way = waiting.pop()
            r = self.rows[i]
            if r["start"] > self.cuts[-1][0] and r["start"] < self.last:
                self.cuts.append((r["start"], way))
            if r["tag"] in CONTAINERS and inner.get(i) and self.size(r["start"], r["stop"]) > limit // 2:
                waiting += [(k, (*way, i)) for k in reversed(inner[i])]
        self.cuts.append((self.last, ()))

    def size(self, start: int, stop: int) -> int:
        """Bytes of a piece of the page."""
        return stop - start if self.upto is None else self.upto[stop] - self.upto[start]

    def part(self, start: int, stop: int) -> tuple[str, str, str]:
        """What stands before, in and behind the part between two cuts, by their numbers."""
        (a, opened), (b, closed) = self.cuts[start], self.cuts[stop]
        again = "".join(self.page[self.rows[i]["start"] : self.rows[i]["inner"]] for i in opened)
        ends = "".join(f"</{self.rows[i]['tag']}>" for i in reversed(closed))
        return self.page[: self.first] + again, self.page[a:b], ends + self.page[self.last :]

    def parts(self, limit: int) -> list[tuple[str, str, str]]:
        around = self.size(0, self.first) + self.size(self.last, len(self.page)) + OVERHEAD
        sizes = [self.size(a, b) for (a, _), (b, _) in zip(self.cuts, self.cuts[1:])]
        real = lambda a, b: sum(len(x.encode("utf-8", "replace")) for x in self.part(a, b))
        return [self.part(a, b) for a, b in packed(sizes, limit, around, real)]


_PART = pa.list_(pa.struct([("before", pa.string()), ("inner", pa.string()), ("behind", pa.string())]))


def split_pages(pages: DataFrame, limit: int, key: str = "path", name: str = "name", page: str = "html", least: int = MIN_SPLIT_BYTES) -> DataFrame:
    """(key, part, parts, part_name, content, inner, size, error): pages in parts of at most limit bytes.

    Each part has the page's head, and opens and closes the containers that it is cut out of; inner is what it has of
    the page, and all of them joined are the body. One block beyond the limit is a part by itself, with an error if it
    is not the only one. A page that fits stays whole; a null page has no parts.
    """
    if limit < least:
        raise ValueError(f"a part has {least} bytes at least")

    def run(column: list) -> list:
        out = []
        for p in column:
            found = [] if p is None else [("", p, "")] if len(p.encode("utf-8", "replace")) <= limit else Page(p, limit).parts(limit)
            out.append([dict(zip(("before", "inner", "behind"), x)) for x in found])
        return out

    cut = replaced(pages, [key, name], page, "_parts", run, _PART, "array<struct<before:string,inner:string,behind:string>>")
    sizes = F.transform("_parts", lambda p: F.octet_length(p["before"]) + F.octet_length(p["inner"]) + F.octet_length(p["behind"]))
    error = split_error(F.array_max(sizes), F.size("_parts"), limit)
    rows = cut.select(key, name, F.size("_parts").alias("parts"), error.alias("error"), F.posexplode("_parts").alias("part", "p")).withColumn("part", F.col("part") + 1)
    content = F.concat("p.before", "p.inner", "p.behind")
    return rows.select(key, "part", "parts", part_name(F.col(name), F.col("part"), F.col("parts")).alias("part_name"), content.alias("content"), F.col("p.inner").alias("inner"), F.octet_length(content).alias("size"), "error")


def _pictures(blocks: list[dict]) -> set[str]:
    return {b["body"] for b in blocks if b["tag"] == "img"} | {m["value"] for b in blocks for m in b["marks"] or [] if m["mark"] == "img"}


def chapter_parts(chapters: list[dict], limit: int) -> list[dict]:
    """Chapters whose markup has more bytes than the limit cut between blocks into chapters titled with their number."""
    out = []
    for c in chapters:
        sizes = [len(tree_markup([b]).encode()) for b in c["blocks"]]
        groups = next_fit(sizes, len(sizes) + 1, limit) if sum(sizes) > limit else [1] * len(sizes)
        for n in range(1, (groups[-1] if groups else 1) + 1):
            held = [b for b, g in zip(c["blocks"], groups) if g == n]
            title = f"{c['chapter']} ({n})" if groups and groups[-1] > 1 else c["chapter"]
            out.append({"chapter": title, "blocks": held, "size": sum(s for s, g in zip(sizes, groups) if g == n)})
    return out


def book_parts(doc: dict, limit: int) -> list[bytes]:
    """Packages of a document's row (see writers.gathered) of at most limit bytes, measured as they are built.

    Text takes about a third of its markup when packed, pictures all their bytes, which stand once in each part that
    shows them. The cover is in the first part, the styles are in all.
    """
    chapters = chapter_parts(doc["chapters"] or [], limit // 3)
    images = doc["images"] or []
    bytes_of = {i["source"]: len(i["data"]) for i in images}
    cover = next((len(i["data"]) for i in images if i["name"] == doc["cover"]), 0)
    sizes = [c["size"] // 3 + 600 + sum(bytes_of.get(s, 0) for s in _pictures(c["blocks"])) + (0 if k else cover) for k, c in enumerate(chapters)]
    made: dict[tuple[int, int], bytes] = {}

    def build(start: int, stop: int) -> int:
        if (start, stop) not in made:
            held = chapters[start:stop]
            shown = set().union(*(_pictures(c["blocks"]) for c in held))
            own = [i for i in images if i["source"] in shown or not start and i["name"] == doc["cover"]]
            made.clear()  # the last one built is the one that is kept
            made[start, stop] = writers.epub(doc | {"chapters": held, "cover": None if start else doc["cover"], "images": None if doc["images"] is None else own})
        return len(made[start, stop])

    out = []
    for start, stop in packed(sizes, limit, len((doc["css"] or "").encode()) // 3 + 4096, build):
        build(start, stop)
        out.append(made[start, stop])
    return out


def split_books(blocks: DataFrame, titles: DataFrame, limit: int, key: str = "path", images: DataFrame | None = None, least: int = MIN_SPLIT_BYTES) -> DataFrame:
    """(key, part, parts, content, size, error): documents as EPUB packages of at most limit bytes each.

    blocks, titles, images: see writers. One slice of a chapter beyond the limit is a part by itself, with an error if
    it is not the only one. A document without blocks has no parts.
    """
    if limit < least:
        raise ValueError(f"a part has {least} bytes at least")
    books = writers.gathered(blocks, titles, key, images).where("chapters IS NOT NULL")
    columns = ("title", "author", "lang", "css", "cover", "chapters", "images")

    def run(*parts: pa.Array) -> pa.Array:
        return pa.array([book_parts(dict(zip(columns, row)), limit) for row in zip(*(p.to_pylist() for p in parts))], pa.list_(pa.binary()))

    cut = books.select(key, F.arrow_udf(run, "array<binary>")(*columns).alias("_parts"))
    error = split_error(F.array_max(F.transform("_parts", lambda p: F.octet_length(p))), F.size("_parts"), limit)
    rows = cut.select(key, F.size("_parts").alias("parts"), error.alias("error"), F.posexplode("_parts").alias("part", "content"))
    return rows.select(key, (F.col("part") + 1).alias("part"), "parts", "content", F.octet_length("content").alias("size"), "error")
