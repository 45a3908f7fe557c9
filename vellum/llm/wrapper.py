"""HTML extraction by wrapper induction.

The different pages of a host stand side by side in groups of about GROUP. In a group, the trees of block elements are
aligned with the largest one by simple tree matching. Nodes whose text stays the same over the pages are template;
nodes whose text varies are slots. The main slot is found from the top by following the child that holds most of the
varying text, up to the one that mixes headings and paragraphs. The text of a page is what its own node at the main
slot holds, less template nodes and less nodes that say themselves that they are a menu, header, footer, sidebar,
notice, advert, form or comment section. Inside an article a name must say nothing else (`ad-box`, but not
`share-price`), and names that may as well be content (`related`, `search`, `notice` ...) count only if half of the
group's pages have such a node. A page whose group has no other page, or that does not align, is its own template: then
the lengths of its texts stand for what varies.

Pages are laid out by ranges of (host, hash of url and page), a single shuffle, so a host with a third of all pages is
spread over as many ranges as its size asks for. Copies of a page leave their map task without the page and get
the text of the one that kept it. A task holds two groups at a time, and the pages of one host in its range for their
copies.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import free_name

GROUP = 64
#: A text is template if so many of the group's different pages have it, and there are at least so many of them.
CONSTANT, LEAST_PAGES = 0.9, 5
#: The share of a group's pages that must have a node of a doubtful name.
AGREED = 0.5
#: The share of a node's varying text that a child must hold for the main slot to lie inside it.
MAIN = 0.6

BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption address details summary hr center nav header footer aside form fieldset menu dialog hgroup".split()
)
#: What the main slot may be.
CONTAINERS = frozenset("html body div section center main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no text of a page: skipped to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes template select head".split())
#: Elements that are never the article.
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
HOMES = ("article", "main")
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promoted sidebar sidebars sidenav menu menus "
    "submenu nav navbar navigation navigations topnav breadcrumb breadcrumbs footer footers colophon comment comments commentlist disqus "
    "cookie cookies consent gdpr popup modal newsletter subscribe signup login share sharing social toolbar pagination pager".split()
)
#: Names of clutter that may as well be content.
DOUBTFUL = frozenset(
    "related recommended recommendations search notice notices notification alert banner overlay widget widgets copyright disclaimer promotion "
    "subscription replies respond complementary contentinfo".split()
)
#: Words that say nothing by themselves.
NEUTRAL = frozenset(
    "a b c s js box boxes container wrap wrapper section sections list block blocks area bar item items link links button buttons top bottom left right "
    "site page post posts article articles story stories entry entries news main inner outer content icon icons form text title label slot unit zone "
    "panel module col column row grid group holder small large mobile desktop primary secondary view body head header thread us this more also".split()
)
#: These mark clutter outside an article; inside, a header holds its title.
HEADERS = frozenset("header masthead".split())
#: Reader comments may be articles of their own.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
_STOPS = re.compile("[>\"']")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[a-z]+")
_ENDS = {tag: re.compile(rf"</{tag}\b", re.I | re.A) for tag in RAW}
_seen: dict[str, tuple] = {}


class Names:
    """What an element's attributes say. inside, outside: clutter inside and outside an article."""

    __slots__ = ("classes", "inside", "doubtful", "outside", "header", "comment")

    def __init__(self, text: str):
        classes, names = [], []
        for kind, value in _NAMES.findall(text):
            values = value.strip("\"'").split()
            if kind.lower() == "class":
                classes += values
            names += (frozenset(_WORDS.findall(_CAMEL.sub(" ", v).lower())) for v in values)
        words = frozenset().union(*names)
        only = lambda marks: any(n & marks and n <= LABELS | DOUBTFUL | NEUTRAL for n in names)
        self.classes = " ".join(sorted(classes))
        self.inside, self.doubtful = only(LABELS), only(DOUBTFUL)
        self.outside = bool(words & LABELS) or self.doubtful or bool(_HIDDEN.search(text))
        self.header, self.comment = bool(words & HEADERS), bool(words & COMMENTS)


def _names(text: str) -> Names:
    if text not in _seen:
        if len(_seen) > 50_000:
            _seen.clear()
        _seen[text] = Names(text)
    return _seen[text]


class Node:
    __slots__ = ("tag", "sign", "clutter", "parts", "doubts")

    def __init__(self, tag: str, sign: str, clutter: bool):
        self.tag, self.sign, self.clutter = tag, sign, clutter
        self.parts: list = []  # strings and nodes in page order
        self.doubts: list | None = None  # of the root: nodes that are clutter if enough pages have them


class Marks:
    """The marks of a page: where a tag ends, quoted > left aside. One pass over the page, whatever it holds."""

    def __init__(self, page: str):
        self.at = [m.start() for m in _STOPS.finditer(page)]
        self.last = page.rfind(">")
        self.ends = ends = [-1] * (len(self.at) + 1)
        following = {'"': -1, "'": -1}
        for i in range(len(self.at) - 1, -1, -1):
            kind = page[self.at[i]]
            if kind == ">":
                ends[i] = self.at[i]
            else:
                ends[i] = ends[following[kind] + 1] if following[kind] >= 0 else -1
                following[kind] = i

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at this place; -1 if it does not."""
        return self.ends[bisect_left(self.at, at)]


_SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}
_SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}


class Open:
    """The open elements of a page, and where on the stack those of each name are."""

    def __init__(self, root: Node):
        self.stack, self.by_tag, self.walls = [root], {}, []

    def push(self, node: Node) -> None:
        self.by_tag.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS and node.tag != "p" and node.tag not in HEADINGS:
            self.walls.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        return max((self.by_tag[t][-1] for t in tags if self.by_tag.get(t)), default=-1)

    def cut(self, to: int) -> None:
        while len(self.stack) > to:
            self.by_tag[self.stack.pop().tag].pop()
            if self.walls and self.walls[-1] == len(self.stack):
                self.walls.pop()

    def close_before(self, tag: str) -> None:
        """Ends what a block element's start tag ends: an open paragraph, or the item before in the same list."""
        if tag in _SIBLINGS:
            last, bound = self.last(_SAME.get(tag, (tag,))), self.last(_SIBLINGS[tag])
        else:
            last, bound = self.last(("p",)), self.walls[-1] if self.walls else -1
        if last > bound:
            self.cut(last)


def parse(page: str) -> Node:
    """The tree of block elements; inline elements count only if they are clutter. Any input gives a tree, in time
    that grows with its length alone."""
    root = Node("root", "root", False)
    root.doubts = []
    marks, open_, endless, at = Marks(page), Open(root), set(), 0
    stack, text = open_.stack, 0  # text: where the text that is not yet placed begins

    def place(until: int) -> None:
        if until > text:
            stack[-1].parts.append(page[text:until])

    while (lt := page.find("<", at)) >= 0 and lt < marks.last:
        at = lt + 1
        m = _OPEN.match(page, lt)
        if not m:
            if page.startswith("<!--", lt):
                place(lt)
                end = page.find("-->", lt + 4)
                text = at = end + 3 if end >= 0 else len(page)
            elif page[at : at + 1] in ("!", "?"):
                place(lt)
                text = at = page.find(">", at) + 1
            continue
        end = marks.end(m.end())
        if end < 0:
            continue
        place(lt)
        text = at = end + 1
        tag, said = m[2].lower(), page[m.end() : end]
        if m[1]:
            if open_.by_tag.get(tag):
                open_.cut(open_.by_tag[tag][-1])
            continue
        if tag == "br":
            stack[-1].parts.append(" ")
            continue
        if tag in RAW:
            if not said.endswith("/"):
                close = None if tag in endless else _ENDS[tag].search(page, at)
                if close and close.end() <= marks.last:
                    text = at = page.find(">", close.end()) + 1
                else:
                    endless.add(tag)
                    if tag != "head":
                        text = at = len(page)
            continue
        names, inside = _names(said), open_.last(HOMES) >= 0
        block = tag in BLOCKS
        clutter = names.comment if tag == "article" else tag in OUTSIDE or (names.inside if inside else names.outside)
        if tag in ("main", "body", "html"):
            clutter = False
        elif tag != "article" and not inside and (tag == "header" or names.header) and block:
            clutter = True
        if not block and not clutter:
            continue
        if block:
            open_.close_before(tag)
        if tag in VOID:
            if block:
                stack[-1].parts.append(Node(tag, tag, True))
            continue
        node = Node(tag, f"{tag} {names.classes}", clutter)
        if inside and block and names.doubtful and not clutter and tag not in HOMES:
            root.doubts.append(node)
        stack[-1].parts.append(node)
        if not said.endswith("/") or block:
            open_.push(node)
    if page.startswith("<!--", lt) and lt >= 0:
        place(lt)
    else:
        place(len(page))
    return root


def plain(text: str) -> str:
    """Character references decoded, white space runs as one space, trimmed."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


def text_blocks(node: Node, dropped=frozenset()) -> list[str]:
    """The texts of a node's blocks in page order, without clutter and without dropped nodes or block texts."""
    out: list[str] = []
    held: list[str] = []

    def flush():
        if held:
            if text := plain("".join(held)):
                out.append(text)
            held.clear()

    # (node, whether its end is due): no recursion, as trees may be deep
    todo: list = [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            held.append(part)
        elif part is None:
            flush()
        elif not part.clutter and id(part) not in dropped:
            flush()
            todo.append(None)
            todo.extend(reversed(part.parts))
        elif part.tag in BLOCKS:
            flush()
    flush()
    return out


def _own(nodes: list[Node]) -> str:
    return plain(" ".join(p for n in nodes for p in n.parts if isinstance(p, str)))


class Slot:
    """A node of the tree to align: a block element, or a run of leaf blocks of one kind.

    text: a hash of all texts below it; size: how long they are; shape: set by Matcher.
    """

    __slots__ = ("sign", "nodes", "leaf", "kids", "size", "text", "shape")

    def __init__(self, sign: str, nodes: list[Node], leaf: bool):
        self.sign, self.nodes, self.leaf, self.kids, self.size, self.text, self.shape = sign, nodes, leaf, [], 0, 0, -1


def skeleton(root: Node) -> Slot:
    """Block elements as slots; neighbouring leaves of one kind are one slot. Sets the hashes and sizes of the texts."""
    top = Slot(root.sign, [root], False)
    order, todo = [], [top]
    while todo:
        slot = todo.pop()
        order.append(slot)
        if slot.leaf:
            continue
        for part in slot.nodes[0].parts:
            if isinstance(part, Node) and not part.clutter:
                leaf = not any(isinstance(p, Node) and not p.clutter for p in part.parts)
                if leaf and slot.kids and slot.kids[-1].leaf and slot.kids[-1].sign == part.sign:
                    slot.kids[-1].nodes.append(part)
                else:
                    slot.kids.append(Slot(part.sign, [part], leaf))
        todo += slot.kids
    for slot in reversed(order):
        own = _own(slot.nodes)
        slot.text = hash((own, *(k.text for k in slot.kids)))
        slot.size = len(own) + sum(k.size for k in slot.kids)
    return top


def _slots(top: Slot):
    """All slots, parents first."""
    todo = [top]
    while todo:
        slot = todo.pop()
        yield slot
        todo += slot.kids


class Matcher:
    """Simple tree matching: the largest order-keeping map of nodes with equal signs under matched parents.

    Trees of equal shape (signs all the way down) have equal weights, so weights are worked out for pairs of shapes,
    once for a whole group. Two pages whose nodes all differ in shape still take the product of their sizes.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.signs: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def shape(self, top: Slot) -> int:
        for slot in reversed(list(_slots(top))):
            kids = tuple(k.shape for k in slot.kids)
            slot.shape = self.known.setdefault((slot.sign, kids), len(self.signs))
            if slot.shape == len(self.signs):
                self.signs.append(slot.sign)
                self.kids.append(kids)
                self.sizes.append(1 + sum(self.sizes[k] for k in kids))
        return top.shape

    def weight(self, x: int, y: int) -> int:
        if self.signs[x] != self.signs[y]:
            return 0
        return self.sizes[x] if x == y else self.weights[x, y]

    def _weigh(self, x: int, y: int):
        """Sets the weight of two shapes of one sign; first yields the pairs of kids whose weights it needs."""
        a, b = self.kids[x], self.kids[y]
        found, total = [], 0
        if a and b:
            ends = set(b)
            yield from ((p, q) for p in set(a) for q in ends if p != q and self.signs[p] == self.signs[q])
            found, total = self._align(a, b)
        self.weights[x, y] = 1 + total
        self.pairs[x, y] = found

    def _align(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[list[tuple[int, int]], int]:
        """The pairs of places of greatest weight in order, and their weight.

        Of the table only every root-of-its-length-th row is kept; the rows between are worked out again on the way
        back, so memory grows with the length times its root.
        """
        if len(a) == len(b) == 1:
            w = self.weight(a[0], b[0])
            return ([(0, 0)] if w else []), w
        gains: dict[int, np.ndarray] = {}
        for p in a:
            if p not in gains:
                if len(gains) * len(b) > 10_000_000:
                    gains.clear()
                gains[p] = np.array([self.weight(p, q) for q in b])
        gain = lambda p: gains[p] if p in gains else np.array([self.weight(p, q) for q in b])

        def step(row: np.ndarray, p: int) -> np.ndarray:
            out = np.zeros_like(row)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain(p)), out=out[1:])
            return out

        apart = max(1, int(len(a) ** 0.5))
        row = np.zeros(len(b) + 1, np.int64)
        kept = [row]
        for i, p in enumerate(a, 1):
            row = step(row, p)
            if i % apart == 0:
                kept.append(row)
        total, found, i, j = int(row[-1]), [], len(a), len(b)
        while i and j:
            base = (i - 1) // apart * apart
            rows = [kept[base // apart]]
            for p in a[base:i]:
                rows.append(step(rows[-1], p))
            while i > base and j:
                here, above = rows[i - base], rows[i - base - 1]
                w = self.weight(a[i - 1], b[j - 1])
                if w and here[j] == above[j - 1] + w:
                    found.append((i - 1, j - 1))
                    i, j = i - 1, j - 1
                elif here[j] == above[j]:
                    i -= 1
                else:
                    j -= 1
        return found, total

    def match(self, a: Slot, b: Slot) -> dict[int, Slot]:
        """id of each matched slot of b -> slot of a."""
        x, y = self.shape(a), self.shape(b)
        # no recursion, as trees may be deep
        due = [self._weigh(x, y)] if a.sign == b.sign and x != y and (x, y) not in self.weights else []
        while due:
            pair = next(due[-1], None)
            if pair is None:
                due.pop()
            elif pair not in self.weights:
                due.append(self._weigh(*pair))
        out: dict[int, Slot] = {}
        todo = [(a, b)] if a.sign == b.sign else []
        while todo:
            x, y = todo.pop()
            out[id(y)] = x
            if x.shape == y.shape:
                todo += zip(x.kids, y.kids)
            else:
                todo += ((x.kids[i], y.kids[j]) for i, j in self.pairs[x.shape, y.shape])
        return out


def match(a: Slot, b: Slot) -> dict[int, Slot]:
    return Matcher().match(a, b)


def main_slot(top: Slot, mass) -> Slot:
    """Follows the child that holds most of what varies. mass: slot -> how much text varies there."""
    at = top
    while at.kids and at.nodes[0].tag != "article":
        best = max(at.kids, key=mass)
        if best.nodes[0].tag not in CONTAINERS or len(best.nodes) > 1:
            break
        if mass(best) < MAIN * sum(map(mass, at.kids)) or mass(best) == 0:
            break
        if any(n.tag in HEADINGS for k in at.kids if not k.kids for n in k.nodes) and best.nodes[0].tag not in HOMES:
            break
        at = best
    return at


def extract_group(pages: list[str]) -> list[str]:
    """The main text of each page of one host."""
    trees = [parse(p) for p in pages]
    signs = Counter(s for t in trees for s in {n.sign for n in t.doubts})
    for tree in trees:
        for node in tree.doubts:
            node.clutter = len(trees) >= LEAST_PAGES and signs[node.sign] >= AGREED * len(trees)
    tops = [skeleton(t) for t in trees]
    different = {}
    for i, top in enumerate(tops):
        different.setdefault(top.text, i)
    if len(different) < 2:
        return [_alone(t) for t in tops]
    reference = max((tops[i] for i in different.values()), key=lambda t: sum(1 for _ in _slots(t)))
    matcher = Matcher()
    maps = [matcher.match(reference, t) for t in tops]
    texts: dict[int, Counter] = {}
    sizes: Counter = Counter()
    for i in different.values():
        for slot in _slots(tops[i]):
            if (to := maps[i].get(id(slot))) is not None:
                texts.setdefault(id(to), Counter())[slot.text, slot.size > 0] += 1
                sizes[id(to)] += slot.size
    enough = len(different) >= LEAST_PAGES

    def constant(slot: Slot) -> int | None:
        """The hash of the text that nearly all pages have at the slot, if there is one."""
        if enough and id(slot) in texts:
            (text, some), n = texts[id(slot)].most_common(1)[0]
            if n >= CONSTANT * len(different) and some:
                return text
        return None

    fixed = {id(s): t for s in _slots(reference) if (t := constant(s)) is not None}
    main = main_slot(reference, lambda s: 0 if id(s) in fixed else sizes[id(s)])
    common: Counter = Counter()
    if enough:
        for i in different.values():
            common.update({_own([n]) for s in _slots(tops[i]) if not s.kids for n in s.nodes})
    often = {t for t, n in common.items() if t and n >= CONSTANT * len(different)}
    out = []
    for top, to in zip(tops, maps):
        home = next((s for s in _slots(top) if to.get(id(s)) is main), None)
        if home is None or not home.size:
            out.append(_alone(top))
            continue
        dropped = set()
        for s in _slots(home):
            if s is not home and fixed.get(id(to.get(id(s)))) == s.text:
                dropped.update(id(n) for n in s.nodes)
            elif often and not s.kids:
                dropped.update(id(n) for n in s.nodes if _own([n]) in often)
        out.append("\n".join(t for n in home.nodes for t in text_blocks(n, dropped)))
    return out


def _alone(top: Slot) -> str:
    return "\n".join(t for n in main_slot(top, lambda s: s.size).nodes for t in text_blocks(n))


def extract(df: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of each page as a new column; a column of that name is replaced.

    Null or empty pages, and pages without an article, have an empty text. Pages without a host in their URL are
    pages of one host without a name. Rows that agree in URL and page are one page and have equal texts. Pages of a
    host that fall into different ranges have templates of their own, so a page's text may depend on how many
    partitions there are. An empty table stays empty.
    """
    host, mark, again = free_name(df, "_host"), free_name(df, "_mark"), free_name(df, "_again")
    kept = [c for c in df.columns if c != out]
    named = df.select(*kept, F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias(host), F.xxhash64(url, page).alias(mark))

    columns = named.columns

    def thin(batches):
        """Takes the page from rows whose task has sent it already."""
        seen: set = set()
        for batch in batches:
            marks = batch.column(mark).to_pylist()
            told = []
            for m in marks:
                told.append(m in seen)
                seen.add(m)
            told = pa.array(told, pa.bool_())
            pages = batch.column(page)
            pages = pc.if_else(told, pa.scalar(None, pages.type), pages)
            yield pa.RecordBatch.from_arrays([pages if c == page else batch.column(c) for c in columns] + [told], names=[*columns, again])

    sent = named.mapInArrow(thin, type(df.schema)(list(named.schema.fields)).add(again, "boolean"))
    laid = sent.repartitionByRange(F.col(host), F.col(mark)).sortWithinPartitions(host, again, mark)
    schema = type(df.schema)([df.schema[c] for c in kept]).add(out, "string")

    def run(batches):
        rows: list = []  # (mark, one row) whose text is not known yet
        waiting, pages, texts = [], {}, {}  # of the host: different pages without a text, all pages and texts

        def settle(n: int):
            group = waiting[:n]
            del waiting[:n]
            texts.update(zip(group, extract_group([pages[m] or "" for m in group])))
            ready = [m in texts for m, _ in rows].index(False) if waiting else len(rows)
            done = pa.Table.from_batches([r for _, r in rows[:ready]]).combine_chunks().to_batches()[0]
            found = pa.array([texts[m] for m, _ in rows[:ready]], pa.string())
            del rows[:ready]
            return pa.RecordBatch.from_arrays([*(done.column(c) for c in kept), found], names=[*kept, out])

        def rest():
            if len(waiting) > GROUP:
                yield settle((len(waiting) + 1) // 2)
            if waiting:
                yield settle(len(waiting))

        name = None
        for batch in batches:
            hosts, marks, copies, whole = (batch.column(c).to_pylist() for c in (host, mark, again, page))
            i = 0
            while i < len(hosts):
                if hosts[i] != name:
                    yield from rest()
                    name, pages, texts = hosts[i], {}, {}
                if copies[i]:
                    yield from rest()
                    end = i
                    while end < len(hosts) and hosts[end] == name and copies[end]:
                        end += 1
                    some = batch.slice(i, end - i)
                    shown = pa.array([pages[m] for m in marks[i:end]], batch.column(page).type)
                    found = pa.array([texts[m] for m in marks[i:end]], pa.string())
                    yield pa.RecordBatch.from_arrays([shown if c == page else some.column(c) for c in kept] + [found], names=[*kept, out])
                    i = end
                    continue
                if marks[i] not in pages:
                    pages[marks[i]] = whole[i]
                    waiting.append(marks[i])
                rows.append((marks[i], batch.slice(i, 1)))
                if len(waiting) > 2 * GROUP:
                    yield settle(GROUP)
                i += 1
        yield from rest()

    return laid.mapInArrow(run, schema)
