"""Markdown as blocks: headings, items, rules and paragraphs by lines, inline marks by pairs of delimiters."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

#: Delimiters with their marks, in the order in which they are looked for, and whether one that touches
#: its like is none.
DELIMITERS = (("**", "b", False), ("__", "b", False), ("*", "i", True), ("_", "i", True), ("`", "code", True))


def _places(text: str, taken: bytearray, sign: str, alone: bool) -> list[int]:
    """Where a delimiter may stand: on characters that no other took, and if alone, beside none of its kind."""
    same = lambda i: 0 <= i < len(text) and text[i] == sign[0] and not taken[i]
    found = [m.start() for m in re.finditer(f"(?={re.escape(sign)})", text)]
    found = [i for i in found if not any(taken[i : i + len(sign)])]
    return [i for i in found if not (alone and sign != "`" and (same(i - 1) or same(i + 1)))]


def inline(text: str) -> tuple[str, list[dict]]:
    """A text without its delimiters, and what they mark.

    ** and __ mark bold, * and _ italic, backticks code. Kinds are paired one after the other, each place with the next
    one behind it that leaves something between; what finds no other stays text. Marks may hold or cross each other.
    """
    taken = bytearray(len(text))
    spans = []
    for sign, mark, alone in DELIMITERS:
        places, size, k = _places(text, taken, sign, alone), len(sign), 0
        while k < len(places):
            start = places[k]
            close = bisect_left(places, start + size + 1, k + 1)
            if sign == "`" and k + 1 < len(places) and places[k + 1] == start + 1:
                k += 1  # two that touch hold nothing
                continue
            if close == len(places):
                break
            stop = places[close]
            spans.append((start + size, stop, mark))
            taken[start : start + size] = taken[stop : stop + size] = b"\x01" * size
            k = bisect_left(places, stop + size, close)
    kept = list(accumulate((not t for t in taken), initial=0))
    marks = [{"at": kept[a], "len": kept[b] - kept[a], "mark": m, "value": None} for a, b, m in spans if kept[b] > kept[a]]
    return "".join(c for c, t in zip(text, taken) if not t), sorted(marks, key=lambda m: (m["at"], -m["len"], m["mark"]))


def _heading(line: str) -> tuple[int, str] | None:
    level = len(line) - len(line.lstrip("#"))
    if not 1 <= level <= 6 or not line[level : level + 1].isspace():
        return None
    return level, line[level:].strip().rstrip("#").rstrip()


def _item(line: str) -> tuple[int | None, str] | None:
    """Number (none for a bullet) and text of a list item."""
    bare = line.lstrip()
    digits = bare[: len(bare) - len(bare.lstrip("0123456789"))]
    sign, rest = bare[len(digits) : len(digits) + 1], bare[len(digits) + 1 :]
    if not rest[:1].isspace() or sign not in ((".", ")") if digits else ("-", "*", "+")):
        return None
    return (int(digits[:9]) if digits else None), rest.strip()


def _rule(line: str) -> bool:
    bare = line.strip()
    return line.startswith(("---", "***", "___")) and len(set(bare)) == 1


def blocks(text: str) -> list[dict]:
    """The blocks of a text in order, as rows of a block table."""
    out: list[dict] = []
    held: list[str] = []

    def add(tag: str, body: str, number: int | None = None, depth: int = 0) -> None:
        body, marks = inline(body)
        out.append({"tag": tag, "body": body, "marks": marks, "depth": depth, "number": number, "quote": 0, "table": None, "row": None, "col": None, "span": None, "direct": not depth})

    def flush() -> None:
        if held:
            add("p", " ".join(x.strip() for x in held))
            held.clear()

    counted = 0
    for line in re.split(r"\r\n?|\n", text):
        heading, item = _heading(line), _item(line)
        if not line.strip():
            flush()
            counted = 0
        elif heading:
            flush()
            counted = 0
            if heading[1]:
                add(f"h{heading[0]}", heading[1])
        elif _rule(line):
            flush()
            counted = 0
            add("hr", "")
        elif item:
            flush()
            counted = counted + 1 if item[0] is not None else 0
            if item[1]:
                add("li", item[1], counted or None, 1)
        else:
            held.append(line)
            counted = 0
    flush()
    return out
