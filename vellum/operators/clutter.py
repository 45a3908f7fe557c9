"""What crawlers add to books: intro and contents pages, and marked blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text as T

BLOCK, GUARD, PAGE, PROSE = 400, 200, 8000, 3000


def marks(c: Column) -> Column:
    return T.matches(c, T.CLUTTER)


def has_url(c: Column) -> Column:
    return c.rlike(T.URL)


def droppable(body: Column, footer: Column) -> Column:
    """A short marked block with a second mark, an address or a footer's look; longer ones only with an address."""
    n = F.char_length(body)
    return n.between(1, BLOCK) & (marks(body) > 0) & ((marks(body) >= 2) | has_url(body) | footer) & ((n <= GUARD) | has_url(body))


def clutter_line(body: Column) -> Column:
    return (F.char_length(body) <= BLOCK) & ((marks(body) > 0) | has_url(body))


def contents_page(has_nav: Column, n_lines: Column, hits: Column, heading: Column, has_link: Column) -> Column:
    listed = F.when(heading.rlike(T.CONTENTS_HEAD), hits >= 3).otherwise((hits >= 0.8 * n_lines) & has_link)
    return has_nav | ((n_lines >= 5) & F.coalesce(listed, F.lit(False)))


def intro_page(text: Column, heading: Column, stem: Column, has_intro_id: Column, prose: Column) -> Column:
    """The rules in order; a page whose name says intro passes the guards for chapters and prose."""
    named = stem.isin("intro", "intro_page", "about", "info", "credits", "generated", "source") | stem.rlike("^(?:intro|generated|synopsis|summary|info)")
    synopsis = T.matches(text, T.SYNOPSIS)
    return (
        F.when(F.char_length(text) > PAGE, False)
        .when(heading.rlike(T.CHAPTER_LABEL) & ~named, False)
        .when((prose > PROSE) & ~named, False)
        .when(named | has_intro_id, True)
        .when(marks(text) >= 2, True)
        .when((marks(text) > 0) & (has_url(text) | (synopsis > 0)), True)
        .otherwise((synopsis >= 2) & (prose < PROSE))
    )
