"""Clean-up of crawled books: which pages leave the reading order, which blocks go, which entries are pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.files import normal_path
from vellum.operators import clutter, markup, structure

FRONT = 3
BLOCKS = ("p", "div", "footer", "section", "span", "small", "aside", "li")
PROSE = ("p", "div", "li", "h1", "h2", "h3", "h4", "blockquote", "span")


def blocks(pages: DataFrame, key: str = "path") -> DataFrame:
    """Elements of each page with body, the collapsed text of the element and all below it, as much of it as the rules
    look at, chars, its whole length, and until, the number of the first element after those."""
    page = F.concat_ws("\x00", F.col(key), F.col("spine_ix").cast("string"))
    nodes = markup.nodes(pages.withColumn("_page", page), "html", "_page", bodies=clutter.BLOCK + 1, tops=clutter.PAGE + 1)
    return nodes.drop("text")


def page_facts(pages: DataFrame, key: str = "path") -> DataFrame:
    """pages with what the classifiers look at."""
    b = blocks(pages, key).where(~F.col("tag").isin("script", "style", "head", "title"))
    line = F.col("tag").isin("li", "a", "p") & (F.col("body") != "")
    hit = F.col("body").rlike(T.CHAPTER_LABEL) | F.lower("body").isin("intro", "introduction", "cover", "prologue", "epilogue")
    holds = F.col("tag").isin("div", "blockquote") & F.col("has_child")
    parents = b.select("_page", F.col("parent").alias("node")).distinct().withColumn("_child", F.lit(True))
    b = b.join(parents, ["_page", "node"], "left").withColumn("has_child", F.coalesce("_child", F.lit(False)))
    facts = b.groupBy("_page").agg(
        F.max(F.col("tag") == "nav").alias("has_nav"), F.max(F.col("tag") == "a").alias("has_link"), F.count_if(line).alias("n_lines"), F.count_if(line & hit).alias("hits"),
        F.coalesce(F.min_by("body", F.when(F.col("tag") == "h1", F.col("node"))), F.min_by("body", F.when(F.col("tag") == "h2", F.col("node"))), F.lit("")).alias("heading"),
        F.max(F.coalesce(F.col("attrs")["id"] == "intro", F.lit(False))).alias("has_intro_id"),
        F.coalesce(F.min_by("body", F.when(F.col("tag") == "body", F.col("node"))), F.max_by("body", "chars")).alias("text"),
        F.coalesce(F.sum(F.when(F.col("tag").isin(*PROSE) & ~holds & ~clutter.clutter_line(F.col("body")), F.col("chars"))), F.lit(0)).cast("long").alias("prose"),
    )
    page = F.concat_ws("\x00", F.col(key), F.col("spine_ix").cast("string"))
    return pages.withColumn("_page", page).join(facts, "_page", "left").drop("_page")


def removed_pages(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, spine_ix, name, reason): pages that leave the reading order.

    pages: key, spine_ix, name, nav, html. The navigation page goes wherever it stands, intro and contents pages
    only among the first. A book of one page stays as it is, and never do all pages go: the last candidate stays.
    """
    facts = page_facts(pages, key)
    stem = F.lower(F.regexp_replace(F.element_at(F.split("name", "/"), -1), r"\.[^.]*$", ""))
    front = F.col("spine_ix") <= FRONT
    intro = clutter.intro_page(F.col("text"), F.col("heading"), stem, F.col("has_intro_id"), F.col("prose"))
    contents = clutter.contents_page(F.col("has_nav"), F.col("n_lines"), F.col("hits"), F.col("heading"), F.col("has_link"))
    reason = F.when(F.col("nav"), "navigation").when(front & F.coalesce(intro, F.lit(False)), "intro").when(front & F.coalesce(contents, F.lit(False)), "contents")
    judged = facts.select(key, "spine_ix", "name", reason.alias("reason"), F.count("*").over(Window.partitionBy(key)).alias("n")).withColumn("remove", F.col("reason").isNotNull() & (F.col("n") > 1))
    return structure.keep_last(judged, [key], "spine_ix", "remove").where("remove").select(key, "spine_ix", "name", "reason")


def dropped_blocks(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, spine_ix, node, tag, body): marked blocks that go, without those inside one that goes already."""
    b = blocks(pages, key)
    footer = F.col("tag").isin("footer", "small") | F.coalesce(F.lower(F.col("attrs")["class"]).contains("footer"), F.lit(False))
    gone = b.where(F.col("tag").isin(*BLOCKS) & clutter.droppable(F.col("body"), footer))
    w = Window.partitionBy("_page").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    end = F.max("until").over(w)
    outer = gone.withColumn("_end", end).where(F.col("_end").isNull() | (F.col("node") >= F.col("_end")))
    parts = F.split("_page", "\x00")
    return outer.select(parts[0].alias(key), parts[1].cast("int").alias("spine_ix"), "node", "tag", "body")


def pruned_links(links: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    """Links of contents lists whose page stays. links: key, base, href, label."""
    target = links.withColumn("_t", normal_path(F.col("base"), F.col("href")))
    return target.join(removed.select(key, F.col("name").alias("_t")), [key, "_t"], "left_anti").drop("_t")


def notes(removed: DataFrame, dropped: DataFrame, key: str = "path") -> DataFrame:
    """(key, note): what was done, in words."""
    say = lambda n, what: F.concat(F.lit("removed "), n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"))
    a = removed.groupBy(key).agg(F.count("*").alias("n")).select(key, say(F.col("n"), "extra page").alias("note"))
    b = dropped.groupBy(key).agg(F.count("*").alias("n")).select(key, say(F.col("n"), "clutter block").alias("note"))
    return a.unionByName(b)
