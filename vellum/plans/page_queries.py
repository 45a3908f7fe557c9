"""Queries over pages and documents as blocks, elements, chapters and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import blocks, markup, structure
from vellum.sources import packages, splits, writers
from vellum.sources.tables import load
from vellum.sources.tables import pages as closed_pages

QUERIES: dict = {}
SQL: dict = {}
W = T.WS_SQL

#: Pages without what is not shown, and their text without markup and white space.
SHOWN = rf"""
bare AS (SELECT page_id, html, regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS h FROM pages),
shown AS (SELECT page_id, html, h, regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '{W}+', '', 'g') AS t FROM bare)"""
#: The first article of a page.
ARTICLE = rf"""{SHOWN.strip()}, articles AS (SELECT page_id, h, regexp_extract(h, '(?is)<article[^>]*>(.*?)</article>', 1) AS a FROM shown)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(rf"""WITH {SHOWN} SELECT page_id, len(regexp_extract_all(h, '(?i)<h[1-6][ >]')) AS headings, len(regexp_extract_all(h, '(?i)<li[ >]')) AS items,
  len(regexp_extract_all(h, '(?i)<a [^>]*href=')) AS links, length(t) AS chars, sha1(t) AS sha1 FROM shown""")
def page_blocks(spark, sf_dir):
    """All shown text of each page as blocks: headings, items, linked places, and a digest of all their characters."""
    found = blocks.of_pages(closed_pages(spark, sf_dir).select("page_id", "html"), "page_id")
    bare = F.regexp_replace("body", f"{T.WS}+", "")
    links = F.size(F.filter("marks", lambda m: m["mark"] == "a"))
    packed = found.groupBy("page_id").agg(
        F.count_if(F.col("tag").rlike("^h[1-6]$")).alias("headings"), F.count_if(F.col("tag") == "li").alias("items"), F.sum(links).alias("links"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", bare.alias("t")))), lambda x: x["t"]), "").alias("t"),
    )
    counted = load(spark, sf_dir, "pages").select("page_id").join(packed, "page_id", "left")
    text = F.coalesce("t", F.lit(""))
    return counted.select("page_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("headings", "items", "links")], F.char_length(text).cast("long").alias("chars"), F.sha1(text).alias("sha1"))


@query(rf"""WITH {SHOWN}, bold AS (SELECT page_id, regexp_extract(h, '(?is)<p><b>(.*?)(?:<br>|</b>|</p>|<p>)', 1) AS raw FROM shown)
SELECT page_id, length(t) AS chars, sha1(t) AS sha1 FROM (SELECT page_id, regexp_replace(replace(replace(replace(raw, '&quot;', '"'), '&copy;', '©'), '&amp;', '&'), '{W}+', '', 'g') AS t FROM bold WHERE raw <> '') WHERE t <> ''""")
def bold_openings(spark, sf_dir):
    """What is bold in the first paragraph that begins so, up to a line break."""
    found = blocks.of_pages(closed_pages(spark, sf_dir).select("page_id", "html"), "page_id").where("tag = 'p'")
    bold = F.get(F.filter("marks", lambda m: (m["mark"] == "b") & (m["at"] == 0)), 0)
    first = found.where(bold.isNotNull()).groupBy("page_id").agg(F.min_by(F.struct("body", bold.alias("m")), "pos").alias("b"))
    text = F.regexp_replace(F.split_part(F.substring(F.col("b.body"), F.lit(1), F.col("b.m.len")), F.lit("\n"), F.lit(1)), f"{T.WS}+", "")
    return first.select("page_id", F.char_length(text).cast("long").alias("chars"), F.sha1(text).alias("sha1"))


@query(rf"""WITH {ARTICLE} SELECT page_id, len(regexp_extract_all(a, '(?i)<h1[ >]')) AS h1, len(regexp_extract_all(a, '(?i)<p[ >]')) AS p,
  len(regexp_extract_all(a, '<[a-zA-Z]')) AS inside, CASE WHEN len(regexp_extract_all(a, '(?i)<h1[ >]')) >= 2 THEN 'h1' WHEN len(regexp_extract_all(a, '(?i)<h2[ >]')) >= 2 THEN 'h2' WHEN len(regexp_extract_all(a, '(?i)<h3[ >]')) >= 2 THEN 'h3' END AS level
FROM articles WHERE h LIKE '%<article%'""")
def article_children(spark, sf_dir):
    """Direct children and all elements of each page's article, and the heading level that recurs among the children."""
    nodes = markup.nodes(load(spark, sf_dir, "pages").select("page_id", "html"), "html", "page_id")
    outer = nodes.where("tag = 'article'")
    inner = markup.inside(nodes.drop("attrs", "text"), outer, "page_id").groupBy("page_id", F.col("around").alias("node")).agg(F.count("*").alias("inside"))
    counted = markup.children(nodes, "page_id", ["h1", "h2", "h3", "p"])
    joined = outer.select("page_id", "node").join(inner, ["page_id", "node"], "left").join(counted, ["page_id", "node"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("page_id", zero("h1"), zero("p"), zero("inside"), structure.heading_level().alias("level"))


@query(rf"""WITH {SHOWN}, a AS (SELECT page_id, generate_subscripts(regexp_split_to_array(h, '(?i)<li[ >]'), 1) - 2 AS n, unnest(regexp_split_to_array(h, '(?i)<li[ >]')) AS part FROM shown)
SELECT page_id, n, regexp_extract(part, '(?i)<a [^>]*href="([^"]*)"', 1) AS href FROM a WHERE n >= 0 AND regexp_matches(part, '(?i)^[^<]*<a [^>]*href=')""")
def list_links(spark, sf_dir):
    """Links with the number of the list item around them."""
    nodes = markup.nodes(load(spark, sf_dir, "pages").select("page_id", "html"), "html", "page_id", owners=("li",))
    items = nodes.where("tag = 'li'").select("page_id", F.col("node").alias("owner"), (F.row_number().over(Window.partitionBy("page_id").orderBy("node")) - 1).cast("long").alias("n"))
    links = nodes.where((F.col("tag") == "a") & F.col("owner").isNotNull()).select("page_id", "owner", F.col("attrs")["href"].alias("href"))
    return links.join(items, ["page_id", "owner"]).select("page_id", "n", "href")


@query(r"""WITH raw AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), 1) AS pos FROM documents),
b AS (SELECT doc_id, pos, line, CASE WHEN line LIKE '%!' THEN 'h1' WHEN length(line) < 60 THEN 'h2' ELSE 'p' END AS tag FROM raw WHERE trim(line) <> ''),
n AS (SELECT *, sum(CASE WHEN tag = 'h1' THEN 1 ELSE 0 END) OVER d AS h1, sum(CASE WHEN tag = 'h2' THEN 1 ELSE 0 END) OVER d AS h2 FROM b WINDOW d AS (PARTITION BY doc_id)),
l AS (SELECT *, CASE WHEN h1 >= 2 THEN 'h1' WHEN h2 >= 2 THEN 'h2' END AS level, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM n),
g AS (SELECT *, 1 + sum(CASE WHEN tag = level AND k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS ch FROM l)
SELECT doc_id, CAST(ch AS BIGINT) AS ch, md5(coalesce(left(trim(regexp_replace(arg_min(line, pos) FILTER (tag <> 'p'), '\s+', ' ', 'g')), 150), CASE WHEN any_value(level) IS NULL THEN 'Untitled' ELSE 'Part ' || ch END)) AS title, count(*) AS blocks FROM g GROUP BY doc_id, ch""")
def chapter_promotion(spark, sf_dir):
    """Lines as blocks, shouted ones as h1 and short ones as h2, in chapters at the level that recurs."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("pos", "body")).where("trim(body) <> ''")
    tag = F.when(F.col("body").endswith("!"), "h1").when(F.char_length("body") < 60, "h2").otherwise("p")
    found = structure.promoted(lines.select("doc_id", "pos", tag.alias("tag"), "body", F.lit(True).alias("direct")), "doc_id", F.lit("Untitled"), F.lit("Part"))
    return found.groupBy("doc_id", F.col("ch").cast("long").alias("ch"), "chapter").agg(F.count("*").alias("blocks")).select("doc_id", "ch", F.md5("chapter").alias("title"), "blocks")


@query(r"""WITH p AS (SELECT page_id, html, octet_length(encode(html)) AS n FROM pages) SELECT page_id, n > 2048 AS cut, sha1(CASE WHEN n > 2048 THEN substr(html, instr(html, '<body>') + 6, CASE WHEN instr(html, '</body>') > 0 THEN instr(html, '</body>') ELSE length(html) + 1 END - instr(html, '<body>') - 6) ELSE html END) AS sha1, true AS fits FROM p""")
def page_parts(spark, sf_dir):
    """Pages in parts of 2 KB: whether they are cut, what their parts hold together, and whether each part fits or is
    one block, and reads as the page does there."""
    pages = load(spark, sf_dir, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), "html")
    parts = splits.split_pages(pages, 2048, "page_id", least=1024)
    read = blocks.of_pages(parts.withColumn("k", F.concat_ws("/", F.col("page_id").cast("string"), F.col("part").cast("string"))), "k", "content", keep=("page_id", "part"))
    n = read.groupBy("page_id", "part").agg(F.count_if(F.col("body") != "").alias("blocks"))
    rows = parts.join(n, ["page_id", "part"], "left")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "inner"))), lambda x: x["inner"]), "")
    single = F.coalesce("blocks", F.lit(0)) <= 1
    return rows.groupBy("page_id").agg((F.max("parts") > 1).alias("cut"), F.sha1(joined).alias("sha1"), F.bool_and((F.col("size") <= 2048) | single).alias("fits"))


@query(rf"""WITH {SHOWN}, c AS (SELECT page_id, t, regexp_replace(h, '(?is)</?a\b[^>]*>', '', 'g') AS h FROM shown)
SELECT page_id, len(regexp_extract_all(h, '<[a-zA-Z]')) AS elements, sha1(t) AS sha1 FROM c""")
def cleaned_pages(spark, sf_dir):
    """Pages as plain markup: how many elements stay, and a digest of the text."""
    pages = closed_pages(spark, sf_dir).select("page_id", markup.cleaned(F.col("html")).alias("h"))
    found = markup.nodes(pages, "h", "page_id").groupBy("page_id").agg(F.count("*").alias("elements"))
    plain = blocks.of_pages(pages, "page_id", "h")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.regexp_replace("body", f"{T.WS}+", "").alias("t")))), lambda x: x["t"]), "")
    texts = plain.groupBy("page_id").agg(text.alias("t"))
    return pages.select("page_id").join(found, "page_id", "left").join(texts, "page_id", "left").select("page_id", F.coalesce("elements", F.lit(0)).cast("long").alias("elements"), F.sha1(F.coalesce("t", F.lit(""))).alias("sha1"))


@query(rf"""WITH {SHOWN} SELECT page_id, sha1(upper(replace(t, 'ß', 'ss'))) AS sha1 FROM shown""")
def converted_pages(spark, sf_dir):
    """Pages converted to text files: all characters of their chapters but for the marks that a text file has."""
    pages = closed_pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("path"), "html")
    files = pages.select("path", F.concat("path", F.lit(".html")).alias("name"), F.lit(".html").alias("ext"), F.lit("html").alias("kind"), F.encode("html", "UTF-8").alias("content"))
    rows = packages.any_blocks(files)
    made = writers.as_text(rows.withColumn("chapter", F.lit("")), files.select("path", F.lit("").alias("title"), F.lit(None).cast("string").alias("author")))
    bare = F.regexp_replace(F.regexp_replace("text", "(?m)^(?:• )", ""), f"{T.WS}+", "")
    return made.select(F.col("path").cast("long").alias("page_id"), F.sha1(F.upper(bare)).alias("sha1"))
