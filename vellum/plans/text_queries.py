"""Queries over documents, pages and conversations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from vellum.config import BATCH_CHARS, BATCH_ITEMS
from vellum.functions import files
from vellum.functions import text as T
from vellum.operators import clutter, markup, packing, segments, structure, translate
from vellum.sources.tables import load
from vellum.sources.tables import pages as closed_pages

QUERIES: dict = {}
SQL: dict = {}
W = T.WS_SQL

#: Lines of documents as DuckDB sees them.
LINES = rf"""
lines AS (
  SELECT doc_id, lang, source, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line,
    generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) - 1 AS pos FROM documents
), segs AS (
  SELECT doc_id, lang, source, pos, regexp_replace(line, '^{W}+|{W}+$', '', 'g') AS body FROM lines WHERE regexp_matches(line, '\p{{L}}')
)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _segments(spark, sf_dir):
    return segments.segments(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


@query(f"""WITH {LINES}, per AS (SELECT doc_id, lang, count(*) AS segments, sum(length(body)) AS chars FROM segs GROUP BY ALL)
SELECT d.lang, count(*) AS docs, CAST(sum(coalesce(segments, 0)) AS BIGINT) AS segments, CAST(sum(coalesce(chars, 0)) AS BIGINT) AS chars,
  count(*) FILTER (coalesce(chars, 0) > 5000) AS over_budget FROM documents d LEFT JOIN per USING (doc_id) GROUP BY 1""")
def segment_meter(spark, sf_dir):
    """Flagship: segments and characters by language, and documents beyond a budget."""
    metered = segments.budget_gate(segments.meter(load(spark, sf_dir, "documents").select("doc_id", "lang", "text")), 5000)
    return metered.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("segments").alias("segments"), F.sum("chars").alias("chars"), F.count_if(F.col("verdict") == "over").alias("over_budget"))


@query(f"""WITH {LINES}, per AS (SELECT doc_id, count(*) AS segments, CAST(sum(length(body)) AS BIGINT) AS chars FROM segs GROUP BY 1)
SELECT d.doc_id, coalesce(segments, 0) AS segments, coalesce(chars, 0) AS chars, CASE WHEN coalesce(segments, 0) = 0 THEN 'empty' WHEN chars > 2000 THEN 'over' ELSE 'pass' END AS verdict
FROM documents d LEFT JOIN per USING (doc_id)""")
def budget_gate(spark, sf_dir):
    return segments.budget_gate(segments.meter(load(spark, sf_dir, "documents").select("doc_id", "text")), 2000).select("doc_id", "segments", "chars", "verdict")


@query(f"""WITH {LINES} SELECT source, body, count(*) AS copies, min(struct_pack(doc_id := doc_id, pos := pos)).doc_id AS doc_id,
  CAST(min(struct_pack(doc_id := doc_id, pos := pos)).pos AS INTEGER) AS pos FROM segs GROUP BY source, body""")
def unique_segments(spark, sf_dir):
    return segments.unique(_segments(spark, sf_dir), ["source"], ["doc_id", "pos"])


@query(f"""WITH RECURSIVE {LINES}, firsts AS (SELECT doc_id, body, length(body) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS rn FROM segs GROUP BY doc_id, body),
walk AS (SELECT doc_id, rn, 1 AS batch, 1 AS items, len AS held FROM firsts WHERE rn = 1 UNION ALL
  SELECT f.doc_id, f.rn, CASE WHEN w.items >= {BATCH_ITEMS} OR w.held + f.len > 2000 THEN w.batch + 1 ELSE w.batch END,
    CASE WHEN w.items >= {BATCH_ITEMS} OR w.held + f.len > 2000 THEN 1 ELSE w.items + 1 END,
    CASE WHEN w.items >= {BATCH_ITEMS} OR w.held + f.len > 2000 THEN f.len ELSE w.held + f.len END
  FROM walk w JOIN firsts f ON f.doc_id = w.doc_id AND f.rn = w.rn + 1)
SELECT doc_id, batch, count(*) AS items, max(held) AS chars FROM walk GROUP BY doc_id, batch""")
def batch_plan(spark, sf_dir):
    jobs = load(spark, sf_dir, "documents").select("doc_id", F.transform(segments.bodies(F.col("text")), lambda s: s["body"]).alias("bodies"))
    batched = packing.batches(jobs, "bodies", chars=2000)
    return batched.groupBy("doc_id", "batch").agg(F.count("*").alias("items"), F.sum(F.char_length("body")).alias("chars"))


@query(f"""WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN length(body) % 97 = 0 THEN body ELSE '[hi] ' || body END AS translated FROM segs""")
def translate_expand(spark, sf_dir):
    """Distinct segments of a source through a provider that fails for some, joined back to every place."""
    segs = _segments(spark, sf_dir)
    done = translate.run(segs.select("source", "body").distinct(), translate.Tagging("hi", fails_at=97), least=1)
    return segments.expand(segs, done, ["source"]).select("doc_id", "pos", "translated")


@query(rf"""WITH {LINES}, t AS (SELECT source, doc_id, regexp_replace(regexp_replace(line, '^{W}+|{W}+$', '', 'g'), '[0-9]+', '#', 'g') AS line_key, regexp_replace(line, '^{W}+|{W}+$', '', 'g') AS raw FROM lines),
counted AS (SELECT source, line_key, count(DISTINCT doc_id) AS n_pages FROM t WHERE raw <> '' AND length(raw) < 80 GROUP BY ALL),
pages AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1)
SELECT source, line_key, n_pages FROM counted JOIN pages USING (source) WHERE pages >= 4 AND n_pages >= greatest(3, floor(pages * 0.05))""")
def boilerplate_lines(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("source", "doc_id", F.explode(T.lines(F.col("text"))).alias("line"))
    return structure.boilerplate(docs, "source", "doc_id", "line", share=0.05)


@query(rf"""WITH {LINES}, p AS (SELECT doc_id, pos, regexp_replace(line, '^{W}+|{W}+$', '', 'g') AS t FROM lines),
g AS (SELECT doc_id, pos, t, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM p)
SELECT doc_id, count(*) AS n_lines, string_agg(t, ' ' ORDER BY pos) AS body FROM g WHERE t <> '' GROUP BY doc_id, b""")
def paragraphs(spark, sf_dir):
    found = structure.paragraphs(load(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), "body")


@query(f"""WITH {LINES}, m AS (SELECT doc_id, pos, line, regexp_matches(line, '!!|\\.$') AND length(line) < 60 AS edge,
    coalesce(max(CASE WHEN line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM lines),
g AS (SELECT doc_id, pos, line, 1 + sum(CASE WHEN edge AND seen = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM m)
SELECT doc_id, CAST(grp AS BIGINT) AS "group", count(*) AS n_lines, first(line ORDER BY pos) AS title FROM g GROUP BY doc_id, grp""")
def chapter_split(spark, sf_dir):
    """Lines of documents in groups that begin at short closed ones, worked out inside the row."""
    docs = load(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("lines"))
    edges = F.transform("lines", lambda x: x.rlike(r"!!|\.$") & (F.char_length(x) < 60))
    spans = structure.spans_at(edges, F.transform("lines", lambda x: x != ""))
    rows = docs.select("doc_id", "lines", F.explode(spans).alias("s"))
    return rows.select("doc_id", F.col("s.group").cast("long").alias("group"), F.col("s.n").cast("long").alias("n_lines"), F.get("lines", F.col("s.start")).alias("title"))


#: Comments, scripts and styles, which hold no elements.
NO_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


@query(rf"""WITH b AS (SELECT page_id, regexp_replace(html, '{NO_MARKUP}', '', 'g') AS html FROM pages)
SELECT page_id, len(regexp_extract_all(html, '(?i)<h1[ >]')) AS h1, len(regexp_extract_all(html, '(?i)<p[ >]')) AS p, len(regexp_extract_all(html, '(?i)<li[ >]')) AS li,
  CASE WHEN len(regexp_extract_all(html, '(?i)<h1[ >]')) >= 2 THEN 'h1' WHEN len(regexp_extract_all(html, '(?i)<h2[ >]')) >= 2 THEN 'h2' WHEN len(regexp_extract_all(html, '(?i)<h3[ >]')) >= 2 THEN 'h3' END AS level FROM b""")
def heading_level(spark, sf_dir):
    """Headings, paragraphs and items of each page, and the heading level that recurs; children alone: article_children."""
    nodes = markup.nodes(load(spark, sf_dir, "pages").select("page_id", "html"), "html", "page_id")
    counted = nodes.groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(t) for t in ("h1", "h2", "h3", "p", "li")])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    found = load(spark, sf_dir, "pages").select("page_id").join(counted, "page_id", "left")
    return found.select("page_id", zero("h1"), zero("p"), zero("li"), structure.heading_level().alias("level"))


@query()
def split_txt_parts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    return packing.split_texts(docs, 2048, least=1024).select("doc_id", "part", "parts", "part_name", "size", F.sha1("body").alias("sha1"))


NODES = rf"""
cut AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>', '<x>', 'g') AS h FROM pages),
parts AS (SELECT page_id, unnest(regexp_split_to_array(h, '<[^>]*>')) AS part FROM cut),
nodes AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(part, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^{W}+|{W}+$', '', 'g') AS body FROM parts)"""


@query(f"""WITH {NODES} SELECT p.page_id, count(n.body) AS segments, CAST(coalesce(sum(length(n.body)), 0) AS BIGINT) AS chars
FROM pages p LEFT JOIN nodes n ON n.page_id = p.page_id AND regexp_matches(n.body, '\\p{{L}}') GROUP BY 1""")
def html_segments(spark, sf_dir):
    found = markup.text_nodes(closed_pages(spark, sf_dir), "html").withColumn("texts", F.filter("texts", lambda t: T.translatable(t)))
    return found.select("page_id", F.size("texts").cast("long").alias("segments"), F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.char_length(T.trim(t))).alias("chars"))


@query(rf"""SELECT page_id, left(trim(regexp_replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), '{W}+', ' ', 'g')), 150) AS title FROM pages""")
def html_title(spark, sf_dir):
    return markup.titles(closed_pages(spark, sf_dir).select("page_id", "html")).select("page_id", "title")


@query(rf"""WITH t AS (SELECT page_id, html, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>', ' ', 'g') AS body FROM pages)
SELECT page_id, regexp_matches(html, '(?i)<nav[ >]') AS contents, len(regexp_extract_all(body, '{T.CLUTTER}')) AS marks, regexp_matches(body, '{T.URL}') AS url FROM t""")
def page_flags(spark, sf_dir):
    body = F.regexp_replace("html", r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>", " ")
    return load(spark, sf_dir, "pages").select("page_id", F.col("html").rlike("(?i)<nav[ >]").alias("contents"), clutter.marks(body).cast("long").alias("marks"), clutter.has_url(body).alias("url"))


@query(rf"""WITH {LINES}, made AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 5 = 0 THEN body || ' Generated by webtoepub' WHEN (doc_id + pos) % 5 = 1 THEN body || ' downloaded from www.books.example.com' WHEN (doc_id + pos) % 5 = 2 THEN body || ' made with care' ELSE body END AS body FROM segs),
m AS (SELECT *, len(regexp_extract_all(body, '{T.CLUTTER}')) AS marks, regexp_matches(body, '{T.URL}') AS url FROM made)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, marks, length(body) BETWEEN 1 AND 400 AND marks > 0 AND (marks >= 2 OR url) AND (length(body) <= 200 OR url) AS dropped FROM m WHERE marks > 0""")
def clutter_blocks(spark, sf_dir):
    n, body = (F.col("doc_id") + F.col("pos")) % 5, F.col("body")
    made = F.when(n == 0, F.concat(body, F.lit(" Generated by webtoepub"))).when(n == 1, F.concat(body, F.lit(" downloaded from www.books.example.com"))).when(n == 2, F.concat(body, F.lit(" made with care"))).otherwise(body)
    segs = _segments(spark, sf_dir).select("doc_id", "pos", made.alias("body"))
    return segs.select("doc_id", "pos", clutter.marks(F.col("body")).cast("long").alias("marks"), clutter.droppable(F.col("body"), F.lit(False)).alias("dropped")).where("marks > 0")


@query(r"""WITH m AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
g AS (SELECT conv_id, turn, text, sum(CASE WHEN before IS NOT NULL AND before <> '' AND regexp_matches(text, '^\p{Ll}') AND (NOT regexp_matches(before, '[.!?:;]$') OR before LIKE '%-') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM m)
SELECT conv_id, CAST(grp AS BIGINT) AS "group", count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM g GROUP BY conv_id, grp""")
def conversation_merge(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return structure.continuation(turns, ["conv_id"], "turn", "text").groupBy("conv_id", "group").agg(F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"))


@query("""WITH f AS (SELECT source, sha1(text) AS sha1, count(*) AS uses, min(doc_id) AS first FROM documents WHERE octet_length(encode(text)) >= 64 GROUP BY ALL)
SELECT source, sha1, printf('img_%04d', row_number() OVER (PARTITION BY source ORDER BY first)) AS name, uses FROM f""")
def image_dedupe(spark, sf_dir):
    """Texts stand in for images: distinct ones of a source, named by first use."""
    return structure.image_names(load(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", ["doc_id"], "text")


@query("""WITH s AS (SELECT DISTINCT source, lang FROM documents) SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY lang) AS i, count(*) OVER (PARTITION BY source) AS n FROM s""")
def part_numbers(spark, sf_dir):
    langs = structure.numbered(load(spark, sf_dir, "documents").select("source", "lang").distinct(), ["source"], ["lang"])
    return langs.select("source", "lang", F.col("i").cast("long").alias("i"), "n")


@query("""WITH s AS (SELECT source, doc_id, doc_id % 3 <> 0 OR source IN ('src1', 'src2') AS remove FROM documents)
SELECT source, doc_id, remove AND NOT (bool_and(remove) OVER (PARTITION BY source) AND doc_id = max(doc_id) OVER (PARTITION BY source)) AS remove FROM s""")
def keep_last_rail(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("source", "doc_id", ((F.col("doc_id") % 3 != 0) | F.col("source").isin("src1", "src2")).alias("remove"))
    return structure.keep_last(docs, ["source"], "doc_id", "remove")


@query("""WITH b AS (SELECT l_orderkey AS doc, l_linenumber * 3 AS page, l_partkey AS title FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS doc, part, part * 6 AS s, part * 6 + 6 AS e FROM lineitem, range(4) r(part))
SELECT p.doc, p.part, b.title, b.page - p.s AS page FROM b JOIN p ON b.doc = p.doc AND b.page > p.s AND b.page <= p.e""")
def bookmark_ranges(spark, sf_dir):
    """Bookmarks of parts of six pages, counted from the part's start."""
    items = load(spark, sf_dir, "lineitem")
    marks = items.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 3).cast("long").alias("page"), F.col("l_partkey").alias("title"))
    parts = items.select(F.col("l_orderkey").alias("doc")).distinct().select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("part"))
    return structure.ranged(marks, parts.withColumn("start", F.col("part") * 6).withColumn("end", F.col("part") * 6 + 6), "doc")


@query("""SELECT source, CAST(median(n_chars) AS DOUBLE) AS median, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_median FROM documents GROUP BY source""")
def medians(spark, sf_dir):
    """Interpolating and upper median of document sizes."""
    return structure.medians(load(spark, sf_dir, "documents").select("source", "n_chars"), "source", "n_chars")


@query("""SELECT doc_id, lang, greatest(512, CAST(floor(n_chars * (3000000.0 / sum(n_chars) OVER (PARTITION BY source, lang))) AS BIGINT) + 200) AS scaled FROM documents""")
def size_estimates(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws("/", "source", "lang").alias("g"), "n_chars", F.lit(3000000.0).alias("total"))
    return structure.size_estimates(docs, "g", "n_chars", "total").select("doc_id", "lang", "scaled")


@query("""SELECT doc_id, CASE WHEN n_chars >= 1000000 THEN replace(printf('%.1fM', n_chars / 1e6), '.0M', 'M') WHEN n_chars >= 1000 THEN CAST(n_chars // 1000 AS VARCHAR) || 'k' ELSE CAST(n_chars AS VARCHAR) END AS chars,
  CAST(CAST(round_even(n_chars / 1024.0, 0) AS BIGINT) AS VARCHAR) || ' KB' AS size FROM documents""")
def size_format(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.fmt_chars(F.col("n_chars")).alias("chars"), T.fmt_size(F.col("n_chars")).alias("size"))
