"""Queries of rules over blocks, plans, replies and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import messages
from vellum.operators import accounts, cleanup, layout, packing, service, structure
from vellum.plans.account_queries import PLAN_SQL
from vellum.plans.service_queries import JOBS
from vellum.sources import packages, tables
from vellum.sources.writers import piece

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_extendedprice / 5, 0), l_partkey, l_linenumber) AS ix FROM lineitem""")
def reading_order(spark, sf_dir):
    """Lines of an order as blocks of a page."""
    found = layout.reading_order(tables.load(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_partkey", "l_linenumber")
    return found.select("l_orderkey", "l_linenumber", F.col("ix").cast("long").alias("ix"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS size, 30 * l_linenumber AS chars, l_discount * 10 AS bold FROM lineitem),
m AS (SELECT l_orderkey, median(size) AS body FROM b, LATERAL (SELECT unnest(range(chars))) r GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN chars <= 120 AND (size >= 1.25 * body OR (bold > 0.7 AND size >= 1.05 * body AND chars <= 80)) THEN CASE WHEN size >= 1.6 * body THEN 'h1' ELSE 'h2' END END AS level FROM b JOIN m USING (l_orderkey)""")
def block_headings(spark, sf_dir):
    items = tables.load(spark, sf_dir, "lineitem")
    blocks = items.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("size"), (30 * F.col("l_linenumber")).alias("chars"), (F.col("l_discount") * 10).alias("bold"))
    body = layout.body_size(blocks, ["l_orderkey"], "size", "chars")
    level = layout.heading(F.col("chars"), F.col("size"), F.col("bold"), F.col("body"))
    return blocks.join(body, "l_orderkey").select("l_orderkey", "l_linenumber", level.alias("level"))


@query(f"""WITH {PLAN_SQL} SELECT plan, CASE currency WHEN 'XTR' THEN price || ' ⭐' ELSE '₹' || price END AS price_label,
  concat_ws('; ', CASE kind WHEN 'sub' THEN days || ' days of access' ELSE 'credits: ' || credits END, CASE WHEN kind <> 'sub' THEN 'no end date' WHEN daily_limit = 0 THEN 'no daily limit' ELSE 'daily limit: ' || daily_limit || ' files' END,
  'largest file: ' || max_mb || ' MB', CASE priority WHEN 0 THEN 'served first' WHEN 1 THEN 'served before free jobs' END) AS features FROM plans""")
def plan_features(spark, sf_dir):
    c = F.col
    features = messages.plan_features(c("kind"), c("days"), c("daily_limit"), c("credits"), c("max_mb"), c("priority"))
    return accounts.catalogue(spark).select("plan", messages.price_label(c("price"), c("currency")).alias("price_label"), F.array_join(features, "; ").alias("features"))


@query(f"""WITH {JOBS} SELECT id, chars >= 200000 AND chars / greatest(priority * 20, 1) >= 8000 AS fast FROM jobs""")
def fast_jobs(spark, sf_dir):
    """Jobs as if they took twenty seconds a step of priority."""
    return tables.jobs(spark, sf_dir).select("id", messages.fast_job(F.col("chars"), F.col("priority") * 20).alias("fast"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_name || ' x; ' || n_name || ' y' END AS texts FROM nation""")
def reply_shapes(spark, sf_dir):
    """Replies in their shapes, a fifth of them one text short."""
    n, name = F.col("n_nationkey"), F.col("n_name")
    x, y = F.concat(name, F.lit(" x")), F.concat(name, F.lit(" y"))
    raw = F.when(n % 5 == 4, F.to_json(F.array(x))).when(n % 2 == 0, F.to_json(F.array(x, y))).otherwise(F.to_json(F.array(F.array(x, F.lit("en")), F.array(y, F.lit("en")))))
    return tables.load(spark, sf_dir, "nation").select("n_nationkey", F.array_join(messages.replies(raw, F.lit(2)), "; ").alias("texts"))


@query("""SELECT l_orderkey, l_linenumber, 'text/' || l_partkey || '.xhtml#a' AS href FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def toc_prune(spark, sf_dir):
    """Order lines as contents entries, large parts as pages that left the reading order."""
    link = F.concat(F.lit("text/"), F.col("l_partkey").cast("string"), F.lit(".xhtml#a"))
    links = tables.load(spark, sf_dir, "lineitem").select(F.lit("b").alias("path"), F.lit("OEBPS").alias("base"), link.alias("href"), "l_orderkey", "l_linenumber")
    gone = tables.load(spark, sf_dir, "part").where("p_size > 25").select(F.lit("b").alias("path"), F.concat(F.lit("OEBPS/text/"), F.col("p_partkey").cast("string"), F.lit(".xhtml")).alias("name"))
    return cleanup.pruned_links(links, gone).select("l_orderkey", "l_linenumber", "href")


@query("""SELECT user_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1""")
def broadcast_tally(spark, sf_dir):
    return service.tally(tables.load(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error")


@query("""SELECT p_partkey, p_size <= 4 AS page_number FROM part""")
def page_number_lines(spark, sf_dir):
    """Small sizes with a dot as page numbers, other parts as lines of five digits."""
    line = F.when(F.col("p_size") <= 4, F.concat(F.col("p_size").cast("string"), F.lit("."))).otherwise("12345")
    return tables.load(spark, sf_dir, "part").select("p_partkey", layout.page_number(line).alias("page_number"))


@query("""WITH a AS (SELECT doc_id AS id, lang AS label, 'chapter' AS origin FROM documents), b AS (SELECT page_id AS id, 'page' AS label, 'label' AS origin FROM pages)
SELECT origin, label, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def pooled_labels(spark, sf_dir):
    """Chapters and labels pooled into one pass, told apart afterwards by their origin."""
    a = tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    b = tables.load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("label"))
    return structure.pooled({"chapter": a, "label": b}).groupBy("origin", "label").agg(F.count("*").alias("n"))


@query()
def split_html_parts(spark, sf_dir):
    """Pages as blocks in parts of at most about 2 KB."""
    blocks = packages.html_blocks(tables.load(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), "html"))
    parts = packing.split_blocks(blocks.select("path", "pos", piece().alias("piece")), 2048, 200)
    return parts.select(F.col("path").cast("long").alias("page_id"), "part", "parts", "size")


@query("""SELECT o_orderkey, 50 + CAST(floor(o_totalprice / 1200) AS BIGINT) + 2 * (o_custkey % 7) + 2 * (o_orderkey % 5) AS pages FROM orders""")
def page_budget(spark, sf_dir):
    pages = layout.page_budget(F.col("o_totalprice"), F.col("o_custkey") % 7, F.col("o_orderkey") % 5)
    return tables.load(spark, sf_dir, "orders").select("o_orderkey", pages.alias("pages"))
