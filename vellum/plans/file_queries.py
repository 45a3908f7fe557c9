"""Queries of file rules, messages, pages and splits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum import shared
from vellum.functions import files, messages
from vellum.functions import text as T
from vellum.operators import accounts, cleanup, layout, packing, service, structure
from vellum.plans.service_queries import JOBS
from vellum.plans.text_queries import LINES, W
from vellum.sources import logs, tables

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _dealt(n: Column, values: list) -> Column:
    """One of the values, in turn."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '.epub' WHEN 1 THEN '.txt' WHEN 4 THEN '.htm' WHEN 5 THEN '.md' ELSE CASE doc_id % 4 WHEN 1 THEN '.pdf' WHEN 2 THEN '.html' END END AS format FROM documents""")
def detect_format(spark, sf_dir):
    """Documents with names and media types of all sorts."""
    n = F.col("doc_id")
    name = F.concat(F.lit("doc"), n.cast("string"), _dealt(n, [".EPUB", ".txt", "", ".doc", ".tar.htm", ".md"]))
    media = _dealt(n, [None, " Application/PDF ", "text/html; charset=utf-8", "application/msword"])
    return tables.load(spark, sf_dir, "documents").select("doc_id", files.detect_format(name, media).alias("format"))


KINDS = "['epub', 'pdf', 'docx', 'txt', 'txt', 'html', 'html', 'html']"


@query(f"""SELECT doc_id, {KINDS}[doc_id % 8 + 1] = {KINDS}[doc_id // 8 % 8 + 1] AS same, ['EPUB', 'PDF', 'DOCX', 'TXT', 'Markdown', 'HTML', 'HTML', 'XHTML'][doc_id % 8 + 1] AS label FROM documents""")
def same_kind(spark, sf_dir):
    """Pairs of extensions."""
    exts = [".epub", ".pdf", ".docx", ".txt", ".md", ".html", ".htm", ".xhtml"]
    a, b = _dealt(F.col("doc_id"), exts), _dealt(F.floor(F.col("doc_id") / 8), exts)
    return tables.load(spark, sf_dir, "documents").select("doc_id", files.same_kind(a, b).alias("same"), files.label_of(a).alias("label"))


@query("""SELECT doc_id, octet_length(encode(coalesce(text, ''))) + doc_id % 5 > 0 AND CASE doc_id % 3 WHEN 0 THEN doc_id % 5 = 1 WHEN 1 THEN doc_id % 5 IN (2, 4) ELSE TRUE END AS ok FROM documents""")
def sniffed_ok(spark, sf_dir):
    """Documents behind the first bytes of packages and of nothing in particular."""
    n = F.col("doc_id")
    data = F.encode(F.concat(_dealt(n, ["", "PK\x03\x04", " %PDF-1.4", "PK", "%PDF-"]), F.coalesce("text", F.lit(""))), "UTF-8")
    return tables.load(spark, sf_dir, "documents").select("doc_id", T.sniffed_ok(_dealt(n, ["epub", "pdf", "txt"]), data).alias("ok"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * 1048576 WHEN 3 THEN p_size * 1024 WHEN 5 THEN p_size WHEN 6 THEN p_size * 1024 + 512 END AS kb FROM part""")
def size_parse(spark, sf_dir):
    """Sizes of parts in all spellings."""
    text = F.concat(F.lit(" "), F.col("p_size").cast("string"), _dealt(F.col("p_partkey"), ["kb", " MB", "G", "", " TB", " k ", ",5mb"]))
    return tables.load(spark, sf_dir, "part").select("p_partkey", T.parse_size_kb(text).alias("kb"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'OEBPS/images/a ' || p_size || '.png' WHEN 1 THEN 'OEBPS/text/' || p_size || '.html' WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE 'OEBPS/text/b+' || p_size || '.html' END AS path FROM part""")
def path_normalise(spark, sf_dir):
    """Links of all forms from a page of a package."""
    size = F.col("p_size").cast("string")
    href = F.element_at(F.array(F.concat(F.lit("../images/a%20"), size, F.lit(".png#x")), F.concat(F.lit("./x/../"), size, F.lit(".html")), F.concat(F.lit("../../"), size), F.concat(F.lit("b+"), size, F.lit(".html"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return tables.load(spark, sf_dir, "part").select("p_partkey", files.normal_path(F.lit("OEBPS/text"), href).alias("path"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'https://w' || s_suppkey || '.example.com' WHEN 1 THEN 'http://localhost:80' || s_suppkey % 10 WHEN 2 THEN 'https://nodot' ELSE 'HTTPS://a.b/x y' END AS url, s_suppkey % 4 < 2 AS valid FROM supplier""")
def worker_url(spark, sf_dir):
    """Addresses of workers as people type them."""
    k = F.col("s_suppkey")
    typed = F.element_at(F.array(F.concat(F.lit(" <w"), k.cast("string"), F.lit(".example.com/> ")), F.concat(F.lit("http://localhost:80"), (k % 10).cast("string"), F.lit("/")), F.lit("nodot//"), F.lit("HTTPS://a.b/x y")), (k % 4 + 1).cast("int"))
    url = files.worker_url(typed)
    return tables.load(spark, sf_dir, "supplier").select("s_suppkey", url.alias("url"), files.valid_worker(url).alias("valid"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.gif' WHEN 3 THEN '.svg' WHEN 4 THEN '.bmp' ELSE CASE WHEN doc_id % 4 = 1 THEN '.jpg' ELSE '.bin' END END AS ext,
  CASE doc_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/svg+xml' WHEN 4 THEN 'image/bmp' ELSE CASE WHEN doc_id % 4 = 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END END AS mime FROM documents""")
def image_type(spark, sf_dir):
    """Documents behind the first bytes of pictures; some have a hint instead."""
    n = F.col("doc_id")
    data = F.concat(F.unhex(_dealt(n, ["89504E47", "FFD8", "47494638", "3C737667", "424D", "2E"])), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    found = files.image_type(data, F.when(n % 4 == 1, ".JPEG"))
    return tables.load(spark, sf_dir, "documents").select("doc_id", found["ext"].alias("ext"), found["mime"].alias("mime"))


@query("""SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY ALL""")
def first_seen(spark, sf_dir):
    """First turn of each role."""
    return structure.first_seen(tables.load(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ["conv_id"], "role", "turn")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN repeat(event_type, 60) WHEN 1 THEN left(repeat(event_type, 60), 300) WHEN 4 THEN 'This file needs more memory than there is at the moment.' WHEN 5 THEN 'Something went wrong. Another try later may succeed.'
  ELSE 'This file cannot be read as a document.' END AS reason FROM events""")
def failure_reason(spark, sf_dir):
    """Events as failures of all kinds."""
    kind = _dealt(F.col("event_id"), ["quota", "translation", "zip", "value", "memory", "other"])
    return tables.load(spark, sf_dir, "events").select("event_id", messages.failure_reason(kind, F.repeat("event_type", F.lit(60))).alias("reason"))


@query("""SELECT p_partkey, NOT (p_partkey % 2 = 0 AND p_size % 3 > 0 AND p_size > 25) AS may_buy, p_partkey % 3 <> 2 AS member FROM part""")
def gates(spark, sf_dir):
    """Parts as purchases by members, others and people who cannot be told."""
    c = F.col
    bought = messages.may_buy(F.when(c("p_partkey") % 2 == 0, "sub").otherwise("credits"), c("p_size") % 3, c("p_size") > 25)
    return tables.load(spark, sf_dir, "part").select("p_partkey", bought.alias("may_buy"), messages.member(_dealt(c("p_partkey"), [None, True, False])).alias("member"))


@query("""SELECT doc_id, CASE WHEN n_chars >= 1000000 THEN replace(printf('%.1fM', n_chars / 1e6), '.0M', 'M') WHEN n_chars >= 1000 THEN CAST(n_chars // 1000 AS VARCHAR) || 'k' ELSE CAST(n_chars AS VARCHAR) END || ' of 1M characters are left for today' AS line FROM documents""")
def quota_line(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents")
    return docs.select("doc_id", messages.quota_line(F.col("n_chars"), 1_000_000).alias("line"))


@query(rf"""SELECT page_id, regexp_matches(html, '(?i)<nav[ >]') AS has_nav, regexp_matches(html, '(?i)<a[ >]') AS has_link, len(regexp_extract_all(html, '(?i)<(?:li|a|p)[ >]')) AS n_lines,
  trim(regexp_replace(replace(replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '&quot;', '"'), '&amp;', '&'), '{W}+', ' ', 'g')) AS heading FROM pages""")
def page_facts(spark, sf_dir):
    """What the page classifiers look at."""
    pages = tables.pages(spark, sf_dir).select("page_id", F.col("page_id").cast("string").alias("path"), F.lit(0).alias("spine_ix"), "html")
    return cleanup.page_facts(pages).select("page_id", "has_nav", "has_link", "n_lines", "heading")


@query(f"""WITH {JOBS} SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 > 0 AND s_acctbal > 0) AS available FROM jobs""")
def service_load(spark, sf_dir):
    """Suppliers as workers."""
    workers = tables.load(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5 > 0).alias("enabled"), (F.col("s_acctbal") > 0).alias("healthy"))
    return service.load(tables.jobs(spark, sf_dir), workers)


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN event_id + 60 WHEN event_type = 'view' THEN event_id + 15 WHEN user_id % 8 >= 5 THEN event_id + 120 END AS until FROM events""")
def cool_down(spark, sf_dir):
    """Errors as failed pings, views as busy replies, and runs of failures by user."""
    kind = F.when(F.col("event_type") == "error", "ping").when(F.col("event_type") == "view", "busy").otherwise("other")
    return tables.load(spark, sf_dir, "events").select("event_id", service.cool_until(kind, F.col("user_id") % 8, F.col("event_id")).alias("until"))


@query("""WITH s AS (SELECT p_partkey, p_size * 40.0::DOUBLE AS w, p_retailprice::DOUBLE AS h FROM part), f AS (SELECT *, least(600.0::DOUBLE / w, 800.0::DOUBLE / h, 1.0) AS scale FROM s)
SELECT p_partkey, greatest(CAST(floor(w * scale) AS BIGINT), 1) AS width, greatest(CAST(floor(h * scale) AS BIGINT), 1) AS height FROM f""")
def image_fit(spark, sf_dir):
    """Parts as pictures in a frame of 600 by 800."""
    fit = layout.fitted((F.col("p_size") * 40).cast("double"), F.col("p_retailprice").cast("double"), 600, 800)
    return tables.load(spark, sf_dir, "part").select("p_partkey", fit["width"].alias("width"), fit["height"].alias("height"))


@query("""WITH a AS (SELECT lang, sum(octet_length(encode(html))) AS image_bytes FROM (SELECT ['en', 'de', 'fr'][page_id % 3 + 1] AS lang, html FROM pages) GROUP BY 1), b AS (SELECT lang, sum(length(text)) AS chars FROM documents GROUP BY 1)
SELECT lang, CAST(coalesce(image_bytes, 0) AS BIGINT) AS image_bytes, CAST(coalesce(chars, 0) AS BIGINT) AS chars FROM a FULL JOIN b USING (lang)""")
def book_sizes(spark, sf_dir):
    """Pages as images of books, documents of a language as chapters."""
    images = tables.load(spark, sf_dir, "pages").select(_dealt(F.col("page_id"), ["en", "de", "fr"]).alias("lang"), F.encode("html", "UTF-8").alias("data"))
    return structure.book_sizes(images, tables.load(spark, sf_dir, "documents").select("lang", "text"), "lang")


@query(f"""WITH {LINES}, m AS (SELECT doc_id, max(octet_length(encode(line))) AS longest, count(*) AS n FROM lines GROUP BY 1)
SELECT doc_id, CASE WHEN n > 1 AND longest > 2048 THEN 'no part can be smaller than ' || longest || ' bytes' END AS error FROM m""")
def split_errors(spark, sf_dir):
    """Documents that cannot be split into parts of 2 KB."""
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    return packing.split_texts(docs, 2048, least=1024).groupBy("doc_id").agg(F.max("error").alias("error"))


@query()
def split_chapter_parts(spark, sf_dir):
    """Conversations as books of turns, a line of a turn as a block, in parts of about 8 KB."""
    turns = tables.load(spark, sf_dir, "conversations")
    chapters = turns.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("ch"), "role", T.lines(F.coalesce("text", F.lit(""))).alias("blocks"), F.lit(0).cast("long").alias("media"))
    return packing.split_chapters(chapters.withColumnRenamed("role", "title"), 8192, css=300)


@query("""SELECT page_id, left(sha1(url), 10) AS short FROM pages""")
def short_ids(spark, sf_dir):
    return tables.load(spark, sf_dir, "pages").select("page_id", files.short_id(F.col("url")).alias("short"))


@query("""SELECT doc_id, md5(left(text, 150)) AS head, md5(right(text, 120)) AS tail FROM documents""")
def clipped_texts(spark, sf_dir):
    text = F.col("text")
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.md5(T.clipped(text, 150)).alias("head"), F.md5(T.tail(text, 120)).alias("tail"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 10, doc_id) AS ix FROM documents WHERE doc_id % 4 < 2""")
def image_order(spark, sf_dir):
    """Documents as pictures of a package for each language, named by last digits, half of them of other kinds."""
    n = F.col("doc_id")
    name = F.concat((n % 10).cast("string"), F.format_string("%012d", n), _dealt(n, [".PNG", ".jpeg", ".txt", ""]))
    found = structure.image_order(tables.load(spark, sf_dir, "documents").select("doc_id", "lang", name.alias("name")), ["lang"])
    return found.select("doc_id", F.col("ix").cast("long").alias("ix"))


@query("""SELECT p_partkey, substr(name, 5) AS name FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'lim_' WHEN 1 THEN 'limX' ELSE 'LIM_' END || p_size AS name FROM part) WHERE p_partkey % 3 = 0""")
def settings_under(spark, sf_dir):
    """Parts as settings."""
    settings = tables.load(spark, sf_dir, "part").select("p_partkey", F.concat(_dealt(F.col("p_partkey"), ["lim_", "limX", "LIM_"]), F.col("p_size").cast("string")).alias("name"))
    return accounts.settings_under(settings, "lim_")


@query("""WITH log AS (SELECT user_id, struct_pack(t := epoch_us(ts), i := event_id) AS moment, CASE WHEN event_id % 3 = 0 THEN event_type END AS lang, CASE WHEN event_id % 3 = 1 THEN event_id % 40 - 20 END AS credits FROM events)
SELECT user_id, arg_max(lang, moment) FILTER (lang IS NOT NULL) AS lang, greatest(0, arg_max(credits, moment) FILTER (credits IS NOT NULL)) + CASE WHEN max(credits) IS NULL THEN NULL ELSE 0 END AS credits FROM log GROUP BY 1""")
def field_updates(spark, sf_dir):
    """Events as updates of one field each."""
    n = F.col("event_id")
    log = tables.load(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(n % 3 == 0, F.col("event_type")).alias("lang"), F.when(n % 3 == 1, n % 40 - 20).alias("credits"))
    return accounts.updated(log, "user_id", "at", ["lang", "credits"], floored=("credits",))


@query("""WITH f AS (SELECT event_id, lower(regexp_extract(['a.epub', 'b.PDF', 'c.docx', 'd.zip', 'e.md'][1 + event_id % 5], '(\\.[^.]+)$', 1)) AS ext, ['.txt', '.pdf', '.epub', '.docx'][1 + user_id % 4] AS wanted,
  CASE WHEN user_id % 9 = 0 THEN 'blocked' WHEN user_id % 2 = 0 THEN 'sub' ELSE 'free' END AS source, CAST(floor(value * 1048576) AS BIGINT) AS size, event_type FROM events)
SELECT event_id, CASE WHEN ext NOT IN ('.epub', '.docx', '.txt', '.md', '.html', '.htm', '.xhtml') THEN 'unsupported' WHEN wanted = '.pdf' THEN 'unavailable' WHEN source = 'blocked' THEN 'blocked'
  WHEN size > CASE source WHEN 'sub' THEN 200 ELSE 20 END * 1048576 THEN 'plan_limit' WHEN size > 50 * 1048576 THEN 'service_limit' WHEN event_type = 'view' THEN 'busy' WHEN event_type = 'error' THEN 'offline' END AS reason FROM f""")
def file_reasons(spark, sf_dir):
    """Events as files sent: what stands against each of them first."""
    events = tables.load(spark, sf_dir, "events")
    ext = files.extension(_dealt(F.col("event_id"), ["a.epub", "b.PDF", "c.docx", "d.zip", "e.md"]))
    source = F.when(F.col("user_id") % 9 == 0, "blocked").when(F.col("user_id") % 2 == 0, "sub").otherwise("free")
    sent = events.select("event_id", "event_type", ext.alias("ext"), _dealt(F.col("user_id"), [".txt", ".pdf", ".epub", ".docx"]).alias("wanted"), source.alias("source"), F.floor(F.col("value") * 1048576).alias("size"))
    most = F.when(F.col("source") == "sub", 200).otherwise(20)
    reason = accounts.file_reason(F.col("ext"), F.col("source"), F.col("size"), most, F.col("event_type") == "view", F.col("event_type") != "error", service_mb=50, out=F.col("wanted"))
    return sent.select("event_id", reason.alias("reason"))


@query("""WITH log AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE event_type END AS kind, CASE WHEN event_id % 3 = 2 THEN value END AS value FROM events),
last AS (SELECT user_id, max(event_id) AS event_id FROM log GROUP BY user_id)
SELECT log.user_id, log.event_id, kind, value FROM log JOIN last USING (event_id)""")
def schema_log(spark, sf_dir):
    """Events as a log in three versions of its schema, each with a column more, compacted to a user's last row."""
    events = tables.load(spark, sf_dir, "events")
    kept = (["event_id", "user_id", "ts"], ["kind"], ["value"])
    at, to = shared.folder(spark), shared.folder(spark)
    columns: list[str] = []
    for version, more in enumerate(kept):
        columns += more
        logs.append(events.where(F.col("event_id") % 3 == version).withColumnRenamed("event_type", "kind").select(*columns), at, version)
    logs.compact(spark, at, to, "user_id", "event_id", defaults={"kind": "unknown"})
    return logs.read(spark, to).select("user_id", "event_id", "kind", "value")


@query("""WITH d AS (SELECT doc_id, n_chars, ['.epub', '.txt', '.md', '.xyz', ''][1 + doc_id % 5] AS own, ['', '.txt', '.docx', '.html'][1 + n_chars % 4] AS wanted FROM documents),
l AS (SELECT *, CASE own WHEN '.epub' THEN 'EPUB' WHEN '.txt' THEN 'TXT' WHEN '.md' THEN 'Markdown' WHEN '.xyz' THEN 'XYZ' ELSE '' END AS own_label, CASE wanted WHEN '.txt' THEN 'TXT' WHEN '.docx' THEN 'DOCX' WHEN '.html' THEN 'HTML' END AS wanted_label,
  wanted = '' OR (own IN ('.txt', '.md') AND wanted = '.txt') AS same FROM d)
SELECT doc_id, CASE WHEN same AND own <> '' THEN own_label || ' (same as input)' WHEN same THEN 'same as input' ELSE wanted_label END AS output,
  CASE WHEN n_chars - 500 <= 0 THEN 'no split' WHEN n_chars - 500 >= 1024 THEN '≤ ' || printf('%.1f', round_even((n_chars - 500) / 1024.0, 1)) || ' MB per file' ELSE '≤ ' || (n_chars - 500) || ' KB per file' END AS split FROM l""")
def output_labels(spark, sf_dir):
    """What is said of outputs and splits; sizes of documents as KB of parts."""
    docs = tables.load(spark, sf_dir, "documents")
    own, wanted = _dealt(F.col("doc_id"), [".epub", ".txt", ".md", ".xyz", ""]), _dealt(F.col("n_chars"), ["", ".txt", ".docx", ".html"])
    return docs.select("doc_id", files.output_label(wanted, own).alias("output"), T.split_label(F.col("n_chars") - 500).alias("split"))


@query(f"""WITH {LINES}, b AS (SELECT doc_id, (pos // 8) AS k, body FROM (SELECT doc_id, body, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM segs))
SELECT doc_id, CAST(k AS INTEGER) AS k, count(*) AS n, md5(string_agg(body, '|' ORDER BY body)) AS md5 FROM b GROUP BY ALL""")
def chunked_segments(spark, sf_dir):
    """Segments of documents in rows of eight."""
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", F.transform(F.filter(T.lines(F.col("text")), lambda x: T.translatable(x)), lambda x: T.trim(x)).alias("s"))
    rows = docs.select("doc_id", F.posexplode(T.chunked(F.col("s"), 8)).alias("k", "row"))
    return rows.select("doc_id", "k", F.size("row").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("row"), "|")).alias("md5"))
