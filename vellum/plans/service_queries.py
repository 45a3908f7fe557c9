"""Queries over jobs, queues and endpoints, which stand on orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import accounts, service, structure
from vellum.plans.account_queries import NOW, PAY_SQL, SUB_SQL, USE_SQL, MOVES_SQL, _moves, _paid
from vellum.functions import text as T
from vellum.sources import tables

QUERIES: dict = {}
SQL: dict = {}
JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status,
  CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END AS priority, o_orderdate AS created, CAST(floor(o_totalprice) AS BIGINT) AS chars FROM orders)"""
PINGS = "pings AS (SELECT event_id AS id, user_id % 6 AS endpoint, ts, event_type <> 'error' AS ok, value / 10 AS latency FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH RECURSIVE {SUB_SQL}, {USE_SQL}, {MOVES_SQL}, {JOBS},
people AS (SELECT user_id, min(epoch_us(ts) // 1000000) AS joined FROM events GROUP BY 1)
SELECT (SELECT count(*) FROM people) AS users, (SELECT count(*) FROM ends WHERE until > {NOW}) AS premium, (SELECT CAST(coalesce(sum(balance), 0) AS BIGINT) FROM books) AS credits_out,
  (SELECT count(*) FROM people WHERE user_id % 50 = 0) AS banned, (SELECT count(*) FROM people WHERE joined > {NOW} - 86400) AS today_users,
  (SELECT count(*) FROM jobs) AS jobs_total, (SELECT count(*) FROM jobs WHERE status = 'done') AS jobs_done, (SELECT count(*) FROM jobs WHERE status = 'failed') AS jobs_failed,
  (SELECT CAST(coalesce(sum(chars), 0) AS BIGINT) FROM jobs WHERE status = 'done') AS chars, (SELECT count(*) FROM pay WHERE status = 'paid') AS payments,
  (SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) FROM pay WHERE status = 'paid' AND currency <> 'XTR') AS revenue, (SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) FROM pay WHERE status = 'paid' AND currency = 'XTR') AS stars""")
def stats_dashboard(spark, sf_dir):
    people = tables.load(spark, sf_dir, "events").groupBy("user_id").agg(F.min(T.epoch(F.col("ts"))).alias("joined"))
    subs = accounts.subscriptions(_paid(spark, sf_dir, "sub")).select("user_id", F.col("until").alias("premium_until"))
    books = accounts.ledger(_moves(spark, sf_dir)).select("user_id", F.col("balance").alias("credits"))
    users = people.join(subs, "user_id", "left").join(books, "user_id", "left").withColumn("banned", F.col("user_id") % 50 == 0)
    return service.dashboard(users, tables.jobs(spark, sf_dir), tables.payments(spark, sf_dir), NOW)


@query(f"WITH {JOBS} SELECT id, row_number() OVER (ORDER BY priority, created, id) AS position FROM jobs WHERE status = 'queued'")
def queue_position(spark, sf_dir):
    return service.queue_positions(tables.jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT id, user_id, priority, chars FROM jobs WHERE status = 'queued' ORDER BY priority, created, id LIMIT 40")
def queue_top40(spark, sf_dir):
    return service.queue_top(tables.jobs(spark, sf_dir)).select("id", "user_id", "priority", "chars")


@query(f"""WITH {PINGS}, r AS (SELECT endpoint, latency, row_number() OVER (PARTITION BY endpoint ORDER BY ts, id) AS i, count(*) OVER (PARTITION BY endpoint) AS n FROM pings WHERE ok)
SELECT endpoint, round(sum(latency * (CASE WHEN i = 1 THEN 1 ELSE 0.3 END) * pow(0.7, n - i)), 6) AS latency, max(n) AS n FROM r GROUP BY 1""")
def latency_ema(spark, sf_dir):
    return service.ema(tables.pings(spark, sf_dir)).select("endpoint", F.round("latency", 6).alias("latency"), "n")


@query(f"""WITH {PINGS}, r AS (SELECT endpoint, ok, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint ORDER BY ts, id) AS run FROM pings),
runs AS (SELECT endpoint, run, count(*) FILTER (NOT ok) AS n FROM r GROUP BY ALL)
SELECT endpoint, arg_max(n, run) AS fails, max(n) AS longest, count(*) FILTER (n >= 3) AS trips FROM runs GROUP BY 1""")
def breaker_state(spark, sf_dir):
    return service.breaker(tables.pings(spark, sf_dir), limit=3)


@query("""WITH s AS (SELECT n_regionkey AS region, n_nationkey AS endpoint, n_nationkey % 3 AS inflight, 1 + n_nationkey % 2 AS capacity, n_nationkey / 4.0 AS latency FROM nation)
SELECT region, arg_min(endpoint, struct_pack(f := CASE WHEN inflight >= capacity THEN 1 ELSE 0 END, s := inflight / greatest(capacity, 1) + least(latency, 5.0) / 10, a := endpoint)) AS endpoint FROM s GROUP BY 1""")
def pick_endpoint(spark, sf_dir):
    """Nations as endpoints of their regions."""
    n = F.col("n_nationkey")
    state = tables.load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), n.alias("endpoint"), (n % 3).alias("inflight"), (1 + n % 2).alias("capacity"), (n / 4.0).alias("latency"), n.alias("added"))
    return service.pick_endpoint(state, "region")


@query("""SELECT l_orderkey, l_linenumber, CAST(floor(100 * l_linenumber / greatest(7, 1)) AS INTEGER) AS percent, CAST(floor(l_extendedprice / greatest(l_quantity, 1) / 1000) AS BIGINT) AS rate,
  CAST(floor(l_quantity / l_linenumber * (7 - l_linenumber)) AS BIGINT) AS "left" FROM lineitem""")
def progress_metrics(spark, sf_dir):
    p = service.progress(F.col("l_linenumber"), F.lit(7), F.col("l_extendedprice"), F.col("l_quantity"))
    return tables.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query("""WITH last AS (SELECT user_id AS job_id, arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'running' END, struct_pack(t := epoch_us(ts), i := event_id)) AS status, bool_or(event_id % 4 = 0) AS credit FROM events GROUP BY 1)
SELECT job_id, status, credit, credit AND status IN ('failed', 'cancelled') AS refund FROM last""")
def job_lifecycle(spark, sf_dir):
    """Users as jobs, their events as status changes."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "done").when(kind == "error", "failed").when(kind == "signup", "cancelled").otherwise("running")
    log = tables.load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_id") % 4 == 0).alias("credit"))
    return service.job_states(log)


@query(f"WITH {JOBS} SELECT CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, count(*) AS jobs FROM jobs GROUP BY 1")
def crash_recovery(spark, sf_dir):
    return service.recover(tables.jobs(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("jobs"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 401 WHEN o_orderkey % 5 = 0 THEN 200 WHEN o_totalprice > 300000 OR o_custkey % 500 > 400 THEN 413 ELSE 200 END AS code FROM orders""")
def request_status(spark, sf_dir):
    """Orders as requests: customers as items, a tenth of the price as characters."""
    items = F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(F.greatest(F.col("o_custkey") % 500, F.lit(1)))
    code = service.request_status(F.col("o_custkey") % 11 != 0, items, F.col("o_totalprice") / 10)
    return tables.load(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, doc_id % 11 AS k FROM documents),
p AS (SELECT *, k NOT IN (0, 1, 2) AS parsed, CASE WHEN k < 3 THEN 0 WHEN k = 3 THEN 500 WHEN k = 4 THEN 0 ELSE 2 END AS n_items FROM d)
SELECT doc_id, parsed, n_items, CASE WHEN k < 3 OR k = 4 OR trim(lang) = '' THEN 'hi' ELSE lang END AS lang,
  CASE WHEN doc_id % 13 = 0 THEN 404 WHEN doc_id % 7 = 0 THEN 401 WHEN NOT parsed THEN 422 WHEN n_items = 500 OR (n_items = 2 AND length(text) + 1 > 30000) THEN 413 ELSE 200 END AS code FROM p""")
def request_bodies(spark, sf_dir):
    """Documents as JSON bodies: two texts, 500, none, or no object at all."""
    k, text = F.col("doc_id") % 11, F.coalesce(F.col("text"), F.lit(""))
    texts = F.when(k == 3, F.array_repeat(F.lit("a"), 500)).otherwise(F.array(text, F.lit("b")))
    body = F.when(k == 0, "no json {").when(k == 1, "[1, 2]").when(k == 2, "null").when(k == 4, '{"text_list": 7}').otherwise(F.to_json(F.struct(texts.alias("text_list"), "lang")))
    asked = service.requests(tables.load(spark, sf_dir, "documents").select("doc_id", body.alias("body")))
    n_chars = F.aggregate("texts", F.lit(0), lambda a, t: a + F.length(t))
    code = service.request_status(F.col("doc_id") % 7 != 0, F.size("texts"), n_chars, F.col("doc_id") % 13 != 0, F.col("parsed"))
    return asked.select("doc_id", "parsed", F.size("texts").alias("n_items"), "lang", code.alias("code"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR c_acctbal < 0 THEN 'cancelled' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'running' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'""")
def job_starts(spark, sf_dir):
    """Open orders as jobs whose turn has come; customers in debt are banned."""
    users = tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") < 0).alias("banned"))
    jobs = tables.load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey").join(users, "o_custkey")
    return jobs.select("o_orderkey", service.start_state(F.col("o_orderkey") % 7 == 0, F.col("banned"), F.col("o_orderkey") % 5 != 0).alias("status"))


@query("""WITH a AS (SELECT s_suppkey AS url, s_suppkey % 2 = 0 AS want FROM supplier WHERE s_suppkey % 3 <> 0), b AS (SELECT s_suppkey AS url, s_suppkey % 5 = 0 AS have FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT coalesce(a.url, b.url) AS url, CASE WHEN have IS NULL THEN 'add' WHEN want IS NULL THEN 'remove' WHEN want AND NOT have THEN 'enable' WHEN NOT want AND have THEN 'disable' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.url = b.url""")
def worker_reconcile(spark, sf_dir):
    """Suppliers as stored and live workers."""
    s = tables.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("url"))
    stored = s.where("url % 3 != 0").withColumn("enabled", F.col("url") % 2 == 0)
    return service.reconcile(stored, s.where("url % 7 != 0").withColumn("enabled", F.col("url") % 5 == 0))


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def unused_media(spark, sf_dir):
    """Parts that no large order uses, as media that no kept slice uses."""
    used = tables.load(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return structure.unused(tables.load(spark, sf_dir, "part").select("p_partkey"), used, "p_partkey")
