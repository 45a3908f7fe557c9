"""Queries over users, payments and usage, which stand on events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.config import DAY, FREE_CHARS, PLANS
from vellum.functions import text as T
from vellum.operators import accounts, packing
from vellum.sources import tables

QUERIES: dict = {}
SQL: dict = {}
NOW = 1_706_600_000

PLAN_ROWS = ", ".join(f"('{k}', '{t}', '{kind}', {price}, '{cur}', {days}, {limit}, {credits}, {mb}, {prio})" for k, t, kind, price, cur, days, limit, credits, mb, prio in PLANS)
PLAN_SQL = f"plans AS (SELECT * FROM (VALUES {PLAN_ROWS}) v(plan, title, kind, price, currency, days, daily_limit, credits, max_mb, priority))"
NAMES = ", ".join(f"'{p[0]}'" for p in PLANS)
PAY_SQL = f"""{PLAN_SQL}, pay AS (SELECT e.event_id AS id, e.user_id, epoch_us(e.ts) // 1000000 AS secs, p.plan, p.price AS amount, p.currency, p.days, p.credits AS units, p.kind,
  CASE WHEN e.event_id % 7 = 0 THEN 'created' ELSE 'paid' END AS status
  FROM events e JOIN plans p ON p.plan = ([{NAMES}])[CAST(e.event_id % {len(PLANS)} AS INTEGER) + 1] WHERE e.event_type = 'purchase')"""
RANK = "CASE {0} " + " ".join(f"WHEN '{p[0]}' THEN {(1 if p[6] == 0 else 0) * 1_000_000 + p[3]}" for p in PLANS) + " END"
SUB_SQL = f"""{PAY_SQL}, subs AS (SELECT user_id, secs, id, CASE WHEN plan = 'stars' THEN 'premium' ELSE plan END AS plan, days, row_number() OVER (PARTITION BY user_id ORDER BY secs, id) AS rn
  FROM pay WHERE status = 'paid' AND kind = 'sub'),
walk AS (SELECT user_id, rn, secs + days * {DAY} AS until, plan FROM subs WHERE rn = 1 UNION ALL
  SELECT s.user_id, s.rn, greatest(s.secs, w.until) + s.days * {DAY},
    CASE WHEN w.until > s.secs AND w.plan <> s.plan AND {RANK.format("s.plan")} < {RANK.format("w.plan")} THEN w.plan ELSE s.plan END
  FROM walk w JOIN subs s ON s.user_id = w.user_id AND s.rn = w.rn + 1),
ends AS (SELECT user_id, arg_max(until, rn) AS until, arg_max(plan, rn) AS plan FROM walk GROUP BY 1)"""
USE_SQL = """use AS (SELECT event_id, user_id, ts, CAST(floor(value * 1000) AS BIGINT) AS chars, event_id % 5 = 0 AS credit FROM events WHERE event_type IN ('click', 'view')),
daily AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (NOT credit) AS files, CAST(coalesce(sum(greatest(0, chars)) FILTER (NOT credit), 0) AS BIGINT) AS chars, count(*) FILTER (credit) AS credit_files FROM use GROUP BY ALL)"""
MOVES_SQL = f"""moves AS (SELECT user_id, secs, id, units AS delta FROM pay WHERE status = 'paid' AND kind = 'credits'
  UNION ALL SELECT user_id, epoch_us(ts) // 1000000, event_id, -1 FROM use WHERE credit),
steps AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY secs, id, delta) AS rn FROM moves),
fold AS (SELECT user_id, rn, CASE WHEN delta < 0 THEN 0 ELSE delta END AS balance, 0 AS spent, CASE WHEN delta < 0 THEN 1 ELSE 0 END AS refused FROM steps WHERE rn = 1 UNION ALL
  SELECT s.user_id, s.rn, CASE WHEN s.delta < 0 AND f.balance = 0 THEN 0 ELSE f.balance + s.delta END,
    f.spent + CASE WHEN s.delta < 0 AND f.balance > 0 THEN 1 ELSE 0 END, f.refused + CASE WHEN s.delta < 0 AND f.balance = 0 THEN 1 ELSE 0 END
  FROM fold f JOIN steps s ON s.user_id = f.user_id AND s.rn = f.rn + 1),
books AS (SELECT user_id, CAST(arg_max(balance, rn) AS BIGINT) AS balance, CAST(max(spent) AS BIGINT) AS spent, CAST(max(refused) AS BIGINT) AS refused FROM fold GROUP BY 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _paid(spark, sf_dir, kind):
    kinds = [p[0] for p in PLANS if p[2] == kind]
    return tables.payments(spark, sf_dir).where((F.col("status") == "paid") & F.col("plan").isin(*kinds))


def _moves(spark, sf_dir):
    grants = _paid(spark, sf_dir, "credits").select("user_id", "at", "id", F.col("units").alias("delta"))
    spends = tables.usage(spark, sf_dir).where("credit").select("user_id", T.epoch(F.col("ts")).alias("at"), F.col("event_id").alias("id"), F.lit(-1).cast("long").alias("delta"))
    return grants.unionByName(spends)


@query(f"WITH {PLAN_SQL} SELECT plan, title, kind, CAST(price AS BIGINT) AS price, currency, days::BIGINT AS days, daily_limit::BIGINT AS daily_limit, credits::BIGINT AS credits, max_mb::BIGINT AS max_mb, priority FROM plans")
def plan_catalogue(spark, sf_dir):
    return accounts.catalogue(spark)


@query(f"WITH {USE_SQL} SELECT * FROM daily")
def daily_usage(spark, sf_dir):
    return accounts.daily_usage(tables.usage(spark, sf_dir))


@query(f'WITH {USE_SQL} SELECT user_id, day, chars, greatest(0, {FREE_CHARS} - chars) AS "left" FROM daily')
def quota_left(spark, sf_dir):
    return accounts.quota_left(accounts.daily_usage(tables.usage(spark, sf_dir))).select("user_id", "day", "chars", "left")


@query(f"WITH RECURSIVE {SUB_SQL} SELECT user_id, CAST(until AS BIGINT) AS until, plan FROM ends")
def subscription_until(spark, sf_dir):
    return accounts.subscriptions(_paid(spark, sf_dir, "sub"))


@query(f"WITH RECURSIVE {PAY_SQL}, {USE_SQL}, {MOVES_SQL} SELECT * FROM books")
def credit_ledger(spark, sf_dir):
    return accounts.ledger(_moves(spark, sf_dir))


@query(f"""WITH RECURSIVE {SUB_SQL}, {USE_SQL}, {MOVES_SQL},
people AS (SELECT DISTINCT user_id FROM events),
state AS (SELECT u.user_id, u.user_id % 50 = 0 AS is_admin, coalesce(e.until, 0) AS until, coalesce(e.plan, 'premium') AS plan, coalesce(b.balance, 0) AS credits, coalesce(d.files, 0) AS files, coalesce(d.chars, 0) AS chars
  FROM people u LEFT JOIN ends e USING (user_id) LEFT JOIN books b USING (user_id) LEFT JOIN daily d ON d.user_id = u.user_id AND d.day = DATE '2024-01-30'),
s AS (SELECT st.*, p.daily_limit, p.max_mb, p.priority, st.until > {NOW} AS live FROM state st JOIN plans p ON p.plan = st.plan),
c AS (SELECT *, CASE WHEN is_admin THEN 'admin' WHEN live AND (daily_limit = 0 OR files < daily_limit) THEN 'sub' WHEN credits > 0 THEN 'credit' WHEN NOT live AND {FREE_CHARS} - chars > 0 THEN 'free' ELSE 'blocked' END AS source FROM s)
SELECT user_id, source, CAST(CASE source WHEN 'admin' THEN 200 WHEN 'sub' THEN max_mb WHEN 'credit' THEN 50 WHEN 'free' THEN 20 ELSE 0 END AS BIGINT) AS max_mb,
  CASE source WHEN 'admin' THEN 0 WHEN 'sub' THEN priority WHEN 'credit' THEN 1 WHEN 'free' THEN 2 ELSE 9 END AS priority, CAST(CASE source WHEN 'free' THEN {FREE_CHARS} - chars ELSE 0 END AS BIGINT) AS max_chars FROM c""")
def access_decision(spark, sf_dir):
    users = tables.load(spark, sf_dir, "events").select("user_id").distinct()
    subs = accounts.subscriptions(_paid(spark, sf_dir, "sub")).withColumnRenamed("until", "premium_until")
    books = accounts.ledger(_moves(spark, sf_dir)).select("user_id", F.col("balance").alias("credits"))
    today = accounts.daily_usage(tables.usage(spark, sf_dir)).where("day = date'2024-01-30'").select("user_id", F.col("files").alias("daily_used"), F.col("chars").alias("daily_chars"))
    state = users.join(subs, "user_id", "left").join(books, "user_id", "left").join(today, "user_id", "left").fillna(0, ["premium_until", "credits", "daily_used", "daily_chars"])
    state = state.withColumn("is_admin", F.col("user_id") % 50 == 0).select("user_id", "is_admin", "premium_until", "plan", "daily_used", "daily_chars", "credits")
    return accounts.access(state, NOW).select("user_id", "source", "max_mb", "priority", "max_chars")


@query(f"""WITH {PAY_SQL} SELECT id, user_id, CASE WHEN kind = 'sub' THEN 'days' ELSE 'credits' END AS "grant", CASE WHEN kind = 'sub' THEN CASE WHEN plan = 'stars' THEN 'premium' ELSE plan END END AS granted_plan,
  CAST(CASE WHEN kind = 'sub' THEN days END AS BIGINT) AS granted_days, CAST(CASE WHEN kind <> 'sub' THEN units END AS BIGINT) AS granted_credits FROM pay WHERE status = 'paid'""")
def payment_activation(spark, sf_dir):
    paid = tables.payments(spark, sf_dir).where("status = 'paid'").select("id", "user_id", "plan", "days", "units")
    return accounts.activation(paid).select("id", "user_id", "grant", "granted_plan", "granted_days", "granted_credits")


@query(f"""WITH {PAY_SQL}, tries AS (SELECT id, user_id, status, currency, amount, id % 3 AS twist FROM pay)
SELECT id, twist <> 1 AND status <> 'paid' AND currency = 'XTR' AND twist <> 2 AS ok FROM tries""")
def checkout_validity(spark, sf_dir):
    """Checkouts of each payment, a third with another user and a third with another amount."""
    tries = tables.payments(spark, sf_dir).select("id", F.struct("user_id", "status", "amount").alias("p"), "currency", (F.col("id") % 3).alias("twist"))
    user = F.col("p.user_id") + F.when(F.col("twist") == 1, 1).otherwise(0)
    amount = F.col("p.amount") + F.when(F.col("twist") == 2, 1).otherwise(0)
    return tries.select("id", accounts.checkout_ok(F.col("p"), user, F.col("currency"), amount).alias("ok"))


@query("""WITH last AS (SELECT user_id, arg_max(event_type, struct_pack(t := epoch_us(ts), i := event_id)) AS setting FROM events GROUP BY 1) SELECT * FROM last WHERE setting <> 'error'""")
def latest_settings(spark, sf_dir):
    """Current settings of a log in which errors delete."""
    log = tables.load(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("setting"), (F.col("event_type") == "error").alias("gone"))
    return accounts.latest(log, "user_id", "at", "gone")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'error' WHEN c_acctbal = 0 THEN NULL WHEN CAST(floor(c_acctbal) AS BIGINT) < 512 THEN 'error' WHEN CAST(floor(c_acctbal) AS BIGINT) > 9000 THEN 'error' ELSE 'ok' END AS verdict FROM customer""")
def split_validation(spark, sf_dir):
    """Balances as wished part sizes in KB, between 512 and 9000."""
    kb = F.when(F.col("c_acctbal").between(0.001, 1), 1).otherwise(F.floor("c_acctbal")).cast("long")
    return tables.load(spark, sf_dir, "customer").select("c_custkey", packing.split_size(kb, 9000).alias("verdict"))
