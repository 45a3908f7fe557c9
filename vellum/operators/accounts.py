"""Plans, subscriptions, credits, quotas and access, from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.config import ADMIN_MB, CREDIT_MB, DAY, FREE_CHARS, FREE_MB, PLANS, PLAN_COLUMNS, SERVICE_MB
from vellum.functions.files import readable, writable


def catalogue(spark: SparkSession) -> DataFrame:
    """The plans, six rows."""
    return spark.createDataFrame(PLANS, PLAN_COLUMNS)


def with_plan(df: DataFrame, plan: str = "plan", columns: tuple[str, ...] = ("title", "kind", "price", "currency", "days", "daily_limit", "credits", "max_mb", "priority")) -> DataFrame:
    """df joined to columns of its plan; an unknown or missing plan counts as premium."""
    plans = catalogue(df.sparkSession).select("plan", *columns)
    known = [p[0] for p in PLANS]
    key = F.when(F.col(plan).isin(*known), F.col(plan)).otherwise("premium")
    return df.withColumn("_key", key).join(F.broadcast(plans.withColumnRenamed("plan", "_key")), "_key").withColumnRenamed("_key", "resolved_plan")


def rank(plan: Column) -> Column:
    """Order of tiers: those without a daily limit first, then by price. Packs of credits have none."""
    values = {p[0]: (1 if p[6] == 0 else 0) * 1_000_000 + p[3] for p in PLANS}
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), plan)


def _by_day(rows: DataFrame, order: list[str]) -> tuple:
    """rows with the day of at, and the windows over a user's day: up to a row, and before it."""
    w = Window.partitionBy("user_id", "day").orderBy(*order)
    past, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("day", F.floor(F.col("at") / DAY)), past, before


def subscriptions(payments: DataFrame) -> DataFrame:
    """(user_id, until, plan): each user's subscription after all payments, in the order of their times.

    payments: user_id, at (epoch seconds), id, plan, days. The same plan extends; another one adds its days and the
    higher tier stays. A lapsed subscription leaves nothing but its end. Stars are stored as premium, and so is a
    plan that is unknown or missing; missing days add nothing.

    until is the paid time so far plus the largest (start - time paid before it), so sums and maxima of a day are
    enough for the days after it: a task sorts one day of a user, and one row a day is composed afterwards.
    """
    key = F.when(F.col("plan").isin(*[p[0] for p in PLANS if p[0] != "stars"]), F.col("plan")).otherwise("premium")
    paid = (F.coalesce("days", F.lit(0)) * DAY).cast("long")
    rows, past, before = _by_day(payments.select("user_id", "at", "id", key.alias("plan"), paid.alias("paid")), ["at", "id", "plan", "paid"])
    rows = rows.withColumn("sum", F.sum("paid").over(past)).withColumn("lead", F.col("at") - F.col("sum") + F.col("paid"))
    rows = rows.withColumn("lead_before", F.max("lead").over(before)).withColumn("n", F.row_number().over(past))
    days = Window.partitionBy("user_id").orderBy("day")
    earlier = days.rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("user_id", "day").agg(F.sum("paid").alias("paid"), F.max("lead").alias("lead"))
    starts = starts.withColumn("base", F.coalesce(F.sum("paid").over(earlier), F.lit(0)))
    starts = starts.withColumn("best", F.greatest(F.lit(0), F.max(F.col("lead") - F.col("base")).over(earlier)))
    joined = rows.join(starts.select("user_id", "day", "base", "best"), ["user_id", "day"])
    held = F.col("base") + F.col("sum") - F.col("paid") + F.greatest("best", F.col("lead_before") - F.col("base"))
    joined = joined.withColumn("until", F.greatest("at", held) + F.col("paid")).withColumn("lapsed", held <= F.col("at"))
    joined = joined.withColumn("run", F.sum(F.col("lapsed").cast("int")).over(past))
    top = F.max(F.struct(rank(F.col("plan")).alias("rank"), "n", "plan"))
    runs = joined.groupBy("user_id", "day", "run").agg(top.alias("top"), F.max_by("until", "n").alias("until"))
    last = runs.groupBy("user_id", "day").agg(F.max("run").alias("run"), F.max_by("top", "run").alias("top"), F.max_by("until", "run").alias("until"))
    tier = F.struct("top.rank", "day", "top.plan")
    epoch = F.sum((F.col("run") > 0).cast("int")).over(days.rowsBetween(Window.unboundedPreceding, 0))
    tiers = last.select("user_id", "day", "until", tier.alias("tier"), epoch.alias("epoch")).groupBy("user_id", "epoch").agg(F.max("tier").alias("tier"), F.max_by("until", "day").alias("until"))
    return tiers.groupBy("user_id").agg(F.max_by("until", "epoch").alias("until"), F.max_by("tier.plan", "epoch").alias("plan"))


def ledger(events: DataFrame) -> DataFrame:
    """(user_id, balance, spent, refused): grants add, a spend takes one credit if there is one.

    events: user_id, at, id, delta (positive: a grant; -1: a spend; missing: nothing). Balances never fall below zero.

    What was refused is the deepest point of the sum without a floor, which a day gives by its own sum and minimum:
    a task sorts one day of a user, and one row a day is composed afterwards.
    """
    rows, past, _ = _by_day(events.select("user_id", "at", "id", F.coalesce("delta", F.lit(0)).alias("delta")), ["at", "id", "delta"])
    rows = rows.withColumn("sum", F.sum("delta").over(past))
    days = rows.groupBy("user_id", "day").agg(F.sum("delta").alias("sum"), F.min("sum").alias("low"), F.count_if(F.col("delta") < 0).alias("spends"))
    earlier = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("low", F.coalesce(F.sum("sum").over(earlier), F.lit(0)) + F.col("low"))
    total = days.groupBy("user_id").agg(F.sum("sum").alias("sum"), F.greatest(F.lit(0), -F.min("low")).alias("refused"), F.sum("spends").alias("spends"))
    return total.select("user_id", (F.col("sum") + F.col("refused")).alias("balance"), (F.col("spends") - F.col("refused")).alias("spent"), "refused")


def daily_usage(usage: DataFrame) -> DataFrame:
    """(user_id, day, files, chars, credit_files): files paid with a credit touch no daily counter."""
    own = ~F.col("credit")
    return usage.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.count_if(own).alias("files"), F.coalesce(F.sum(F.when(own, F.greatest(F.lit(0), F.col("chars")))), F.lit(0)).alias("chars"), F.count_if(~own).alias("credit_files")
    )


def quota_left(daily: DataFrame, free: int = FREE_CHARS) -> DataFrame:
    return daily.withColumn("left", F.greatest(F.lit(0), F.lit(free) - F.col("chars")))


def access(users: DataFrame, now: int) -> DataFrame:
    """Adds source, max_mb, priority and max_chars: what pays for the next file.

    users: is_admin, premium_until, plan, daily_used, daily_chars, credits. In order: admin, subscription with
    files left today, credit, free characters (only without a live subscription), blocked.
    """
    live = F.col("premium_until") > now
    df = with_plan(users, columns=("daily_limit", "max_mb", "priority"))
    sub = live & ((F.col("daily_limit") == 0) | (F.col("daily_used") < F.col("daily_limit")))
    left = F.greatest(F.lit(0), F.lit(FREE_CHARS) - F.col("daily_chars"))
    pick = lambda s, mb, p, c=0: F.struct(F.lit(s).alias("source"), (mb if isinstance(mb, Column) else F.lit(mb)).cast("long").alias("max_mb"), (p if isinstance(p, Column) else F.lit(p)).cast("int").alias("priority"), (c if isinstance(c, Column) else F.lit(c)).cast("long").alias("max_chars"))
    chosen = (
        F.when(F.col("is_admin"), pick("admin", ADMIN_MB, 0))
        .when(sub, pick("sub", F.col("max_mb"), F.col("priority")))
        .when(F.col("credits") > 0, pick("credit", CREDIT_MB, 1))
        .when(~live & (left > 0), pick("free", FREE_MB, 2, left))
        .otherwise(pick("blocked", 0, 9))
    )
    return df.select(*users.columns, chosen.alias("_a")).select(*users.columns, "_a.*")


def file_reason(ext: Column, source: Column, size: Column, max_mb: Column, busy: Column, open_now: Column, service_mb: int = SERVICE_MB, out: Column | None = None) -> Column:
    """Why a file is not taken: the code of the first rule that it breaks, null if it breaks none.

    In order: unsupported (kind of file), unavailable (kind of output), blocked (nothing pays for it), plan_limit and
    service_limit (bytes), busy (the user has a file in progress), offline (no service).
    """
    mega = 1 << 20
    rules = [
        ("unsupported", ~F.coalesce(readable(ext), F.lit(False))), ("unavailable", F.lit(False) if out is None else ~F.coalesce(writable(out), F.lit(False))),
        ("blocked", source == "blocked"), ("plan_limit", size > max_mb.cast("long") * mega), ("service_limit", size > service_mb * mega), ("busy", busy), ("offline", ~open_now),
    ]
    return F.coalesce(*[F.when(broken, code) for code, broken in rules])


def activation(payments: DataFrame) -> DataFrame:
    """Adds grant, granted_plan, granted_days and granted_credits: what a paid row gives; a plan that is gone gives
    premium days."""
    df = payments.select(*payments.columns, F.col("plan").alias("_p"), F.col("days").alias("_d"), F.col("units").alias("_u"))
    joined = with_plan(df.drop("days", "plan"), "_p")
    sub = F.col("kind") == "sub"
    out = joined.select(
        *[c for c in joined.columns if c in payments.columns and c not in ("days", "plan")],
        F.when(sub, "days").otherwise("credits").alias("grant"),
        F.when(sub, F.when(F.col("resolved_plan") == "stars", "premium").otherwise(F.col("resolved_plan"))).alias("granted_plan"),
        F.when(sub, F.when(F.coalesce("_d", F.lit(0)) > 0, F.col("_d")).otherwise(F.col("days"))).alias("granted_days"),
        F.when(~sub, F.when(F.coalesce("_u", F.lit(0)) > 0, F.col("_u")).otherwise(F.col("credits"))).alias("granted_credits"),
    )
    return out


def checkout_ok(payment: Column, user: Column, currency: Column, amount: Column) -> Column:
    """Whether a purchase may go through: its payment exists, is the user's, unpaid, in stars and of that amount."""
    return payment.isNotNull() & (payment["user_id"] == user) & (payment["status"] != "paid") & (currency == "XTR") & (amount == payment["amount"])


def updated(log: DataFrame, key: str, order: str, fields: list[str], floored: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the last value that an update gave to each field, null if none did; floored ones are 0 at least."""
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    found = log.groupBy(key).agg(*last)
    return found.select(key, *[F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0))).alias(c) if c in floored else c for c in fields])


def settings_under(settings: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """Settings whose name begins with the prefix, letter case and all, named by the rest."""
    return settings.where(F.col(name).startswith(prefix)).withColumn(name, F.substring(name, len(prefix) + 1, 1 << 30))


def latest(log: DataFrame, key: str, order: str, deleted: str | None = None) -> DataFrame:
    """Current rows of an append-only log: the last entry of each key, without those deleted."""
    rest = [c for c in log.columns if c not in (key, order)]
    found = log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")
    return found.where(~F.col(deleted)).drop(deleted) if deleted else found
