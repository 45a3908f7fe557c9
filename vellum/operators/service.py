"""Queues, jobs, endpoint health and the dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import COOL_BUSY, COOL_FAILS, COOL_PING, FAILS, REQUEST_CHARS, REQUEST_ITEMS
from vellum.functions.text import trim


def dashboard(users: DataFrame, jobs: DataFrame, payments: DataFrame, now: int) -> DataFrame:
    """One row of totals; each table is read once."""
    u = users.agg(
        F.count("*").alias("users"), F.count_if(F.col("premium_until") > now).alias("premium"), F.coalesce(F.sum("credits"), F.lit(0)).alias("credits_out"),
        F.count_if("banned").alias("banned"), F.count_if(F.col("joined") > now - 86400).alias("today_users"),
    )
    done = F.col("status") == "done"
    j = jobs.agg(F.count("*").alias("jobs_total"), F.count_if(done).alias("jobs_done"), F.count_if(F.col("status") == "failed").alias("jobs_failed"), F.coalesce(F.sum(F.when(done, F.col("chars"))), F.lit(0)).alias("chars"))
    paid, stars = F.col("status") == "paid", F.coalesce("currency", F.lit("INR")) == "XTR"
    p = payments.agg(F.count_if(paid).alias("payments"), F.coalesce(F.sum(F.when(paid & ~stars, F.col("amount"))), F.lit(0)).alias("revenue"), F.coalesce(F.sum(F.when(paid & stars, F.col("amount"))), F.lit(0)).alias("stars"))
    return reduce(lambda a, b: a.join(b), (u, j, p))  # three frames of one row


def queue_positions(jobs: DataFrame) -> DataFrame:
    """(id, position): rank of each queued job by priority, time and id.

    No task sorts the whole queue: ranks within (priority, day) start from the number of jobs before that pair.
    """
    queued = jobs.where("status = 'queued'").withColumn("day", F.col("created").cast("date"))
    sizes = queued.groupBy("priority", "day").agg(F.count("*").alias("n"))
    before = Window.orderBy("priority", "day").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("priority", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each priority and day
    inside = F.row_number().over(Window.partitionBy("priority", "day").orderBy("created", "id"))
    return queued.withColumn("inside", inside).join(base, ["priority", "day"]).select("id", (F.col("base") + F.col("inside")).alias("position"))


def queue_top(jobs: DataFrame, n: int = 40) -> DataFrame:
    """What an administrator sees: running jobs, then queued ones in order."""
    running = F.when(F.col("status") == "running", 0).otherwise(1)
    return jobs.where("status in ('queued', 'running')").withColumn("_r", running).orderBy("_r", "priority", "created", "id").limit(n).drop("_r")


def ema(pings: DataFrame, keep: float = 0.7) -> DataFrame:
    """(endpoint, latency, n): exponential mean of good pings in order; the first sample counts whole.

    A day's pings fold to (factor, sum) first, so a busy endpoint is spread over its days; days are then composed.
    """
    good = pings.where("ok").withColumn("day", F.col("ts").cast("date"))
    first = F.min(F.struct("ts", "id")).over(Window.partitionBy("endpoint", "day"))
    w = Window.partitionBy("endpoint", "day")
    late = F.row_number().over(w.orderBy(F.desc("ts"), F.desc("id"))) - 1
    rows = good.select("endpoint", "day", "latency", late.alias("late"), (F.struct("ts", "id") == first).alias("head"))
    terms = rows.groupBy("endpoint", "day").agg(
        F.count("*").alias("n"), F.sum(F.col("latency") * (1 - keep) * F.pow(F.lit(keep), "late")).alias("s"), F.max(F.when(F.col("head"), F.col("latency"))).alias("first")
    )
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("n"))
    power = lambda n: F.pow(F.lit(keep), n)
    step = lambda a, d: F.struct((F.coalesce(a["v"], d["first"]) * power(d["n"]) + d["s"]).alias("v"), (a["n"] + d["n"]).alias("n"))
    folded = terms.groupBy("endpoint").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("day", "n", "s", "first"))), start, step).alias("a"))
    return folded.select("endpoint", F.col("a.v").alias("latency"), "a.n")


def breaker(pings: DataFrame, limit: int = FAILS) -> DataFrame:
    """(endpoint, fails, longest, trips): failures in a row at the end and at most, and how often limit was reached.

    A day gives its leading, trailing and inner runs; days are then joined at their ends.
    """
    day = pings.withColumn("day", F.col("ts").cast("date"))
    w = Window.partitionBy("endpoint", "day").orderBy("ts", "id")
    runs = day.withColumn("run", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = runs.groupBy("endpoint", "day", "run").agg(F.count_if(~F.col("ok")).alias("n"))
    last = F.max("run").over(Window.partitionBy("endpoint", "day"))
    spans = lengths.withColumn("last", last).groupBy("endpoint", "day").agg(
        F.coalesce(F.max(F.when(F.col("run") == 0, F.col("n"))), F.lit(0)).alias("head"),
        F.max(F.when(F.col("run") == F.col("last"), F.col("n"))).alias("tail"),
        F.coalesce(F.max(F.when((F.col("run") > 0) & (F.col("run") < F.col("last")), F.col("n"))), F.lit(0)).alias("inner"),
        F.count_if((F.col("run") > 0) & (F.col("run") < F.col("last")) & (F.col("n") >= limit)).alias("trips"),
        (F.max("last") == 0).alias("all_bad"),
    )
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("fails", "longest", "trips")])

    def step(a, d):
        joined = a["fails"] + d["head"]
        fails = F.when(d["all_bad"], joined).otherwise(d["tail"])
        ended = F.when(~d["all_bad"] & (joined >= limit), 1).otherwise(0)
        return F.struct(fails.alias("fails"), F.greatest(a["longest"], joined, d["inner"], fails).alias("longest"), (a["trips"] + d["trips"] + ended).alias("trips"))

    folded = spans.groupBy("endpoint").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("day", "head", "tail", "inner", "trips", "all_bad"))), start, step).alias("a"))
    return folded.select("endpoint", "a.fails", "a.longest", (F.col("a.trips") + F.when(F.col("a.fails") >= limit, 1).otherwise(0)).alias("trips"))


def pick_endpoint(state: DataFrame, group: str) -> DataFrame:
    """Endpoint of least score among those with a free slot, among all if none has; ties go to the one added first."""
    score = F.col("inflight") / F.greatest(F.col("capacity"), F.lit(1)) + F.least(F.col("latency"), F.lit(5.0)) / 10
    full = (F.col("inflight") >= F.col("capacity")).cast("int")
    return state.groupBy(group).agg(F.min_by("endpoint", F.struct(full, score, "added")).alias("endpoint"))


def progress(done: Column, total: Column, chars: Column, elapsed: Column) -> Column:
    """struct(percent, rate in thousands of characters a second, seconds left), cut to whole numbers."""
    percent = F.floor(100 * done / F.greatest(total, F.lit(1))).cast("int")
    rate = F.floor(chars / F.greatest(elapsed, F.lit(1)) / 1000).cast("long")
    left = F.when(done > 0, F.floor(elapsed / done * (total - done)).cast("long"))
    return F.struct(percent.alias("percent"), rate.alias("rate"), left.alias("left"))


def job_states(log: DataFrame) -> DataFrame:
    """Last status of each job, and whether its credit goes back: spent up front, and the job did not settle."""
    last = log.groupBy("job_id").agg(F.max_by("status", F.struct("at", "id")).alias("status"), F.max("credit").alias("credit"))
    return last.withColumn("refund", F.col("credit") & F.col("status").isin("failed", "cancelled"))


def recover(jobs: DataFrame) -> DataFrame:
    """After a crash: what was queued or running has failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def start_state(cancelled: Column, banned: Column, kept: Column) -> Column:
    """Status of a job whose turn has come. kept: its file is still there."""
    return F.when(cancelled | banned, "cancelled").when(~kept, "failed").otherwise("running")


def request_status(secret_ok: Column, n_items: Column, n_chars: Column, known: Column | None = None, parsed: Column | None = None) -> Column:
    """HTTP status of a request to a worker: known route, secret, body, size. Whether its service then succeeds is told in the body of the 200."""
    known, parsed = (F.lit(True) if c is None else c for c in (known, parsed))
    asked = F.when(~known, 404).when(~secret_ok, 401).when(~parsed, 422).when(n_items == 0, 200)
    return asked.when((n_items > REQUEST_ITEMS) | (n_chars > REQUEST_CHARS), 413).otherwise(200)


def requests(bodies: DataFrame, body: str = "body", lang: str = "hi", source: str = "auto") -> DataFrame:
    """Adds parsed, texts, lang, source from a JSON body. Anything but an object is not parsed; what it lacks is taken from the defaults."""
    v = F.try_parse_json(body)
    named = lambda key, default: F.coalesce(F.nullif(trim(F.try_variant_get(v, f"$.{key}", "string")), F.lit("")), F.lit(default))
    texts = F.coalesce(F.try_variant_get(v, "$.text_list", "array<string>"), F.array().cast("array<string>"))
    parsed = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return bodies.withColumns({"parsed": parsed, "texts": texts, "lang": named("lang", lang), "source": named("source", source)})


def load(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """One row: jobs queued and running, and workers that can take one. workers: enabled, healthy."""
    waiting = jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"))
    return waiting.join(workers.agg(F.count_if(F.col("enabled") & F.col("healthy")).alias("available")))  # two frames of one row


def cool_until(kind: Column, fails: Column, at: Column) -> Column:
    """Second until which an endpoint rests: after a failed ping, a busy reply, or FAILS failures in a row; null if not."""
    return F.when(kind == "ping", at + COOL_PING).when(kind == "busy", at + COOL_BUSY).when(fails >= FAILS, at + COOL_FAILS)


def tally(sent: DataFrame, key: str, failed: Column) -> DataFrame:
    """(key, ok, failed): how many messages arrived and how many did not."""
    return sent.groupBy(key).agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"))


def listed(workers: DataFrame) -> DataFrame:
    """Workers in the order in which they were added."""
    return workers.orderBy("added", "url")


def reconcile(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(url, action): workers to add, remove, enable or disable so that the live ones match the stored ones."""
    a, b = stored.select("url", F.col("enabled").alias("want")), live.select("url", F.col("enabled").alias("have"))
    act = F.when(F.col("have").isNull(), "add").when(F.col("want").isNull(), "remove").when(F.col("want") & ~F.col("have"), "enable").when(~F.col("want") & F.col("have"), "disable").otherwise("keep")
    return a.join(b, "url", "full_outer").select("url", act.alias("action"))


def health(requests: DataFrame, platform: str, uptime: int) -> DataFrame:
    """One row on a worker: its limits and what it served. requests: strings, served."""
    counted = requests.agg(F.count("*").alias("requests"), F.coalesce(F.sum("strings"), F.lit(0)).alias("strings"), F.count_if(~F.col("served")).alias("errors"))
    fixed = {"status": "ok", "platform": platform, "uptime": uptime, "max_items": REQUEST_ITEMS, "max_chars": REQUEST_CHARS}
    return counted.select(*[F.lit(v).alias(k) for k, v in fixed.items()], "requests", "strings", "errors")
