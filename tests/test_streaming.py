"""Each stream against its batch twin on the same events."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vellum.functions.text import epoch
from vellum.operators import accounts as batch
from vellum.operators import service
from vellum.sources import tables
from vellum.streaming import accounts, health

SF = "/root/testdata/sf0.001"


def stream(spark, df, tmp_path, name, parts=3, order=None):
    """df as a stream of a few files, one a batch."""
    at = str(tmp_path / name)
    rows = df.toPandas()
    rows = rows.sort_values(order) if order else rows
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows.iloc[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


def result(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_daily_quota(spark, tmp_path):
    use = tables.usage(spark, SF)
    got = result(spark, accounts.daily_quota(accounts.timed(stream(spark, use, tmp_path, "use", order="ts")), 1000), tmp_path, "quota")
    want = {(r.user_id, r.day): (r.files, r.chars, r.left) for r in batch.quota_left(batch.daily_usage(use), 1000).collect()}
    found = {(r.user_id, r.day): (r.files, r.chars, r.left) for r in got.collect()}
    assert found and all(want[k] == v for k, v in found.items())
    last = max(d for _, d in want)
    assert {k for k in want if k[1] < last} == set(found) - {k for k in found if k[1] == last}


def test_payments_count_once(spark, tmp_path):
    pay = tables.load(spark, SF, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "ts")
    twice = pay.unionAll(pay)
    got = result(spark, accounts.once(accounts.timed(stream(spark, twice, tmp_path, "pay", order="ts"), delay="60 days")), tmp_path, "paid")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in pay.collect())


def test_breaker(spark, tmp_path):
    pings = tables.pings(spark, SF).withColumn("at", epoch(F.col("ts")))
    events = pings.select("endpoint", "id", "at", "ok", "latency")
    health.breaker(stream(spark, events, tmp_path, "pings", order=["at", "id"]), limit=3)
    got = result(spark, health.breaker(stream(spark, events, tmp_path, "pings2", order=["at", "id"]), limit=3), tmp_path, "health", "update").toPandas().groupby("endpoint").last()
    twin = service.breaker(pings, limit=3).toPandas().set_index("endpoint")
    mean = service.ema(pings).toPandas().set_index("endpoint")
    for e in twin.index:
        assert (got.loc[e, "fails"], got.loc[e, "longest"], got.loc[e, "trips"]) == tuple(twin.loc[e, ["fails", "longest", "trips"]])
        assert abs(got.loc[e, "latency"] - mean.loc[e, "latency"]) < 1e-6 and got.loc[e, "n"] == mean.loc[e, "n"]


def test_job_slots_and_throttle(spark, tmp_path):
    rows = [(1, 10, "queued", 1), (1, 11, "queued", 2), (1, 10, "running", 3), (1, 10, "done", 4), (1, 12, "queued", 5), (2, 20, "queued", 6), (1, 12, "cancelled", 7), (1, 13, "queued", 8)]
    df = spark.createDataFrame(rows, "user_id long, job_id long, status string, seq long")
    got = result(spark, accounts.job_slots(stream(spark, df, tmp_path, "jobs", order="seq")), tmp_path, "slots")
    assert sorted((r.job_id, r.verdict) for r in got.collect()) == [(10, "accepted"), (10, "done"), (11, "refused"), (12, "accepted"), (12, "cancelled"), (13, "accepted"), (20, "accepted")]
    marks = spark.createDataFrame([(1, t, t, 9) for t in range(10)], "job_id long, at long, done long, total long")
    sent = result(spark, health.throttled(stream(spark, marks, tmp_path, "marks", order="at")), tmp_path, "sent")
    assert sorted(r.at for r in sent.collect()) == [0, 3, 6, 9]


def test_pending_choices(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, "epub", t), (1, "done", t + timedelta(seconds=10)), (2, "pdf", t + timedelta(seconds=20)), (3, "txt", t + timedelta(hours=1)), (3, "done", t + timedelta(hours=1))]
    df = spark.createDataFrame(rows, "user_id long, choice string, ts timestamp")
    got = result(spark, accounts.pending_choices(stream(spark, df, tmp_path, "picks", parts=5, order="ts").withWatermark("ts", "1 second")), tmp_path, "choices")
    assert sorted((r.user_id, r.choice, r.timed_out) for r in got.collect()) == [(1, "epub", False), (2, "pdf", True), (3, "txt", False)]


def test_waits_are_extended(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    rows = [
        (1, "epub", at(0)), (1, "pdf", at(80)), (1, "txt", at(120)), (1, "done", at(160)),  # each choice leaves 45 s
        (2, "epub", at(0)), (2, "late", at(91)), (2, "done", at(92)),  # 90 s are over: a wait of its own
        (3, "custom", at(0)), (3, "done", at(170)),  # typing: a second window
        (4, "custom", at(0)), (4, "done", at(181)),
        (5, "epub", at(4000)), (5, "done", at(4001)),
    ]
    df = spark.createDataFrame(rows, "user_id long, choice string, ts timestamp")
    want = [(1, "txt", False), (2, "epub", True), (2, "late", False), (3, "custom", False), (4, "custom", True), (5, "epub", False)]
    for parts in (1, 12):
        got = result(spark, accounts.pending_choices(stream(spark, df, tmp_path, f"waits{parts}", parts=parts, order="ts").withWatermark("ts", "1 second")), tmp_path, f"waited{parts}")
        assert sorted(((r.user_id, r.choice, r.timed_out) for r in got.collect()), key=str) == sorted(want, key=str)


def test_a_banned_user_loses_the_slot(spark, tmp_path):
    rows = [(1, 10, "queued", 1, False), (1, 10, "running", 2, True), (1, 11, "queued", 3, False), (1, 11, "cancelled", 4, False), (1, 12, "queued", 5, False)]
    df = spark.createDataFrame(rows, "user_id long, job_id long, status string, seq long, banned boolean")
    got = result(spark, accounts.job_slots(stream(spark, df, tmp_path, "bans", order="seq")), tmp_path, "banned_slots")
    assert sorted((r.job_id, r.verdict) for r in got.collect()) == [(10, "accepted"), (10, "cancelled"), (11, "accepted"), (11, "cancelled"), (12, "accepted")]


def state_rows(spark, tmp_path, name):
    return spark.read.format("statestore").load(str(tmp_path / f"{name}-state")).count()


def test_state_goes_with_the_job_and_order_is_by_seq(spark, tmp_path):
    rows = [(u, u * 10, status, seq) for u in (1, 2, 3) for seq, status in ((1, "queued"), (2, "running"), (3, "done"))] + [(4, 40, "queued", 1), (4, 41, "queued", 2), (4, 40, "failed", 3), (4, 42, "queued", 4)]
    df = spark.createDataFrame(rows[::-1], "user_id long, job_id long, status string, seq long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # a frame for each row
    try:
        got = result(spark, accounts.job_slots(stream(spark, df, tmp_path, "mixed", parts=1)), tmp_path, "mixed_slots")
        want = [(u, u * 10, v) for u in (1, 2, 3) for v in ("accepted", "done")] + [(4, 40, "accepted"), (4, 40, "failed"), (4, 41, "refused"), (4, 42, "accepted")]
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert state_rows(spark, tmp_path, "mixed_slots") == 1
        marks = spark.createDataFrame([(j, t, t, 9 if j == 1 else 99) for j in (1, 2) for t in range(9, -1, -1)], "job_id long, at long, done long, total long")
        sent = result(spark, health.throttled(stream(spark, marks, tmp_path, "marks2", parts=1)), tmp_path, "sent2")
        assert sorted((r.job_id, r.at) for r in sent.collect()) == [(j, t) for j in (1, 2) for t in (0, 3, 6, 9)]
        assert state_rows(spark, tmp_path, "sent2") == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
