"""Streams of account events: daily quotas, payments that count once, and the state of jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events with a watermark; times without zone are taken as UTC."""
    return events.withColumn(ts, F.to_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone())).withWatermark(ts, delay)


def daily_quota(usage: DataFrame, free: int, ts: str = "ts") -> DataFrame:
    """(user_id, day, files, chars, left) for each user and UTC day, once the day is over. usage: see daily_usage."""
    own = ~F.col("credit")
    day = F.window(ts, "1 day")
    daily = usage.groupBy("user_id", day.alias("w")).agg(F.count_if(own).alias("files"), F.coalesce(F.sum(F.when(own, F.col("chars"))), F.lit(0)).alias("chars"))
    return daily.select("user_id", F.to_date("w.start").alias("day"), "files", "chars", F.greatest(F.lit(0), F.lit(free) - F.col("chars")).alias("left"))


def once(payments: DataFrame, key: str = "id") -> DataFrame:
    """The first report of each payment within the watermark."""
    return payments.dropDuplicatesWithinWatermark([key])


ACTIVE = ("queued", "running")


def job_slots(events: DataFrame) -> DataFrame:
    """(user_id, job_id, verdict): a user has one job at a time; others are refused until it ends.

    events: user_id, job_id, status, seq; banned if there is such a column. States: queued, running, done, failed,
    cancelled. A job waiting in the queue is free at once when cancelled; one of a banned user is cancelled when it
    would run. Events of a batch are taken by seq, in whatever frames they come; a user without a job leaves no state.
    """
    judged = events if "banned" in events.columns else events.withColumn("banned", F.lit(False))

    def step(key, frames, state: GroupState):
        held = state.get[0] if state.exists else None
        out = []
        # a batch may come in several frames: all of them are taken in the order of seq
        for r in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            status = "cancelled" if r.status == "running" and r.banned else r.status
            if status == "queued":
                out.append((key[0], r.job_id, "accepted" if held is None else "refused"))
                held = r.job_id if held is None else held
            elif r.job_id == held and status not in ACTIVE:
                out.append((key[0], r.job_id, status))
                held = None
        if held is not None:
            state.update((held,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "job_id", "verdict"])

    return judged.groupBy("user_id").applyInPandasWithState(step, "user_id long, job_id long, verdict string", "held long", "append", GroupStateTimeout.NoTimeout)


def pending_choices(choices: DataFrame, wait_ms: int = 90_000, more_ms: int = 45_000) -> DataFrame:
    """(user_id, choice, timed_out): the last choice of a user, or a timeout once the wait is over.

    choices: user_id, choice, ts with a watermark; done ends the wait at once. The wait is wait_ms from the first
    choice; each further one leaves at least the lesser of wait_ms and more_ms. custom says that the user is typing:
    a wait that ends meanwhile goes on once for wait_ms. Results do not depend on how rows fall into batches.
    """
    names = ["user_id", "choice", "timed_out"]

    def step(key, frames, state: GroupState):
        last, until, typing = state.get if state.exists else (None, 0, False)
        rows = [] if state.hasTimedOut else [r for frame in frames for r in frame.itertuples()]
        out = []

        def expire(now):
            nonlocal last, until, typing
            if last is not None and now >= until and typing:
                until, typing = until + wait_ms, False
            if last is not None and now >= until:
                out.append((key[0], last, True))
                last = None

        for r in sorted(rows, key=lambda r: r.ts):
            at = int(r.ts.timestamp() * 1000)
            expire(at)
            if r.choice == "done":
                out.extend([(key[0], last, False)] if last is not None else [])
                last = None
                continue
            until = at + wait_ms if last is None else max(until, at + min(wait_ms, more_ms))
            last, typing = r.choice, r.choice == "custom"
        if state.hasTimedOut:
            expire(state.getCurrentWatermarkMs())
        if last is not None:
            state.update((last, until, typing))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    return choices.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, choice string, timed_out boolean", "last string, until long, typing boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
