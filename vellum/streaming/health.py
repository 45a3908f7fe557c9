"""Streams of pings: latency, failures in a row and cool-downs of endpoints, and throttled progress."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.config import COOL_FAILS, FAILS


def breaker(pings: DataFrame, limit: int = FAILS, cool: int = COOL_FAILS, keep: float = 0.7) -> DataFrame:
    """(endpoint, latency, n, fails, longest, trips, until) after each batch. pings: endpoint, id, at (seconds), ok, latency.

    Rows of a batch are taken in the order of at and id. until: the end of the cool-down after limit failures in a
    row, 0 if the endpoint is well.
    """

    def step(key, frames, state: GroupState):
        latency, n, fails, longest, trips, until = state.get if state.exists else (None, 0, 0, 0, 0, 0)
        for r in pd.concat(list(frames)).sort_values(["at", "id"]).itertuples():
            if r.ok:
                latency = r.latency if n == 0 else keep * latency + (1 - keep) * r.latency
                n, fails, until = n + 1, 0, 0
            else:
                fails += 1
                trips += fails == limit
                until = int(r.at) + cool if fails >= limit else until
            longest = max(longest, fails)
        state.update((latency, n, fails, longest, trips, until))
        yield pd.DataFrame([(key[0], latency, n, fails, longest, trips, until)], columns=["endpoint", "latency", "n", "fails", "longest", "trips", "until"])

    fields = "latency double, n long, fails long, longest long, trips long, until long"
    return pings.groupBy("endpoint").applyInPandasWithState(step, f"endpoint long, {fields}", fields, "update", GroupStateTimeout.NoTimeout)


def throttled(progress: DataFrame, pause: int = 3, expire_ms: int = 86_400_000) -> DataFrame:
    """Progress reports of each job at least pause seconds apart, and the last one. progress: job_id, at, done, total.

    A job that is done leaves no state. If progress has ts with a watermark, one that is never done leaves none either
    when it has not reported for expire_ms of event time.
    """
    expires = "ts" in progress.columns

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, out, ended = (state.get[0] if state.exists else None), [], False
        for r in pd.concat(list(frames)).sort_values(["at", "done"], kind="stable").itertuples():
            if last is None or r.at - last >= pause or r.done >= r.total:
                out.append((key[0], int(r.at), int(r.done), int(r.total)))
                last = int(r.at)
            ended = r.done >= r.total
        if not ended:
            state.update((last,))
            if expires:
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + expire_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["job_id", "at", "done", "total"])

    return progress.groupBy("job_id").applyInPandasWithState(step, "job_id long, at long, done long, total long", "last long", "append", GroupStateTimeout.EventTimeTimeout if expires else GroupStateTimeout.NoTimeout)
