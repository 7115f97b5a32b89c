"""Structured Streaming twins of the limits: the same steps with state in the state store.

Watermark policy: events later than ``late`` behind the newest one are dropped; a key's state goes once the
watermark has passed its last event by ``idle``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.state import FixedWindow, SlidingLog

OUT = "user_id long, event_id long, us long, allowed boolean, retry_after long"


def _run(make, load, save, idle_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = make()
        if state.exists:
            load(limiter, state.get)
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])  # one key of one micro-batch
        found = [limiter.step((t,)) for t in rows["us"].tolist()]
        state.update(save(limiter))
        state.setTimeoutTimestamp(int(max(state.getCurrentWatermarkMs(), rows["us"].max() // 1000)) + idle_ms)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "us": rows["us"].to_numpy(), "allowed": [a for a, _ in found], "retry_after": [r for _, r in found]})

    return step


def fixed_window(events: DataFrame, limit: int, seconds: int, late: str = "1 minute") -> DataFrame:
    """Stream of (user_id, event_id, ts) with the verdict of an event-anchored window."""

    def load(s: FixedWindow, x: tuple) -> None:
        s.begin, s.count = x

    keyed = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).groupBy("user_id")
    return keyed.applyInPandasWithState(_run(lambda: FixedWindow(limit, seconds), load, lambda s: (s.begin, s.count), seconds * 2000), OUT, "begin long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def sliding_log(events: DataFrame, limit: int, seconds: int, late: str = "1 minute") -> DataFrame:
    """Stream of (user_id, event_id, ts) with the verdict of a sliding log; its state holds ``limit`` times at most."""

    def load(s: SlidingLog, x: tuple) -> None:
        s.hits = deque(x[0])

    keyed = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).groupBy("user_id")
    return keyed.applyInPandasWithState(_run(lambda: SlidingLog(limit, seconds), load, lambda s: (list(s.hits),), seconds * 2000), OUT, "hits array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream of (ts) to calls by day, in complete or update mode."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("calls")).select(F.to_date("w.start").alias("day"), "calls")
