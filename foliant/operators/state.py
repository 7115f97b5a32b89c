"""Quotas, rate limits, the credit ledger and entitlements over event tables.

Where only admitted events count, admission is sequential within a key. Such keys are dealt out by hash, sorted
within partitions by Spark's external sort, and walked batch by batch with a small state carried along: no key
is ever held whole in memory, however many events it has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def walk(events: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], columns: list[str], out: str, spent: bool = False) -> DataFrame:
    """Adds to each event what ``step(state, row)`` returns, in order within the key. ``step`` gets the values of
    ``columns`` and changes the state that ``start`` made for the key; ``out`` is the DDL of what it returns. ``columns`` that
    are ``spent`` are left out of the result."""
    names = [x.split()[0] for x in out.split(",")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for batch in batches:
            found = []
            for k, *row in batch[[key, *columns]].itertuples(index=False, name=None):
                if k != current:
                    current, state = k, start()
                found.append(step(state, tuple(row)))
            rest = batch.drop(columns=columns) if spent else batch
            yield pd.concat([rest.reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields if not (spent and f.name in columns))
    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(task, f"{schema}, {out}")


class FixedWindow:
    """Windows that begin with an event: ``limit`` requests in ``seconds``; a refused one changes nothing."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.us, self.begin, self.count = limit, seconds * 1_000_000, None, 0

    def step(self, row: tuple) -> tuple:
        (t,) = row
        if self.begin is None or t - self.begin >= self.us:
            self.begin, self.count = t, 1
            return True, 0
        if self.count >= self.limit:
            return False, max(1, -(-(self.begin + self.us - t) // 1_000_000))
        self.count += 1
        return True, 0


class SlidingLog:
    """At most ``limit`` admitted requests within any ``seconds``; one exactly that old no longer counts."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.us, self.hits = limit, seconds * 1_000_000, deque()

    def step(self, row: tuple) -> tuple:
        (t,) = row
        while self.hits and self.hits[0] <= t - self.us:
            self.hits.popleft()
        if len(self.hits) >= self.limit:
            return False, max(1, -(-(self.hits[0] + self.us - t) // 1_000_000))
        self.hits.append(t)
        return True, 0


def rate_limit(events: DataFrame, key: str, limit: int, seconds: int, kind: type = FixedWindow) -> DataFrame:
    """Adds allowed and retry_after (seconds) to events with a key and ``us``, the time in microseconds."""
    return walk(events, key, ["us", "event_id"], lambda: kind(limit, seconds), lambda s, row: s.step(row), ["us"], "allowed boolean, retry_after long")


def daily_quota(events: DataFrame, ts: str, most: int, *order: Column) -> DataFrame:
    """Adds day and allowed: the first ``most`` events of each day are. Days are numbered in two levels (hour, then day),
    so that a busy day is not one task."""
    day, hour = F.to_date(ts), F.date_trunc("hour", ts)
    rows = events.withColumns({"day": day, "__hour": hour})
    counts = rows.groupBy("day", "__hour").agg(F.count("*").alias("n"))
    before = counts.select("day", "__hour", (F.sum("n").over(Window.partitionBy("day").orderBy("__hour")) - F.col("n")).alias("__before"))
    placed = rows.withColumn("__k", F.row_number().over(Window.partitionBy("day", "__hour").orderBy(ts, *order))).join(before, ["day", "__hour"])
    return placed.withColumn("allowed", F.col("__before") + F.col("__k") <= most).drop("__hour", "__k", "__before")


def ledger_balance(journal: DataFrame, account: str, operation: str, kind: str, credits: str, order: str) -> DataFrame:
    """Balance by account: the first entry of each (account, operation, kind) counts, repeats do not."""
    first = Window.partitionBy(account, operation, kind).orderBy(order)
    once = journal.withColumn("__k", F.row_number().over(first)).filter("__k = 1")
    signed = F.when(F.col(kind) == "grant", F.col(credits)).when(F.col(kind) == "consume", -F.col(credits)).otherwise(0)
    return once.groupBy(account).agg(F.sum(signed).alias("balance"), F.count("*").alias("n_entries"))


class Ledger:
    """Credits of one account. A reservation holds credits until it is committed, released or ``lease`` seconds old."""

    def __init__(self):
        self.balance, self.granted, self.holds, self.spent = 0, set(), {}, set()

    def step(self, row: tuple) -> tuple:
        t, op, operation, credits, lease = row
        for o, (n, end) in list(self.holds.items()):
            if end <= t:
                self.balance += n
                del self.holds[o]
        if op == "grant":
            if operation in self.granted:
                return "duplicate", self.balance
            self.granted.add(operation)
            self.balance += credits
            return "granted", self.balance
        if op == "reserve":
            if operation in self.holds or operation in self.spent:
                return "duplicate", self.balance
            if self.balance < credits:
                return "insufficient", self.balance
            self.balance -= credits
            self.holds[operation] = credits, t + lease * 1_000_000
            return "reserved", self.balance
        if op == "commit":
            if operation in self.spent:
                return "already_committed", self.balance
            if operation not in self.holds:
                return "not_pending", self.balance
            del self.holds[operation]
            self.spent.add(operation)
            return "committed", self.balance
        if operation not in self.holds:
            return "not_pending", self.balance
        self.balance += self.holds.pop(operation)[0]
        return "released", self.balance


def ledger(operations: DataFrame, account: str) -> DataFrame:
    """Adds outcome and balance to operations (account, event_id, us, op, operation, credits, lease)."""
    return walk(operations, account, ["us", "event_id"], Ledger, lambda s, row: s.step(row), ["us", "op", "operation", "credits", "lease"], "outcome string, balance long")


def entitlement(as_of: Column, started: Column, expires: Column, scans: Column, most: Column, status: Column) -> Column:
    """State of a trial: revoked and inactive ones first, then time, then scans."""
    return (
        F.when(status == "revoked", "REVOKED")
        .when(started.isNull() | expires.isNull(), "NONE")
        .when(status != "active", "EXPIRED")
        .when(expires <= as_of, "EXPIRED_TIME")
        .when(scans >= most, "EXPIRED_SCANS")
        .otherwise("TRIAL")
    )
