"""Limits and ledger, in batch and as streams."""

import random

from foliant.operators import state as S
from foliant.streaming import limits

SECOND = 1_000_000


def run(spark, times, kind, limit=2, seconds=10):
    rows = [(1, i, int(t * SECOND)) for i, t in enumerate(times)]
    got = S.rate_limit(spark.createDataFrame(rows, "user_id long, event_id long, us long"), "user_id", limit, seconds, kind).orderBy("event_id").collect()
    return [(r.allowed, r.retry_after) for r in got]


def test_fixed_window(spark):
    assert run(spark, [0, 1, 2, 9.5, 10, 11, 12], S.FixedWindow) == [(True, 0), (True, 0), (False, 8), (False, 1), (True, 0), (True, 0), (False, 8)]


def test_sliding_log(spark):
    # a request exactly as old as the window no longer counts; refused ones never count
    assert run(spark, [0, 1, 2, 10, 10.5, 11], S.SlidingLog) == [(True, 0), (True, 0), (False, 8), (True, 0), (False, 1), (True, 0)]


def test_ledger(spark):
    ops = [
        (0, "grant", "g", 5), (1, "grant", "g", 5), (2, "reserve", "a", 3), (3, "reserve", "a", 3), (4, "reserve", "b", 3), (5, "commit", "a", 0), (6, "commit", "a", 0),
        (7, "reserve", "c", 2), (8, "release", "c", 0), (9, "release", "c", 0), (10, "reserve", "d", 2), (71, "commit", "d", 0), (72, "reserve", "d", 2),
    ]
    rows = [(1, i, t * SECOND, op, o, c, 60) for i, (t, op, o, c) in enumerate(ops)]
    got = S.ledger(spark.createDataFrame(rows, "account long, event_id long, us long, op string, operation string, credits int, lease int"), "account").orderBy("event_id").collect()
    assert [(r.outcome, r.balance) for r in got] == [
        ("granted", 5), ("duplicate", 5), ("reserved", 2), ("duplicate", 2), ("insufficient", 2), ("committed", 2), ("already_committed", 2),
        ("reserved", 0), ("released", 2), ("not_pending", 2), ("reserved", 0), ("not_pending", 2), ("reserved", 0),
    ]


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), i, rng.randrange(1000) * SECOND) for i in range(400)]
    frame = spark.createDataFrame(rows, "user_id long, event_id long, us long")
    a = sorted(S.rate_limit(frame.repartition(7), "user_id", 3, 20).collect())
    assert a == sorted(S.rate_limit(frame.coalesce(1), "user_id", 3, 20).collect())
    plain = []
    for k in range(4):
        s = S.FixedWindow(3, 20)
        plain += [(u, i, t, *s.step((t,))) for u, i, t in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))]
    assert a == sorted(plain)


def test_streams_agree_with_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("user_id", "event_id", "cast(ts AS timestamp) ts")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    batch = events.selectExpr("user_id", "event_id", "unix_micros(ts) us")
    for k, (stream, kind) in enumerate(((limits.fixed_window, S.FixedWindow), (limits.sliding_log, S.SlidingLog))):
        source = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(str(tmp_path / "in"))
        q = stream(source, 3, 36 * 3600).writeStream.format("memory").queryName(f"limits{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(tuple(r) for r in spark.table(f"limits{k}").collect())
        want = sorted((r.user_id, r.event_id, r.us, r.allowed, r.retry_after) for r in S.rate_limit(batch, "user_id", 3, 36 * 3600, kind).collect())
        assert got == want
