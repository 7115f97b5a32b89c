"""Operator 4: the Pfair bounds, a plain simulation, and odd rows."""

from math import ceil

import pytest
from foliant.llm import mixing as M


def simulated(shares: dict[str, int]) -> list[str]:
    names, period, had, out = sorted(shares), sum(shares.values()), {}, []
    for t in range(period):
        ready = [(ceil((had.get(s, 0) + 1) * period / shares[s]), s) for s in names if had.get(s, 0) < shares[s] and had.get(s, 0) * period // shares[s] <= t]
        s = min(ready)[1]
        had[s] = had.get(s, 0) + 1
        out.append(s)
    return out


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 3, "b": 2}, {"a": 50, "b": 30, "c": 7, "d": 7, "e": 5, "f": 1}, {f"s{i}": i + 1 for i in range(13)}])
def test_schedule(spark, shares):
    period = sum(shares.values())
    frame = spark.createDataFrame([(s, n, period) for s, n in shares.items()], "source string, share long, period long")
    rows = M.schedule(frame).orderBy("slot").collect()
    assert [r.source for r in rows] == simulated(shares)
    had = dict.fromkeys(shares, 0)
    for r in rows:
        assert r.j * period // r.share <= r.slot < ceil((r.j + 1) * period / r.share)
        had[r.source] += 1
        for s, n in shares.items():  # less than one block from the ideal
            assert abs(had[s] - n * (r.slot + 1) / period) < 1


def test_mix(docs, rows):
    found = M.mix(docs, {"s0": 3, "s1": 2, "s2": 1, "": 1}, block=200, period=20).orderBy("slot", "ordinal").collect()
    assert sorted((r.doc_id for r in found)) == sorted(i for i, *_ in rows)
    assert all(r.release <= r.slot < r.deadline for r in found)
    slots = {}
    for r in found:  # a slot has one source, a block one slot
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert any(r.in_mix for r in found) and not all(r.in_mix for r in found)
    for source in ("s0", "s1", "s2", None):
        at = 0
        for r in sorted((r for r in found if r.source == source), key=lambda r: r.ordinal):
            assert r.ordinal == at and r.block == at // 200
            at += len(r.text or "")


def test_odd_rows(spark, empty):
    assert M.mix(empty).count() == 0 and M.in_order(empty).count() == 0
    odd = spark.createDataFrame([(1, "a", "s", 1, "x"), (1, "a", "s", 1, "x"), (None, None, None, 2, "y"), (2, "", "s", 3, None)], "doc_id long, text string, source string, slot int, in_mix string")
    assert M.mix(odd).count() == 4
    kept = M.in_order(odd)
    assert kept.columns == odd.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, odd.collect()), key=str)


def test_order_is_kept_in_files(docs, spark, tmp_path):
    M.in_order(docs).write.parquet(str(tmp_path / "x"))
    files = sorted((tmp_path / "x").glob("*.parquet"))
    import pyarrow.parquet as pq

    stored = [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()]
    assert stored == [r.doc_id for r in M.mix(docs).orderBy("slot", "ordinal", "doc_id").collect()]
