"""Operator 7 against a brute-force version."""

import hashlib
import random

import numpy as np
import pytest
from foliant.llm import suffix_dedup as S


def plain(rows):
    texts = [(-(2**63) if i is None else i, (t or "").encode(), i) for i, t, *_ in rows]
    least = {}
    for i, b, _ in texts:
        for p in range(len(b) - S.LENGTH + 1):
            w = b[p : p + S.LENGTH]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, b, name in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - S.LENGTH + 1):
            if least[b[p : p + S.LENGTH]] < i:
                gone[p : p + S.LENGTH] = b"\1" * S.LENGTH
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((name, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [200_000, 2])
@pytest.mark.parametrize("sizes", [(8 << 20, 16 << 20), (3000, 2000)])
def test_rows(docs, rows, monkeypatch, sizes, hot):
    monkeypatch.setattr(S, "SEGMENT_BYTES", sizes[0])
    monkeypatch.setattr(S, "OWNER_BYTES", sizes[1])
    monkeypatch.setattr(S, "HOT", hot)
    assert collected(S.dedup(docs)) == plain(rows)


def test_near_matches(spark, monkeypatch):
    """Shared strings of 45 to 60 bytes in all sorts of surroundings, zeros and few letters among them."""
    rng = random.Random(4)
    shared = ["".join(rng.choice("ab\x00") for _ in range(rng.randrange(45, 61))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts.append(rng.choice(shared)[rng.randrange(0, 4) :])
            parts.append("".join(rng.choice("abcü\x00") for _ in range(rng.randrange(0, 40))))
        rows.append((rng.choice([i, i, i, 7, None]), "".join(parts)))
    monkeypatch.setattr(S, "SEGMENT_BYTES", 2000)
    monkeypatch.setattr(S, "OWNER_BYTES", 4000)
    assert collected(S.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == plain(rows)


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 5000, dtype=np.uint8)
    offsets = np.array([0, 0, 30, 700, 702, 760, 4000, 5000])
    want = S.anchors(data, offsets)
    for block in (1, 17, 100, 999):
        monkeypatch.setattr(S, "BLOCK", block)
        for x, y in zip(S.anchors(data, offsets), want, strict=True):
            assert (x == y).all()


def test_copies_and_a_long_text(spark):
    """Many copies of one text over many partitions, and a text of megabytes that repeats another's second half."""
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    rows = [(i, "the same text in very many documents of the table " * 3) for i in range(600)] + [(700, long), (701, long[750_000:] + "tail"), (None, "x" * 60), (5, "x" * 60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.dedup(spark.createDataFrame([r for r in rows if r[0] not in (0,) and r != rows[5]], "doc_id long, text string").repartition(40)).collect()}
    assert got[1] == (150, 0, 0)
    assert all(got[i] == (150, 150, 1) for i in range(2, 600) if i != 5)
    assert got[700][1] == 0 and got[701] == (750_004, 750_000, 1) and got[None] == (60, 0, 0) and got[5] == (60, 60, 1)


def test_loser_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), 8)
        shared = [[0, *(common(a, b) for a, b in zip(r, r[1:], strict=False))][: len(r)] for r in runs]
        at, out = [0] * k, []
        for run, own in S.LoserTree(runs, shared, 8).merged():
            s = runs[run][at[run]]
            at[run] += 1
            assert own == (common(out[-1], s) if out else 0)
            out.append(s)
        assert out == sorted(x for r in runs for x in r)


def test_odd_tables(spark, empty):
    assert S.dedup(empty).count() == 0
    rows = [(1, "x" * 80), (1, "x" * 80), (None, "x" * 49), (2, None), (3, "")]
    odd = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_bytes string")
    assert collected(S.dedup(odd)) == plain(rows)
    kept = {r.doc_id: r.kept for r in S.dedup(spark.createDataFrame([(1, "ab" * 40), (2, "zz" + "ab" * 40 + "yy")], "doc_id long, text string"), with_text=True).collect()}
    assert bytes(kept[2]) == b"zzyy"
