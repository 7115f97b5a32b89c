"""Operator 6 against a brute-force version."""

import time
from hashlib import md5

from foliant.llm import line_dedup as D


def chunks(text):
    lines = (text or "").split("\n") if text else []
    h = [md5(x.encode()).hexdigest() for x in lines]
    out, begin = [], 0
    for i in range(len(lines)):
        rolled = md5((h[i - 1] + h[i]).encode()).hexdigest() if i else "f"
        if i == len(lines) - 1 or rolled[0] in D.ENDS:
            out.append((begin, i + 1))
            begin = i + 1
    return lines, out


def plain(rows):
    seen, out = {}, {}
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        lines, parts = chunks(text)
        gone = []
        for k, (a, b) in enumerate(parts):
            body = "\n".join(lines[a:b])
            if b - a > 1 and seen.setdefault(body, (i, text, k)) != (i, text, k):
                gone.append((a, b))
        out[i] = (text, lines, gone)
    return out


def test_rows(docs, rows):
    want = plain(rows)
    got = {r.doc_id: r.text for r in D.dedup_lines(docs).collect()}
    assert got == {i: t if not gone else "\n".join(x for k, x in enumerate(lines) if not any(a <= k < b for a, b in gone)) for i, (t, lines, gone) in want.items()}
    marked = {r.doc_id: [(x["first"] - 1, x["first"] - 1 + x["n"], x["bytes"]) for x in r.removed] for r in D.removals(docs).collect()}
    assert marked == {i: [(a, b, len("\n".join(lines[a:b]).encode())) for a, b in gone] for i, (_, lines, gone) in want.items() if gone}
    assert marked


def test_a_text_of_very_many_lines(spark):
    """The work grows in proportion to the lines of a text: 160,000 lines take no more than some seconds."""
    text = "\n".join(f"line {i} of many" for i in range(160_000))
    rows = [(1, text), (2, "first\n" + text), (3, "other\nlines")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in D.dedup_lines(docs).collect()}
    assert time.time() - began < 60
    want = {i: "\n".join(x for k, x in enumerate(lines) if k not in {j for a, b in gone for j in range(a, b)}) if len(gone) < 2 else None for i, (_, lines, gone) in plain(rows).items()}
    assert got[1] == text == want[1] and got[3] == want[3] and len(got[2]) < len(text) / 10


def test_boundaries_resist_shifts():
    text = "\n".join(f"line {i % 37} of {i}" for i in range(200))
    lines, a = chunks(text)
    moved, b = chunks("one more\n" + text)
    old, new = {"\n".join(lines[x:y]) for x, y in a}, {"\n".join(moved[x:y]) for x, y in b}
    assert len(old & new) >= len(old) - 1


def test_odd_rows(spark, empty):
    assert D.removals(empty).count() == 0 and D.dedup_lines(empty).count() == 0
    odd = spark.createDataFrame([(1, "a\nb", 1, "z"), (1, "a\nb", 2, "z"), (None, "a\nb", 3, "y"), (4, None, 4, None)], "doc_id long, text string, h int, removed string")
    got = D.dedup_lines(odd)
    assert got.columns == odd.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "", 1, "z"), (1, "", 2, "z"), (None, "a\nb", 3, "y"), (4, None, 4, None)], key=str)
