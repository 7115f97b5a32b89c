"""Operator 2 against a brute-force version."""

import hashlib
import re

import pytest
from foliant.llm import decontamination as D
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, window=D.WINDOW):
    windows = {}
    for name, text in items:
        w = words(text)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + window]), set()).add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for i, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    long = next(t for _, t, *_ in rows if t and len(words(t)) > 60)
    some = [(i, t) for i, (_, t, *_) in enumerate(rows[:12])]
    return [*some, (100, " ".join(long.split()[5:40])), (100, "the an"), (None, "an re"), (102, None), (103, "..."), (104, "nowhere to be found in any text at all of these my dear friends here")]


def collected(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_rows(spark, docs, rows, items, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert collected(D.decontaminate(docs, frame)) == plain(rows, items)


def test_segments(spark, docs, rows, items):
    """Texts longer than a segment, and many segments."""
    frame = spark.createDataFrame(items, "item_id long, text string")
    index = D.build_index(docs)
    assert index.count() >= 1
    assert collected(D.decontaminate(docs.unionAll(docs), frame)) == sorted([x for x in plain(rows, items) for _ in range(2)], key=str)


def test_proximity(docs, rows):
    index = D.build_index(docs)
    for terms, distance in ((["the", "re", "tion"], 6), (["an", "o"], 2), (["nowhere"], 3), (["the", "the"], 1)):
        expected = []
        for i, text, *_ in rows:
            w, need = words(text), set(terms)
            if any(need <= set(w[j : j + distance]) for j in range(len(w))):
                expected.append(i)
        assert sorted(r.doc_id for r in D.proximity_hits(index, terms, distance).collect()) == sorted(expected)


def test_empty_tables_and_clashing_columns(spark, docs, empty, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert D.decontaminate(empty, frame).count() == 0
    none = D.decontaminate(docs, frame.limit(0))
    assert none.filter("contaminated OR n_hit > 0").count() == 0 and none.count() == docs.count()
    odd = spark.createDataFrame([(1, "an re", "x", 3), (None, None, "y", 4)], "doc_id long, text string, items string, segment int")
    assert collected(D.decontaminate(odd, frame)) == plain([(1, "an re"), (None, None)], items)
    assert D.drop_contaminated(odd, frame).columns == odd.columns


def test_drop(spark, docs, rows, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    bad = {x[0] for x in plain(rows, items) if x[4]}
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, frame).collect()) == sorted(i for i, *_ in rows if i not in bad)


def test_query(spark):
    from foliant.llm import queries

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries()["op2_decontamination"](spark, d)
    want = [(i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), c) for i, n, h, x, c in plain(rows, items)]
    assert sorted((tuple(r) for r in got.drop("n_near").collect()), key=str) == sorted(want, key=str)
    assert got.filter(F.col("contaminated")).count() > 0
