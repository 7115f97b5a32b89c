"""Operator 10 against a brute-force version."""

import numpy as np
import pytest
import xxhash
from foliant.llm import simhash
from pyspark.sql import functions as F


def plain_fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable over fingerprints at 4 or fewer differing bits."""
    root = {i: i for i, _ in pairs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, fa in pairs:
        for b, fb in pairs:
            if a < b and (fa ^ fb).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_rows(docs, rows):
    found = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t, *_ in rows}
    roots = plain_components(sorted(fps.items()))
    assert found == {i: (fps[i], roots[i]) for i in fps}


def test_no_link_is_lost(spark, monkeypatch):
    """Clusters of close fingerprints, dealt over many prefixes and split inside tasks."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(30):
            fps.add(c ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))))
    fps = sorted(fps)
    expected = plain_components(list(enumerate(fps)))
    monkeypatch.setattr(simhash, "BUCKET_VARIANTS", 1 << 13)
    frame = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame.select("fp"), len(fps))).collect()}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    groups = {}
    for i, f in enumerate(signed):
        groups.setdefault(roots.get(f, f), set()).add(i)
    plain = {}
    for i, r in expected.items():
        plain.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_keep_one(docs):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})


def test_empty_and_clashing_columns(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "x"), (None, None, 6, "y"), (1, "a b", 7, "z")], "doc_id long, text string, fp int, component_id string")
    assert sorted(simhash.near_duplicates(odd).select("doc_id", "component_id").collect(), key=str) == sorted([(1, 1), (1, 1), (None, None)], key=str)
    assert set(simhash.keep_one(odd).columns) == {"doc_id", "text", "fp", "component_id"}


@pytest.mark.parametrize("n", [1, 3, 4, 9])
def test_fingerprint(n):
    text = " ".join(f"Wörd{i}" for i in range(n))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_query(spark):
    from foliant.llm import queries

    r = queries()["op10_simhash"](spark, "/root/testdata/sf0.001")
    assert dict(r.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    assert r.filter(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).count() == 0
