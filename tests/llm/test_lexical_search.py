"""Operator 11 against a brute-force version and its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from foliant.llm import lexical_search as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, []).extend(plain_terms(t))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c, n in counts:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, shard_bytes=L.SHARD_BYTES, **kind):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in L.search(L.build_index(docs, shard_bytes=shard_bytes), items, **kind).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    """Words of very uneven frequency, copies with equal scores, equal and null ids, odd texts."""
    rng = random.Random(2)
    words = [f"{'aAéz0ж'[k % 6]}w{k}" for k in range(300)]
    text = lambda n: " ".join(words[min(299, int(rng.paretovariate(0.6)) - 1)] for _ in range(n))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(400)]
    docs += [(1000 + k, docs[k % 7][1]) for k in range(60)] + [(5, text(9)), (None, docs[0][1]), (None, text(5)), (2, None), (3, ""), (4, " .,-! \x00")]
    items = [(k, text(rng.randrange(1, 15))) for k in range(25)] + [(7, "zw3 ZW3 zw3"), (None, text(4)), (50, None), (51, "unknown"), (52, "!!")]
    return docs, items


def test_rows(spark, corpus):
    assert found(spark, *corpus) == plain(*corpus)


def test_small_shards_and_blocks(spark, corpus):
    """Many shards in a task, and many blocks of items."""
    docs, items = corpus
    assert found(spark, docs, items, shard_bytes=700, block_terms=40, top=3) == plain(docs, items, 3)


def test_non_essential_postings_are_skipped(corpus):
    """Once an item has its best documents, a shard scores fewer postings than its terms have."""
    docs = [(d, t) for d, t in corpus[0] if t and d is not None]
    data = np.frombuffer("".join(t for _, t in docs).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in docs])])
    term, text, times = L.postings(L.LOWER[data], offsets)
    lengths = np.bincount(text, times, len(docs)).astype(int)
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    row = {
        "doc_ids": [d for d, _ in docs], "lengths": L.planes(lengths), "terms": term[first].tobytes(), "holders": L.planes(np.diff(np.append(first, len(term)))),
        "most": L.planes(np.maximum.reduceat(times, first)), "shortest": L.planes(np.minimum.reduceat(lengths[text], first)), "texts": L.planes(text), "times": L.planes(times),
    }
    own = np.unique(term, return_counts=True)
    at = np.argsort(-own[1])[[0, 1, 2, 40, 80]]
    factor = np.floor(1000 * np.log((2 * len(docs) + 2) / (2 * own[1][at] + 1))).astype(np.int64)
    everything, best = L.Shard(row, len(docs), int(lengths.sum())), L.Best(10)
    L.search_shard(everything, at, factor, best)
    again = L.Shard(row, len(docs), int(lengths.sum()))
    before = best.score.copy(), best.ids.copy()
    L.search_shard(again, at, factor, L.Best(10))
    strict = L.Best(10)
    strict.score, strict.ids, strict.null = before[0] * 0 + before[0][0], before[1], np.zeros(10, bool)
    third = L.Shard(row, len(docs), int(lengths.sum()))
    L.search_shard(third, at, factor, strict)
    assert again.scored == everything.scored and third.scored < everything.scored / 2


def test_long_texts_in_pieces():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, n)) for n in (0, 1, 30_000, 5)] + ["x" * 20_000 + " y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole, parts = L.postings(data, offsets, 1 << 30), L.postings(data, offsets, 1000)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert np.bincount(parts[1], parts[2]).tolist() == [len(t.split()) for t in texts]


def test_empty_and_clashing_columns(spark):
    some = [(1, "a b"), (2, "b c d")]
    assert found(spark, [], some) == found(spark, some, []) == found(spark, [(1, None)], some) == []
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "b", 6, "y")], "doc_id long, text string, score int, item_id string")
    items = spark.createDataFrame([("k", "a a", 1)], "item_id string, text string, doc_id long")
    assert [(r.item_id, r.rank, r.doc_id) for r in L.search(L.build_index(docs), items).collect()] == [("k", 1, 1)]


def test_query(spark):
    from foliant.llm import oracles, queries

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    r = queries()["op11_lexical_search"](spark, d)
    assert dict(r.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(tuple(x) for x in r.collect()) == sorted(con.sql(oracles()["op11_lexical_search"]).fetchall())
