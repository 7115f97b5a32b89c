"""Operator 8 against a brute-force version."""

import re
from collections import Counter
from math import log10

import numpy as np
import pytest
from foliant.llm import lm_scoring as L


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w] + [None]


def test_rows(docs, rows, monkeypatch):
    caught = {}
    learn = L.mixture_weights
    monkeypatch.setattr(L, "mixture_weights", lambda cell, n, words: caught.setdefault("w", learn(cell, n, words)))
    monkeypatch.setattr(L, "OWNER_BYTES", 1 << 12)
    got = {r.doc_id: r for r in L.score(docs, L.in_training).collect()}
    seqs = {i: tokens(t) for i, t, *_ in rows}
    train = {i: s for i, s in seqs.items() if L.in_training(i)}
    one = Counter(w for s in train.values() for w in s)
    two = Counter(p for s in train.values() for p in zip([""] + s, s))
    context = one.copy()
    context[""] = len(train)
    N, V, w = sum(one.values()), len(one), caught["w"]
    for i, s in seqs.items():
        p = [w[L._bucket(np.array([context[a]]))[0]] @ [two[a, b] / context[a] if context[a] else 0, one[b] / N, 1 / (V + 1)] for a, b in zip([""] + s, s)]
        r = got[i]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (i in train, len(s), sum(one[x] > 0 for x in s), N)
        assert r.base_score == pytest.approx(sum(log10((one[x] + 1) / (N + V + 1)) for x in s))
        assert r.score == pytest.approx(sum(map(log10, p)))
    # on the held-out texts the mixture beats the base
    held = [r for i, r in got.items() if i not in train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_are_the_maximum():
    """Against a grid search over one bucket's likelihood."""
    rng = np.random.default_rng(3)
    cell = (5 * 1024 + rng.integers(4, 40, 60)) * 1024 + rng.integers(4, 60, 60)
    n = rng.integers(1, 50, 60).astype(float)
    w = L.mixture_weights(cell, n, 99, 400)[5]
    p = np.stack([2.0 ** (-(cell // 1024 % 1024) / 4), 2.0 ** (-(cell % 1024) / 4), np.full(60, 0.01)], axis=1)
    like = lambda x: (n * np.log(p @ x)).sum()
    best = max(like(np.array([a, b, 1 - a - b])) for a in np.linspace(0, 1, 51) for b in np.linspace(0, 1 - a, 51))
    assert like(w) >= best - 1e-3


def test_weights_come_from_all_training_texts(docs, rows, monkeypatch):
    """However the texts are dealt out to segments."""
    held, learn = [], L.mixture_weights
    monkeypatch.setattr(L, "mixture_weights", lambda cell, n, words: held.append(sorted(zip(cell, n))) or learn(cell, n, words))
    by_size = []
    for size, parts in ((1 << 9, 5), (1 << 20, 1)):
        monkeypatch.setattr(L, "SEGMENT_BYTES", size)
        by_size.append(sorted((r.doc_id, r.score) for r in L.score(docs.repartition(parts), L.in_training).collect()))
    assert sum(n for _, n in held[0]) == sum(len(tokens(t)) for i, t, *_ in rows if L.in_training(i))
    assert held[0] == held[1]
    assert by_size[0] == [(i, pytest.approx(x)) for i, x in by_size[1]]


def test_odd_rows(spark, docs, empty):
    assert L.score(empty, L.in_training).count() == 0
    untrained = L.score(docs, lambda i: False).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in untrained} == {(0, 0, 0.0, 0.0)}
    odd = spark.createDataFrame([(1, "a b", 3), (1, "a b", 4), (None, None, 5)], "doc_id long, text string, score int")
    assert sorted(r.n_tokens for r in L.score(odd, L.in_training).collect()) == [1, 3, 3]


def test_segments_are_held_a_few_at_a_time(spark):
    """However large a task's file of segments: in its row groups, and in what a Python worker gets at once."""
    import pyarrow.parquet as pq
    from foliant.llm import _segments as S

    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(k, rng.bytes(1 << 19).hex()) for k in range(40)], "doc_id long, text string").coalesce(1)
    segments = S.text_segments(docs, 1 << 20)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in segments.inputFiles()]
    assert sum(f.metadata.num_rows for f in files) >= 40
    groups = [f.metadata.row_group(k) for f in files for k in range(f.num_row_groups)]
    assert max(sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups) <= S.GROUP_BYTES + (2 << 20)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    with S.few_segments(spark):
        held = [r.n for r in segments.mapInArrow(sizes, "n long").collect()]
    assert sum(held) >= 40 << 20 and max(held) <= S.BATCH_BYTES + (2 << 20)


def test_packing():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (L.unpacked(L.packed(x)) == x).all() and len(L.unpacked(L.packed(x[:0]))) == 0
    c = rng.integers(0, 2**31, 77)
    assert (L.unpacked_counts(L.packed_counts(c)) == c).all()
