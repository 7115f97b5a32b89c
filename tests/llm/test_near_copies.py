"""The pipeline's near-dedup against a brute-force version on shingle sets."""

import random
import re

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
import pytest
from foliant.llm import near_copies as N


def plain_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """doc_ids that are the smallest of their group of near copies."""
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in root if find(i) == i)


def edited(rng, words, k):
    """The words with k of them changed, far apart."""
    out, gap = list(words), len(words) // k
    for j in range(k):
        out[j * gap + rng.randrange(gap)] = f"new{rng.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def copies():
    """Near copies at similarities from 0.6 to 1, chains of them, and texts that only share a passage."""
    rng, texts = random.Random(11), []
    for k in (1, 3, 5, 6, 7, 8, 10, 12):
        for _ in range(5):
            words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
            texts += [words, edited(rng, words, k)]
            if rng.random() < 0.5:
                texts.append(edited(rng, texts[-1], k))
    passage = [f"p{i}" for i in range(150)]
    texts += [passage + [f"q{rng.randrange(10**9)}" for _ in range(150)] for _ in range(12)]
    rng.shuffle(texts)
    return list(enumerate(" ".join(t) for t in texts))


def test_stage_keeps_one_of_near_copies(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()) == plain_kept(copies)


def test_odd_rows(spark, docs, rows, empty):
    assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == plain_kept([(i, t) for i, t, *_ in rows])
    assert N.keep_one(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5), (None, None, 6), (1, "a b", 7), (None, "c", 8), (2, "A  b", 9)], "doc_id long, text string, key int")
    assert sorted((r.key for r in N.keep_one(odd).collect())) == [5, 6, 7, 8]


def test_shingle_sets():
    texts = [None, "", "a", "A b", "a b c d e", "a b c d e f a b c d e", "x " * 40]
    h, out = next(N.shingles(pa.array(texts)))
    assert [len(np.unique(h[a:b])) for a, b in zip(out[:-1], out[1:])] == [len(plain_set(t)) for t in texts]
