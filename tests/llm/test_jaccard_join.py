"""Operator 12 against a brute-force version."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from foliant.llm import jaccard_join as J


def plain_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def found(spark, rows, **kind):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in J.linked(docs, **kind).collect()), key=str)


def edited(rng, words, k):
    out, gap = list(words), max(1, len(words) // max(1, k))
    for j in range(k):
        out[min(len(out) - 1, j * gap + rng.randrange(gap))] = f"new{rng.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def rows():
    """Near copies from 0.6 to 1 of all sizes, chains, a large group of near copies, texts of two common passages."""
    rng, texts = random.Random(12), []
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for n in (4, 5, 6, 7, 8, 9, 10, 12, 20, 33, 70, 300):
        for k in (0, 1, 2, 3, n // 40, n // 25, n // 18):
            words = fresh(n)
            texts += [words, edited(rng, words, k), words + fresh(k), words[: len(words) - k], words[k:] + fresh(1)]
    base = fresh(200)
    texts += [edited(rng, base, rng.randrange(0, 12)) for _ in range(150)]
    passages = [fresh(60) for _ in range(12)]
    texts += [rng.choice(passages) + rng.choice(passages) + fresh(rng.choice((0, 1, 9, 40))) for _ in range(250)]
    rng.shuffle(texts)
    out = [(k, " ".join(t)) for k, t in enumerate(texts)]
    return [*out, (3, out[7][1].upper()), (None, out[8][1]), (None, "only here now"), (900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (2, "a b")]


@pytest.mark.parametrize("most", [J.BROADCAST, 0])
def test_rows(spark, rows, monkeypatch, most):
    """Frequent tokens broadcast, and joined."""
    monkeypatch.setattr(J, "CLASSES", (8, 40))
    assert found(spark, rows, most=most) == plain(rows)


def test_signatures_lose_no_pair():
    """Sets at and around the least similarity, with any classes of their tokens, share a signature."""
    rng = np.random.default_rng(5)
    for trial in range(1500):
        n = int(rng.integers(4, 90))
        x = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        out = int(rng.integers(0, len(x) // 4 + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[out:], rng.integers(1, 2**63, int(rng.integers(0, out + 2)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if min(len(x), len(y)) < 4 or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        salt, share = int(rng.integers(1 << 30)), trial % 5
        kind = lambda t: np.where(J.mixed(t + np.uint64(salt)) % np.uint64(5) < share, J.mixed(t) % np.uint64(2) + 2, 1).astype(np.uint8)  # noqa: B023, E731
        assert len(np.intersect1d(np.concatenate(J.signatures(x, kind(x), len(x))), np.concatenate(J.signatures(y, kind(y), len(y))))), (n, trial)
        assert J.may_link(J.bitmap(x), len(x), J.bitmap(y), len(y))


@pytest.mark.parametrize("share", [1.0, 0.9])
def test_prefixes_never_fall_short(share):
    rng = np.random.default_rng(6)
    for n in [*range(4, 200), 1023, 1024, 1638, 1639, 5000]:
        own = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        kinds = np.where(rng.random(len(own)) < share, rng.integers(2, 4, len(own)), 1).astype(np.uint8)
        assert sum(map(len, J.signatures(own, kinds, len(own)))) < 40 * n


def test_a_group_of_near_copies_takes_few_comparisons(spark, monkeypatch):
    """Pairs that are verified grow with the texts, not with their square."""
    rng, seen = random.Random(4), []
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(edited(rng, base, rng.randrange(1, 4)))) for k in range(500)]
    plain_stored = J.stored

    def counted(df, name):
        out = plain_stored(df, name)
        if name == "pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(J, "stored", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in J.linked(docs).collect()} == {0}
    assert sum(seen) < 3000


def test_a_passage_that_many_texts_hold_makes_few_pairs(spark, monkeypatch):
    """Texts that a passage alone brings together are not compared one by one; near copies among them are found."""
    rng, seen = random.Random(9), []
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(126)
    texts = [passage + fresh(24) for _ in range(300)]
    texts += [edited(rng, t, 1) for t in texts[:20]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    plain_stored = J.stored

    def counted(df, name):
        out = plain_stored(df, name)
        if name == "pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(J, "stored", counted)
    assert found(spark, rows) == plain(rows)
    assert sum(seen) < 2000


def test_empty_and_clashing_columns(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
    odd = spark.createDataFrame([(1, "a b c", 5, 1), (2, "A b c", 6, 2), (None, "x", 1, 1)], "doc_id long, text string, n int, key int")
    assert sorted((tuple(r) for r in J.linked(odd).collect()), key=str) == [(1, 1, 1), (2, 1, 1), (None, 1, None)]


def test_long_text(spark):
    words = [f"w{k}" for k in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(random.Random(1), words, 8000))), (3, " ".join(words[:200_000]))]
    assert [r[2] for r in found(spark, rows)] == [1, 1, 3]


def test_query(spark):
    from foliant.llm import queries

    r = queries()["op12_jaccard_join"](spark, "/root/testdata/sf0.001")
    assert dict(r.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(x) for x in r.collect()), key=str) == plain(rows)


def test_small_bitmaps_rule_out_no_link(spark):
    rng, rows, links = np.random.default_rng(8), [], {}
    for k in range(600):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[int(rng.integers(0, len(x) // 4 + 1)) :], rng.integers(1, 2**63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        links[k] = 100 * both >= 80 * (len(x) + len(y) - both)
        rows.append((k, len(x), *map(int, J.small_bitmaps([x])[0]), len(y), *map(int, J.small_bitmaps([y])[0])))
    names = ["k", "n", *J.WORDS, "o_n", *[f"o_{w}" for w in J.WORDS]]
    able = {r.k for r in spark.createDataFrame(rows, names).filter(J.may_be_similar("o")).collect()}
    assert {k for k, x in links.items() if x} <= able and sum(links.values()) > 50
