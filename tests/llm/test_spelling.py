"""Operator 13 against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest
from foliant.llm import spelling as S

LETTERS = "abcdeéÿßoprst"


def plain_words(rows):
    """Words of at least 6 code points and 5 occurrences."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    words = plain_words(rows)
    out = {}
    for w, n in words.items():
        near = sorted(((-words[v], v) for v in words if is_near(v, w)))
        form = near[0] if near and -near[0][0] >= 5 * n else None
        out[w] = [n, len(near), form[1] if form else None, -form[0] if form else None]
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def found(docs):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in S.spelling_groups(docs).collect()}


def edited(rng, word):
    at, c = rng.randrange(len(word)), rng.choice(LETTERS)
    return rng.choice([word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]])


@pytest.fixture(scope="module")
def rows():
    """Words with chains of variants, of falling frequency; odd rows."""
    rng = random.Random(13)
    bag = []
    for _ in range(60):
        word, n = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(6, 12))), 700
        while n >= 4:
            bag += [word.upper() if rng.random() < 0.02 and word.isascii() else word] * n
            word, n = edited(rng, word), n // rng.choice([1.5, 4, 6])
            n = int(n)
    rng.shuffle(bag)
    rows = [(i, rng.choice([" ", ", ", "1", "\n"]).join(bag[k : k + 50])) for i, k in enumerate(range(0, len(bag), 50))]
    return [*rows, (None, " ".join(bag[:40])), (3, " ".join(bag[:30])), (4, None), (5, ""), (6, " 12 \x00 ! ÀÉ ж日本 "), (7, "Ünderß" * 3)]


def test_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows)
    assert len({x[4] for x in want.values()}) < len(want) and any(x[2] and x[2] != x[4] for x in want.values())
    assert found(docs) == want


def test_skewed_blocks_are_subdivided(spark):
    """A third of all words share a beginning, others an end; blocks of four words at most."""
    rng = random.Random(3)
    words = {"prefixes" + "".join(rng.choice("ab") for _ in range(8)) for _ in range(80)} | {"".join(rng.choice("ab") for _ in range(7)) + "suffixes" for _ in range(60)}
    words |= {edited(rng, w) for w in list(words)} | {"".join(rng.choice(LETTERS) for _ in range(6)) for _ in range(60)}
    words = sorted(w for w in words if len(w) >= 6)
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = {tuple(sorted((r.a, r.b))) for r in S.near_pairs(frame, 4).collect()}
    assert pairs == {(a, b) for a in words for b in words if a < b and is_near(a, b)}
    sizes = S.blocks(frame, 4).groupBy("block").count().collect()
    assert max(r["count"] for r in sizes) < 60


def test_long_text_in_pieces():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(200_000)) + " " + "x" * 3_000_000
    assert b"".join(S.pieces(text.encode(), 1000)).decode() == text
    assert dict(S.words_of(1, text.encode(), 10**9)) == {w.encode(): n for w, n in Counter(text.split()).items() if len(w) >= 6}


def test_empty_and_clashing_columns(spark):
    assert S.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(i, "farbig farbig", "x", 1) for i in range(4)], "doc_id long, text string, word string, n int")
    assert found(odd) == plain([(i, "farbig farbig") for i in range(4)])


def test_query(spark):
    from foliant.llm import queries

    r = queries()["op13_spelling"](spark, "/root/testdata/sf0.001")
    assert dict(r.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in r.collect()} == plain(rows)
