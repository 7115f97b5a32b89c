"""Small documents with the odd rows that every corpus operator must survive."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows(seed: int = 7, n: int = 120) -> list[tuple]:
    """Words, repeated lines, copies, near copies, nulls, empty and blank texts, a long text, equal ids."""
    rng = random.Random(seed)
    words = [w + x for w in ("re", "tion", "éa", "Über", "an", "the", "idiot", "o") for x in ("", "n", "st", "çe", "a", "ß")]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [sentence(14) for _ in range(6)]
    texts: list[str | None] = [None, "", " \n\t ", "a", "a b", "a b c a b c a b c", "\x00\x00 zero \x00", "x" * 300, "12 34 56 !! 78", "a\r\nb\n\n\nc\n"]
    while len(texts) < n:
        lines = [sentence(rng.randrange(1, 12)) if rng.random() < 0.7 else rng.choice(shared) for _ in range(rng.randrange(1, 12))]
        texts.append("\n".join(lines) if rng.random() < 0.8 else " ".join(lines))
        if rng.random() < 0.2:
            texts.append(texts[-1])
        if rng.random() < 0.2:
            texts.append(texts[-1] + " " + rng.choice(words))
    texts.append("\n".join(shared * 40))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
