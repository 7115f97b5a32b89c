"""Operator 1 against a brute-force version, and odd rows."""

import re
from collections import Counter

from foliant.llm import quality_rules as Q


def plain(text):
    t = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in t.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts(docs, rows):
    got = Q.quality(docs).collect()
    want = {i: plain(t) for i, t, *_ in rows}
    assert len(got) == len(rows) and {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert any(w[4] for w in want.values()) and any(not r.base_failed for r in got)


def test_rules_decide(spark):
    good = " ".join(f"the river{i} of w{i} and" for i in range(30))
    rows = [(1, good), (2, good.replace("the", "x7").replace("of", "q9").replace("and", "z")), (3, good.replace("w", "#$% ")), (4, "\n".join(f"w{i} the" for i in range(60))), (5, " ".join(f"{'q' * 30}{i} the" for i in range(40)))]
    got = {r.doc_id: r for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and not got[1].base_failed
    assert not got[2].kept and not got[2].rule_stop_word_ratio
    assert not got[3].kept and not got[3].rule_symbol_ratio
    assert not got[5].kept and not got[5].rule_mean_word_length_high
    assert all(r.kept == (not r.base_failed and all(r[f"rule_{n}"] for n, *_ in Q.RULES)) for r in got.values())
    own = Q.quality(spark.createDataFrame(rows, "doc_id long, text string"), [("short", "n_words", "<=", 100.0)])
    assert {r.doc_id for r in own.filter("kept").collect()} == {r.doc_id for r in own.collect() if r.n_words <= 100 and not r.base_failed} == {5}


def test_a_long_text(spark):
    text = " ".join(f"w{i}" for i in range(70_000)) + " w5 w6 w7 w8"
    got = Q.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(got[c] for c in COLUMNS) == plain(text)


def test_odd_rows(spark, empty):
    assert Q.quality(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (None, None, "y"), (2, "", "z"), (3, " \n\t ", "z")], "doc_id long, text string, n_words string")
    got = sorted(((r.doc_id, *(r[c] for c in COLUMNS), r.kept) for r in Q.quality(odd).collect()), key=str)
    none = (0, 0, 0, 0, 0, True, False)
    assert got == sorted([(1, 3, 3, 0, 0, 0, True, False), (1, 3, 3, 0, 0, 0, True, False), (None, *none), (2, *none), (3, *none)], key=str)
