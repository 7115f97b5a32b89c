"""Operator 5: held-out accuracy, and small cases against a plain version."""

from collections import Counter
from math import exp, log

import numpy as np
import pytest
from foliant.llm import language_id as L
from foliant.llm._bytes import mixed


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = L.op5_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_counts_match_a_plain_count(spark, docs, rows):
    (model,) = L.train(docs)
    plain = {}
    for _, text, lang, *_ in rows:
        if text is not None and lang is not None:
            who, what, _ = L.ngrams([text.encode()])
            plain.setdefault(lang, Counter()).update(what.tolist())
    assert model.languages == sorted(plain)
    for j, lang in enumerate(model.languages):
        total = sum(plain[lang].values()) + L.ALPHA * L.BUCKETS
        for b in (*list(plain[lang])[:50], 0):
            assert model.matrix[b, j] == pytest.approx(log((plain[lang][b] + L.ALPHA) / total), rel=1e-5)


def plain_ngrams(text):
    """Buckets of the 2- and 3-grams, one by one."""
    low = f" {text.lower()} "
    code = [ord(c) if c.isalpha() else 32 for c in low]
    out = []
    for n in (2, 3):
        for i in range(len(code) - n + 1):
            if any(c.isalpha() for c in low[i : i + n]):
                h = n
                for c in code[i : i + n]:
                    h = (h * 0x100000001B3 + c) % 2**64
                out.append(int(mixed(np.array([h], np.uint64))[0] >> np.uint64(48)))
    return out


def plain_predictions(rows, train):
    """Multinomial naive Bayes over all rows, in dictionaries."""
    counts, texts = {}, Counter()
    for _, text, lang in train:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(plain_ngrams(text))
            texts[lang] += 1
    out = {}
    for i, text, _ in rows:
        grams = plain_ngrams(text or "")
        if not any(c.isalpha() for c in text or ""):
            out[i] = (L.UNKNOWN, 0.0)
            continue
        z = {}
        for lang, own in counts.items():
            total = sum(own.values()) + L.ALPHA * L.BUCKETS
            z[lang] = sum(log((own[g] + L.ALPHA) / total) for g in grams) * min(1.0, L.EVIDENCE / len(grams)) + log(texts[lang] / sum(texts.values()))
        best = max(sorted(z), key=z.get)
        out[i] = (best, 1 / sum(exp(v - z[best]) for v in z.values()))
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_predictions_are_those_of_plain_naive_bayes(spark, rows, block):
    """Seven languages, in one block or in four."""
    some = [(i, t, None if i % 11 == 0 else f"l{i % 7}") for i, t, *_ in rows]
    docs = spark.createDataFrame(some, "doc_id long, text string, lang string").repartition(3)
    want = plain_predictions(some, some)
    models = L.train(docs, block=block)
    assert [len(m.languages) for m in models] == ([7] if block == 256 else [2, 2, 2, 1])
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, models).collect()}
    assert got.keys() == want.keys()
    for i, (lang, score) in want.items():
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-4)
        name, own = L.score_texts(models, [next(t for j, t, _ in some if j == i).encode() if next(t for j, t, _ in some if j == i) else b""])
        assert name[0] == lang and own[0] == pytest.approx(score, abs=1e-4)


def test_more_languages_than_a_task_holds(spark, monkeypatch):
    rows = [(i, f"text {chr(97 + i % 26)}{chr(97 + i // 26)} words", f"l{i:03}") for i in range(300)]
    models = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2))
    assert [len(m.languages) for m in models] == [256, 44]


def test_ngrams_stay_within_texts():
    together, alone = L.ngrams([b"ab", b"", b"C d!"]), [L.ngrams([x]) for x in (b"ab", b"", b"C d!")]
    for i, (_, what, letter) in enumerate(alone):
        assert sorted(together[1][together[0] == i].tolist()) == sorted(what.tolist()) and together[2][i] == letter[0]


def test_odd_rows(spark, docs, empty):
    model = L.train(docs)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    for i in (0, 1, 2, 8):  # null, empty, blank, no letter
        assert (got[i].lang_pred, got[i].score) == (L.UNKNOWN, 0.0)
    assert len(got) == docs.count()
    assert L.identify(empty, model).count() == 0
    nothing = L.train(empty)
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {L.UNKNOWN}
    odd = spark.createDataFrame([(1, "a b c", "x", 1.0), (1, None, "y", 2.0), (None, "an re", "z", 0.0)], "doc_id long, text string, lang_pred string, score double")
    assert L.identify(odd, model).count() == 3
    assert L.keep_identified(odd, model, 0.0).columns == odd.columns


def test_keep(docs):
    model = L.train(docs)
    kept = {r.doc_id for r in L.keep_identified(docs, model).collect()}
    assert kept == {r.doc_id for r in L.identify(docs, model).collect() if r.lang_pred != L.UNKNOWN and r.score >= L.LEAST_SCORE}
