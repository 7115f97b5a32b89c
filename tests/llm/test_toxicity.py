"""Operator 3: held-out accuracy, gradients and odd rows."""

import time

import numpy as np
import pyarrow as pa
from foliant.llm import toxicity as T


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = T.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in held)
    assert hit >= 0.65 * sum(r.toxic for r in held) and hit >= 0.65 * sum(r.predicted for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_gradients():
    rng = np.random.default_rng(1)
    m = T._new_model(rng)
    hashes = rng.integers(1, 2**63, 40, dtype=np.uint64)
    before, label, weight = np.array([0, 12, 12, 40]), np.array([1, 0, 1], np.float32), np.ones(3)

    def loss():
        z = T.raw_outputs(m, hashes, before)
        return float((np.log1p(np.exp(z)) - label * z).mean())

    grads, _ = T._step(m, hashes, before, label, weight)
    for p, g in zip([*m.filters, m.out], [*grads[: len(T.WIDTHS)], grads[-2]], strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at].copy()
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-4


def test_a_text_scores_the_same_in_any_batch():
    m = T._new_model(np.random.default_rng(2))
    texts = pa.array(["one two", None, "", "a b c d e f", "x"])
    together = np.concatenate([T.raw_outputs(m, h, b) for h, b in T.words_of(texts)])
    alone = [np.concatenate([T.raw_outputs(m, h, b) for h, b in T.words_of(texts[i : i + 1])])[0] for i in range(5)]
    assert np.allclose(together, alone, atol=1e-5)


def plain_logit(m, hashes):
    """The convolution written out: every filter at every word, zeros behind the text, rectified maxima, one sum."""
    row = lambda h: np.concatenate([m.tables[0][1 + int(h >> np.uint64(32)) % (T.TABLE - 1)], m.tables[1][1 + int(h & np.uint64(0xFFFFFFFF)) % (T.TABLE - 1)]])
    x = [row(h) for h in hashes] or [np.zeros(2 * T.HALF)]
    x += [np.zeros(2 * T.HALF)] * max(T.WIDTHS)
    z, j = m.out_bias, 0
    for w, filters, bias in zip(T.WIDTHS, m.filters, m.biases, strict=True):
        for f in range(T.FILTERS):
            best = max(sum(float(x[i + k] @ filters[k, :, f]) for k in range(w)) + float(bias[f]) for i in range(max(1, len(hashes))))
            z += max(best, 0.0) * float(m.out[j])
            j += 1
    return z


def test_scores_are_those_of_the_plain_convolution(spark, docs, rows, monkeypatch):
    m = T._new_model(np.random.default_rng(5))
    for b in m.biases:
        b += np.random.default_rng(6).normal(0, 0.1, T.FILTERS).astype(np.float32)
    m.out_bias, m.scale, m.shift = 0.3, 2.0, -0.1
    want = {}
    for i, text, *_ in rows:
        (hashes, _), = list(T.words_of(pa.array([text], pa.string())))
        want[i] = 1 / (1 + np.exp(-(2.0 * plain_logit(m, hashes) - 0.1)))
    for n in (1, 7):
        got = {r.doc_id: r.score for r in T.score(docs.repartition(n), m).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    text = pa.array(["one two three four five six seven " * 30, "x", "", "a b"])
    whole = np.concatenate([T.raw_outputs(m, h, b) for h, b in T.words_of(text)])
    for block in (1, 2, 7, 50):
        monkeypatch.setattr(T, "BLOCK_WORDS", block)
        assert np.allclose(np.concatenate([T.raw_outputs(m, h, b) for h, b in T.words_of(text)]), whole, atol=1e-5)


def test_a_long_text_silences_no_others():
    rows = [(k, 100) for k in range(50)]
    assert T.fitting_rows([rows[0], (99, 27_000), *rows[1:]], 20_000) == [k for k, _ in rows]
    assert T.fitting_rows([(1, 60), (2, 50), (3, 40), (4, 0)], 100) == [1, 3, 4]
    assert T.fitting_rows([(1, 900), (2, 800)], 100) == [2] and T.fitting_rows([], 100) == []


def test_long_texts_are_learned_from_and_the_sample_is_bounded(spark):
    texts = [(i, ("bad worse " if i % 2 else "fine good ") * 1200, "en") for i in range(40)]
    docs = spark.createDataFrame(texts + texts[:5], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    m = T.train(docs, labels, sample_bytes=150_000)
    s = {r.doc_id: r.score for r in T.score(docs, m).collect()}
    assert min(v for i, v in s.items() if i % 2) >= 0.7 > max(v for i, v in s.items() if i % 2 == 0)
    longer = docs.unionAll(spark.createDataFrame([(1000 + i, "bad worse " * 20_000, "en") for i in range(9)], docs.schema))
    more = labels.unionAll(spark.createDataFrame([(1000 + i, 1) for i in range(9)], labels.schema))
    s = {r.doc_id: r.score for r in T.score(longer, T.train(longer, more, sample_bytes=150_000)).collect()}
    assert min(v for i, v in s.items() if i % 2 or i > 999) >= 0.7 > max(v for i, v in s.items() if i % 2 == 0 and i < 1000)


def test_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.train(docs, none) is None and {r.score for r in T.score(docs, None).collect()} == {0.0}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    assert T.score(docs, model).count() == docs.count()
    assert T.score(empty, model).count() == 0
    odd = spark.createDataFrame([(1, "a", "en", "q"), (1, "a", None, "q"), (None, None, "de", "r")], "doc_id long, text string, lang string, score string")
    assert T.score(odd, model).count() == 3


def test_words_beyond_the_first_rows_are_learned(spark):
    """The rows that the driver begins with are not all that the model knows."""
    texts = [(i, f"{('vile', 'calm')[i % 2]}{i // 2 % 30} some plain words {i}", "en") for i in range(1200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(1200)], "doc_id long, toxic int")
    m, start = T.train(docs, labels, sample=10), T._new_model(np.random.default_rng(11))
    moved = 0
    for k in range(30):
        (hashes, _), = list(T.words_of(pa.array([f"vile{k}"])))
        slot = 1 + int(hashes[0] >> np.uint64(32)) % (T.TABLE - 1)
        moved += bool((m.tables[0][slot] != start.tables[0][slot]).any())
    assert moved >= 20


def test_what_a_long_text_leaves_has_its_responses(monkeypatch):
    m, words = T._new_model(np.random.default_rng(3)), np.random.default_rng(4).integers(1, 2**63, 900, dtype=np.uint64)
    whole = T._pooled(m, words, np.array([0, 900]))
    monkeypatch.setattr(T, "BLOCK_WORDS", 64)
    less = T.shortened(m, words)
    assert len(less) <= 216 and (T._pooled(m, less, np.array([0, len(less)])) >= whole - 1e-5).all()


def test_fitting_does_not_go_over_all_words_for_each_text():
    rng = np.random.default_rng(7)
    words = rng.integers(1, 2**63, 100_000, dtype=np.uint64)
    texts = [rng.choice(words, 200) for _ in range(4000)]
    began = time.process_time()
    T.fit(texts, np.arange(4000) % 2 * np.float32(1), epochs=0)
    assert time.process_time() - began < 5


def test_words_among_others():
    known = np.array([2, 5, 9, 2**64 - 1], np.uint64)
    for x in ([], [0, 2, 3, 5, 5, 2**64 - 1, 9, 10], [1]):
        x = np.array(x, np.uint64)
        assert (T._among(x, known) == np.isin(x, known)).all() and not T._among(x, known[:0]).any()
