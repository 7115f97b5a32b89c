"""Operator 8, language-model scoring by deleted interpolation.

The probability of a token after its predecessor is a mixture of the maximum-likelihood bigram estimate, the
unigram estimate and the uniform one; the mixture weights depend on how often the context was seen (buckets
by powers of two). Counts come from all training texts: each segment sends its distinct n-grams with their
training counts to the owners of hash ranges, which add them up and answer each segment with the totals of
its n-grams in the same order (so answers carry no keys). What is sent is a row for each owner that has one of
the segment's n-grams, so never more rows than distinct n-grams of segments. Neither a frequent word nor a large source makes a
hot partition, since a segment sends an n-gram once.

The weights are learned by expectation-maximisation on held-out counts: for each training text, the text's
own counts are deleted from the totals and its tokens are predicted from the rest. The tokens' estimates are
gathered in cells of a fixed grid (context bucket, bigram and unigram probability in quarters of a power of
two), so the driver's loop runs over a bounded table. How the texts lie in files and segments does not matter.

n-grams are 64-bit hashes; of n distinct ones two share a hash with odds n^2 / 2^65.

Results for odd rows: a null or empty text is the end token alone. Without training texts N and V are 0 and
every token has base probability 1 / 1 and model probability 1. Rows that share a doc_id are scored one by
one; a null doc_id counts as ''. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._bytes import LOWER, mixed, word_hashes, word_spans
from foliant.llm._segments import few_segments, opened, packed, packed_counts, rows_of, text_segments, unpacked, unpacked_counts
from foliant.llm._tables import documents, fold_of_value, stored, text_bytes

SEGMENT_BYTES = 3 << 20
#: Text bytes whose n-grams one owner of a hash range adds up, on average.
OWNER_BYTES = 12 << 20
EM_ROUNDS = 40
BUCKETS = 32
_END, _BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_QUARTERS = 4
_NONE = 1023  # the cell of probability zero


class Tokens:
    """The tokens of a segment, and its distinct unigrams and bigrams with their training counts."""

    def __init__(self, row: dict, training: Callable[[int | None], bool]):
        self.ids, data, offsets = opened(row)
        data = LOWER[data]
        starts, ends, text = word_spans(data, offsets)
        n = len(self.ids)
        before = np.searchsorted(text, np.arange(n + 1))
        self.token = np.full(len(starts) + n, _END, dtype=np.uint64)
        self.token[np.arange(len(starts)) + text] = word_hashes(data, starts, ends)
        self.first = before[:-1] + np.arange(n)  # each text's first token
        self.size = np.diff(before) + 1
        self.text = np.repeat(np.arange(n), self.size)
        previous = np.concatenate([[_BEGIN], self.token[:-1]])
        previous[self.first] = _BEGIN
        pair = mixed(previous * np.uint64(0x9E3779B97F4A7C15) + self.token)
        self.train = np.array([training(i) for i in self.ids], dtype=bool)
        own = self.train[self.text]
        self.word, self.word_of = np.unique(self.token, return_inverse=True)
        del data, starts, ends, text, previous
        self.pair, self.pair_of = np.unique(pair, return_inverse=True)
        del pair
        self.word_count = np.bincount(self.word_of[own], minlength=len(self.word))
        self.pair_count = np.bincount(self.pair_of[own], minlength=len(self.pair))
        self.context_of = np.concatenate([[0], self.word_of[:-1]])  # a text's first token has the begin of the text instead
        self.is_first = np.zeros(len(self.token), dtype=bool)
        self.is_first[self.first] = True


def _counting_task(bits: int, training: Callable[[int | None], bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                t = Tokens(row, training)
                rows = []
                for order, grams, count in ((1, t.word, t.word_count), (2, t.pair, t.pair_count)):
                    own = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
                    cut = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
                    rows += [(order, int(own[a]), row["segment"], packed(grams[a:b]), packed_counts(count[a:b])) for a, b in zip(cut, cut[1:], strict=False)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["n", "owner", "segment", "grams", "counts"])

    return run


def _text_count_task(training: Callable[[int | None], bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(training, ids)) for ids in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    return run


def _adding_task(rows: pa.Table) -> pa.Table:
    """Totals of one hash range, for each segment in the order in which it sent its n-grams."""
    grams = [unpacked(x.as_buffer()) for x in rows.column("grams")]
    counts = np.concatenate([unpacked_counts(x.as_buffer()) for x in rows.column("counts")])
    unique, back = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(back, weights=counts, minlength=len(unique)).astype(np.int64)
    answers, at = [], 0
    for g in grams:
        answers.append(packed_counts(total[back[at : at + len(g)]]))
        at += len(g)
    n = len(answers)
    seen, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
    seen[0], sums[0] = int((total > 0).sum()), int(total.sum())
    return pa.table({"n": rows.column("n"), "owner": rows.column("owner"), "segment": rows.column("segment"), "answer": pa.array(answers, pa.binary()), "distinct_grams": seen, "total": sums})


ANSWERS = "n int, owner long, segment long, answer binary, distinct_grams long, total long"


class Estimates:
    """Counts that a segment's tokens need, from its answers."""

    def __init__(self, t: Tokens, answers: pa.Table, texts: int):
        rows = sorted(answers.select(["n", "owner", "answer"]).to_pylist(), key=lambda r: (r["n"], r["owner"]))
        word, pair = (np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(r["answer"]) for r in rows if r["n"] == n)]) for n in (1, 2))
        self.word, self.pair = word[t.word_of], pair[t.pair_of]
        self.context = np.where(t.is_first, texts, word[t.context_of])


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(b, a.shape) > 0)


def _cell(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.minimum(np.rint(-np.log2(np.maximum(p, 1e-300)) * _QUARTERS), _NONE - 1), _NONE).astype(np.int64)


def _cells_task(training: Callable[[int | None], bool], size: tuple[int, int, int]):
    tokens, words, texts = size

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, int] = {}
        for row in left.to_pylist():
            t = Tokens(row, training)
            e = Estimates(t, right, texts)
            own = np.flatnonzero(t.train[t.text])
            # what the token's own text has of each n-gram
            deleted = []
            for grams in (t.word_of, t.pair_of):
                _, back, count = np.unique(t.text[own] * np.int64(len(t.token) + 1) + grams[own], return_inverse=True, return_counts=True)
                deleted.append(count[back])
            mine = np.zeros(len(t.token), np.int64)
            mine[own] = deleted[0]
            context = np.where(t.is_first[own], e.context[own] - 1, e.context[own] - np.concatenate([[0], mine[:-1]])[own])
            p1 = _ratio(e.word[own] - deleted[0], tokens - t.size[t.text[own]])
            p2 = _ratio(e.pair[own] - deleted[1], context)
            code = (_bucket(context) * (_NONE + 1) + _cell(p2)) * (_NONE + 1) + _cell(p1)
            for c, n in zip(*np.unique(code, return_counts=True), strict=True):
                found[int(c)] = found.get(int(c), 0) + int(n)
        return pa.table({"cell": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    return run


def mixture_weights(cell: np.ndarray, n: np.ndarray, words: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """BUCKETS x 3 weights (bigram, unigram, uniform) from held-out cells, by expectation-maximisation. A
    bucket without held-out tokens has the weights of the nearest lower one that has some."""
    bucket, c2, c1 = cell // (_NONE + 1) ** 2, cell // (_NONE + 1) % (_NONE + 1), cell % (_NONE + 1)
    p = np.stack([*(np.where(c == _NONE, 0.0, 2.0 ** (-c / _QUARTERS)) for c in (c2, c1)), np.full(len(cell), 1.0 / (words + 1))], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
        some = new.sum(axis=1) > 0
        weights[some] = new[some] / new[some].sum(axis=1, keepdims=True)
    seen = np.bincount(bucket, weights=n, minlength=BUCKETS) > 0
    for b in range(1, BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1]
    return np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum(axis=1, keepdims=True)


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scoring_task(training: Callable[[int | None], bool], size: tuple[int, int, int], weights: np.ndarray):
    tokens, words, texts = size

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for row in left.to_pylist():
            t = Tokens(row, training)
            e = Estimates(t, right, texts)
            w = weights[_bucket(e.context)]
            p = w[:, 0] * _ratio(e.pair, e.context) + w[:, 1] * _ratio(e.word, tokens) + w[:, 2] / (words + 1)
            base = np.log10((e.word + 1) / (tokens + words + 1))
            sums = [np.add.reduceat(x, t.first) for x in ((e.word > 0).astype(np.int64), base, np.log10(p) if tokens else np.zeros(len(p)))]
            found.append(pa.table({"doc_id": pa.array(t.ids, pa.int64()), "train": t.train, "n_tokens": t.size.astype(np.int64), "n_known": sums[0], "train_tokens": np.full(len(t.ids), tokens), "base_score": sums[1], "score": sums[2]}))
        return pa.concat_tables(found) if found else pa.table({k: pa.array([], v) for k, v in (("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    return run


def score(docs: DataFrame, training: Callable[[int | None], bool]) -> DataFrame:
    """Token counts and scores of each row of ``docs`` (doc_id, text); ``training`` says of a doc_id whether
    the counts include its texts."""
    spark = docs.sparkSession
    bits = max(0, int(np.ceil(np.log2(max(1, text_bytes(docs) / OWNER_BYTES)))))
    segments = text_segments(docs, SEGMENT_BYTES)
    sent = segments.mapInArrow(_counting_task(bits, training), "n int, owner long, segment long, grams binary, counts binary")
    with few_segments(spark):
        answers = stored(sent.groupBy("n", "owner").applyInArrow(_adding_task, ANSWERS), "answers")
    sizes = {r.n: (r.total, r.seen) for r in answers.groupBy("n").agg(F.sum("total").alias("total"), F.sum("distinct_grams").alias("seen")).collect()}
    texts = segments.select("doc_ids").mapInArrow(_text_count_task(training), "n long").agg(F.sum("n")).first()[0] or 0
    size = (*sizes.get(1, (0, 0)), texts)
    own = answers.select("n", "owner", "segment", "answer")
    held = segments.groupBy("segment").cogroup(own.groupBy("segment")).applyInArrow(_cells_task(training, size), "cell long, n long")
    cells: pd.DataFrame = held.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    weights = mixture_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64), size[1])
    return segments.groupBy("segment").cogroup(own.groupBy("segment")).applyInArrow(_scoring_task(training, size, weights), SCORES)


def in_training(doc_id: int | None) -> bool:
    """The query's training part."""
    return fold_of_value(doc_id, 7) != 2


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir), in_training)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLES: dict[str, str] = {}
