"""Operator 5, language ID: multinomial naive Bayes over hashed character n-grams.

Every text becomes lower-cased code points in which all that is not a letter is one space; its 2- and
3-grams are hashed to ``BUCKETS`` counters. Training sums the counters by language over all training rows
in the tasks that read them and adds the sums up in a shuffle; the smoothed log-probability matrix
(``BUCKETS`` x languages) is broadcast, and each batch of texts is scored as a sparse matrix of n-gram
counts times that matrix.

Every language that has a training row is learned. The matrix is made and broadcast in blocks of ``BLOCK``
languages (BUCKETS * BLOCK * 4 bytes). Up to one block is one pass over the texts; further blocks are scored one after
the other, and a text's best language and normaliser so far are carried along in a table.

Results for odd rows: a null text, an empty one and one without a letter are ``und`` with score 0. Equal
log-probabilities go to the language whose name sorts first. Where nothing could be learned (no training
rows), every row is ``und``. Rows that share a doc_id are judged one by one; an empty table gives no rows.
Other columns of the input are not read.

The predicted language has the largest posterior where a text counts as ``EVIDENCE`` n-grams at most, and
``score`` is that posterior, so it stays below certainty for texts that fit no language well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._bytes import groups_of, mixed
from foliant.llm._tables import documents, fold_of, stored

BUCKETS = 1 << 16
ORDERS = (2, 3)
ALPHA = 0.5
BLOCK = 256
#: Languages whose counters a training task holds at a time.
HELD = 64
EVIDENCE = 24.0
BATCH_BYTES = 1 << 20
#: n-grams of a batch whose rows of the matrix are gathered at a time.
STEP = 1 << 16
UNKNOWN = "und"
#: Below this score ``keep_identified`` rejects a text.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Model:
    """languages[j] has the log-probabilities matrix[:, j] and the log prior priors[j]; a block of all languages."""

    languages: list[str]
    matrix: np.ndarray
    priors: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers and buckets of all n-grams, and whether each text has a letter."""
    wide = [f" {x.decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "replace") for x in texts]
    sizes = np.array([len(x) // 4 for x in wide], dtype=np.int64)
    code = np.frombuffer(b"".join(wide), "<u4")
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32)).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    has_letter = np.bincount(owner, weights=letter, minlength=len(texts)) > 0
    who, what = [], []
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h, some = np.full(m, n, dtype=np.uint64), np.zeros(m, dtype=bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + code[k : k + m]
            some |= letter[k : k + m]
        own = np.flatnonzero(some & (owner[:m] == owner[n - 1 :]))
        who.append(owner[own])
        what.append((mixed(h[own]) >> np.uint64(48)).astype(np.int64) % BUCKETS)
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has_letter
    return np.concatenate(who), np.concatenate(what), has_letter


def _batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    column = column.cast(pa.large_binary())
    sizes = np.array([0, *np.cumsum([x.as_buffer().size if x.is_valid else 0 for x in column])], dtype=np.int64)
    for first, last in groups_of(sizes, BATCH_BYTES):
        yield first, [x or b"" for x in column[first:last].to_pylist()]


def _counting_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in: text, lang. Rows out: lang, bucket, n; bucket -1 counts the texts."""
    found: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for name, total in found.items():
            own = np.flatnonzero(total)
            buckets = np.where(own == BUCKETS, -1, own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(buckets, pa.int32()), pa.array(total[own], pa.int64())], names=["lang", "bucket", "n"])
        found.clear()

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, texts in _batches(batch.column(0)):
            who, what, _ = ngrams(texts)
            names, own = np.unique(np.array(langs[first : first + len(texts)], dtype=object), return_inverse=True)
            key, n = np.unique(own[who] * np.int64(BUCKETS) + what, return_counts=True)
            cut, rows = np.searchsorted(key, np.arange(len(names) + 1) * np.int64(BUCKETS)), np.bincount(own, minlength=len(names))
            for j, name in enumerate(names.tolist()):
                if name not in found and len(found) >= HELD:
                    yield from counted()
                total = found.setdefault(name, np.zeros(BUCKETS + 1, dtype=np.int64))
                total[key[cut[j] : cut[j + 1]] - j * BUCKETS] += n[cut[j] : cut[j + 1]]
                total[-1] += rows[j]
    yield from counted()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", block: int = BLOCK) -> list[Model]:
    """Learn from all rows of ``docs`` whose ``lang`` is not null: a model for each block of languages by name."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = stored(rows.mapInArrow(_counting_task, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    texts = sorted((r.lang, r.n) for r in counts.filter("bucket = -1").collect())
    total, models = sum(n for _, n in texts), []
    for k in range(0, len(texts), block):
        names = [x for x, _ in texts[k : k + block]]
        at = docs.sparkSession.createDataFrame([(x, j) for j, x in enumerate(names)], "lang string, j int")
        table = counts.filter("bucket >= 0").join(F.broadcast(at), "lang").select("bucket", "j", "n").toArrow()
        full = np.zeros((BUCKETS, len(names)))
        full[np.asarray(table.column("bucket")), np.asarray(table.column("j"))] = np.asarray(table.column("n"))
        matrix = np.log((full + ALPHA) / (full.sum(axis=0) + ALPHA * BUCKETS))
        models.append(Model(names, matrix.astype(np.float32), np.log(np.array([n for _, n in texts[k : k + block]]) / total)))
    return models


def block_scores(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the block's best language (-1: the text has no letter), its log-posterior up to a constant, the
    log of the sum over the block's languages, and whether there is a letter."""
    who, what, has_letter = ngrams(texts)
    key, count = np.unique(who * np.int64(BUCKETS) + what, return_counts=True)
    row, col = key // BUCKETS, key % BUCKETS  # the batch as a sparse matrix
    sums, total = np.zeros((len(texts), len(model.languages))), np.bincount(row, weights=count, minlength=len(texts))
    for a in range(0, len(row), STEP):
        part = row[a : a + STEP]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums[part[cut]] += np.add.reduceat(model.matrix[col[a : a + STEP]].astype(np.float64) * count[a : a + STEP, None], cut, axis=0)
    z = sums * np.minimum(1.0, EVIDENCE / np.maximum(total, 1.0))[:, None] + model.priors
    best = z.argmax(axis=1)
    top = z[np.arange(len(texts)), best]
    return best, top, top + np.log(np.exp(z - top[:, None]).sum(axis=1)), has_letter


def score_texts(models: list[Model], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Name of the best language (UNKNOWN: none) and the score of each text."""
    name, top, sum_, letter = np.full(len(texts), UNKNOWN, dtype=object), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf), np.zeros(len(texts), bool)
    for m in models:
        best, own, log_sum, letter = block_scores(m, texts)
        better = own > top
        name[better] = np.array(m.languages, dtype=object)[best[better]]
        top, sum_ = np.maximum(top, own), np.logaddexp(sum_, log_sum)
    name[~letter] = UNKNOWN
    with np.errstate(invalid="ignore"):
        return name, np.where(letter, np.exp(top - sum_), 0.0)


def _passes(docs: DataFrame, models: list[Model], columns: str) -> DataFrame:
    """``docs`` (columns as in the DDL ``columns``, text among them) with name, top and sum after all blocks."""
    state = "name string, top double, sum double, letter boolean"
    rows = docs.select("*", F.lit(UNKNOWN).alias("name"), F.lit(float("-inf")).alias("top"), F.lit(float("-inf")).alias("sum"), F.lit(False).alias("letter"))
    at = docs.columns.index("text")
    for k, model in enumerate(models):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            languages = np.array(m.languages, dtype=object)
            for batch in batches:
                for first, texts in _batches(batch.column(at)):
                    part = batch.slice(first, len(texts))
                    name, top, sum_ = (part.column(i - 4) for i in range(3))
                    best, own, log_sum, letter = block_scores(m, texts)
                    before = np.asarray(top)
                    named = np.where(own > before, languages[best], np.array(name.to_pylist(), dtype=object))
                    news = [pa.array(named, pa.string()), pa.array(np.maximum(before, own)), pa.array(np.logaddexp(np.asarray(sum_), log_sum)), pa.array(letter)]
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(batch.num_columns - 4)), *news], names=batch.schema.names)

        rows = rows.mapInArrow(task, f"{columns}, {state}")
        if k + 1 < len(models):
            rows = stored(rows, "languages")
    return rows.withColumns({"name": F.when(F.col("letter"), F.col("name")).otherwise(UNKNOWN), "score": F.when(F.col("letter"), F.exp(F.col("top") - F.col("sum"))).otherwise(0.0)})


def identify(docs: DataFrame, models: list[Model], text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _passes(rows, models, "doc_id long, text string").select("doc_id", F.col("name").alias("lang_pred"), "score")


def keep_identified(docs: DataFrame, models: list[Model], least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language and a score of ``least`` or more; all columns stay."""
    rows = docs.select(*[F.col(c).alias("text" if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)])
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(rows.columns, docs.schema.fields, strict=True))
    kept = _passes(rows, models, ddl).filter((F.col("name") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(rows.columns, docs.columns, strict=True)])


def training_fold(docs: DataFrame) -> Column:
    """Rows of the query's training part."""
    return fold_of(F.col("doc_id"), 4) != 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    models = train(docs.filter(training_fold(docs)))
    return identify(docs, models).select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
