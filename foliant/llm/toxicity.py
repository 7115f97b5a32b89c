"""Operator 3, toxicity: a convolutional text classifier in numpy.

A word is the concatenation of two hashed embeddings (two independent hash functions of its lower-cased
bytes, so that a rare word seldom shares both rows with a toxic one). Filters of widths 1, 2 and 3 run over
the words of a whole text, each filter's largest response over the text is kept (max pooling, after a
rectifier), and a logistic layer turns the pooled responses into a score. Adam and AdaGrad train it by
mini-batches on all labelled rows. They begin on the driver with some of them: of either label at most ``SAMPLE`` rows, in the order of a hash of
id and text, of together at most ``SAMPLE_BYTES`` bytes. Where these are not all, a pass over every row follows on Spark
(``refined``): tasks learn from the rows of a part, their changes are averaged, and the next part goes on from there. Words
in a row of a table that fewer than ``LEAST_TEXTS`` of all texts use are padding in that pass. The last digits of the weights
depend on how the rows lie in files. Scoring
is a map over the table with the model (a fixed size, below 3 MB) broadcast, so it never shuffles a text. A
filter starts at words alone and finds zeros behind the last one, so a score depends on its own text only; long
texts are pooled in blocks of words.

Calibration, on all of the quarter of the labelled rows (by hash) that is kept from training: a logistic fit of the raw outputs at the labels'
natural frequency, shifted so that the threshold with the best F1 gets score 0.7. Each language with enough
rows there gets a threshold of its own; ``flag`` applies them. Labels, language, source and id are never
inputs of a score; a language only picks the threshold of the ``flagged`` column.

Results for odd rows: null, empty and wordless texts get the score of a text of padding alone; a text of
many MB is scored whole, in blocks (its word hashes take 8 bytes a word). Without labelled rows of both kinds there is nothing to learn and every score is 0. Labels count by doc_id: where
one id has several labels the largest counts. Rows that share a doc_id are scored one by one; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._bytes import LOWER, NO_WORD, groups_of, text_groups, word_hashes, word_spans
from foliant.llm._tables import documents, fold_of, new_path, stored

SAMPLE = 4000
SAMPLE_BYTES = 32 << 20
#: Words whose filter responses are held at a time.
BLOCK_WORDS = 1 << 16
TABLE = 1 << 16
HALF = 4
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 8
#: Parts of the labelled rows; after each, what the tasks have learned is brought together.
PARTS = 4
#: Parameters of a block of changes.
BLOCK = 1 << 13
#: Steps of the grid of raw outputs to a unit.
GRID = 256
BATCH = 64
LEAST_TEXTS = 4
CUT = 0.7
#: Toxic rows that a language needs among the calibration rows for a threshold of its own.
LEAST_BY_LANGUAGE = 15


@dataclass
class Model:
    tables: list[np.ndarray]
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def words_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By runs of texts: word hashes, and words before each text (n + 1 of them)."""
    for first, last, data, offsets in text_groups(column):
        data = LOWER[data]
        starts, ends, text = word_spans(data, offsets, NO_WORD)
        yield word_hashes(data, starts, ends), np.searchsorted(text, np.arange(last - first + 1))


def _padded(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of both halves with padding (row 0) after each text, where each text begins, and at which
    positions a filter may start: at words, or at the padding of a text without any."""
    pad = max(WIDTHS)
    n = len(before) - 1
    begin = before[:-1] + pad * np.arange(n)
    at = np.arange(len(hashes)) + pad * np.repeat(np.arange(n), np.diff(before))
    one, two = np.zeros(len(hashes) + pad * n, np.int32), np.zeros(len(hashes) + pad * n, np.int32)
    starts = np.zeros(len(one), bool)
    starts[at] = True
    starts[begin[np.diff(before) == 0]] = True
    some = hashes != 0  # a word set to zero is padding
    one[at] = np.where(some, 1 + (hashes >> np.uint64(32)) % np.uint64(TABLE - 1), 0)
    two[at] = np.where(some, 1 + (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(TABLE - 1), 0)
    return one, two, begin, starts


def _responses(m: Model, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Filter outputs at each position; a filter reaches into the rows after its position."""
    longer = np.concatenate([x, np.zeros((max(WIDTHS), x.shape[1]), np.float32)])
    found = []
    for w, f, b in zip(WIDTHS, m.filters, m.biases, strict=True):
        y = longer[: len(x)] @ f[0]
        for k in range(1, w):
            y += longer[k : k + len(x)] @ f[k]
        found.append(y + b)
    y = np.concatenate(found, axis=1)
    y[~starts] = -np.inf
    return y


def _pooled(m: Model, hashes: np.ndarray, before: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Each filter's largest response over each text, of starts at the first ``limit`` words if given."""
    one, two, begin, starts = _padded(hashes, before)
    if limit is not None:
        starts[limit:] = False
    y = _responses(m, np.concatenate([m.tables[0][one], m.tables[1][two]], axis=1), starts)
    return np.maximum(np.maximum.reduceat(y, begin, axis=0), 0)


def raw_outputs(m: Model, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Logit of each text."""
    found = []
    for first, last in groups_of(before, BLOCK_WORDS):
        a, b = int(before[first]), int(before[last])
        if b - a <= BLOCK_WORDS:
            found.append(_pooled(m, hashes[a:b], before[first : last + 1] - a))
            continue
        best = np.zeros((1, FILTERS * len(WIDTHS)), np.float32)  # one long text, block by block
        for at in range(a, b, BLOCK_WORDS):
            piece = hashes[at : min(b, at + BLOCK_WORDS + max(WIDTHS) - 1)]
            best = np.maximum(best, _pooled(m, piece, np.array([0, len(piece)]), BLOCK_WORDS))
        found.append(best)
    return np.concatenate(found) @ m.out + m.out_bias if found else np.zeros(0)


def _new_model(rng: np.random.Generator) -> Model:
    tables = [rng.normal(0, 0.03, (TABLE, HALF)).astype(np.float32) for _ in range(2)]
    for t in tables:
        t[0] = 0
    filters = [rng.normal(0, (2 / (w * 2 * HALF)) ** 0.5, (w, 2 * HALF, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(tables, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32))


def _step(m: Model, hashes: np.ndarray, before: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], list]:
    """Gradients of the dense parameters, and (rows, gradient) for either table."""
    one, two, begin, starts = _padded(hashes, before)
    x = np.concatenate([m.tables[0][one], m.tables[1][two]], axis=1)
    y = _responses(m, x, starts)
    top = np.maximum.reduceat(y, begin, axis=0)
    pooled = np.maximum(top, 0)
    z = pooled @ m.out + m.out_bias
    g = ((1 / (1 + np.exp(-z)) - label) * weight / weight.sum()).astype(np.float32)
    dout, dbias = pooled.T @ g, float(g.sum())
    dtop = np.outer(g, m.out) * (top > 0)
    owner = np.repeat(np.arange(len(label)), np.diff(np.append(begin, len(x))))
    at = np.flatnonzero(y == np.where(dtop != 0, top, np.nan)[owner])  # those alone that a gradient goes to
    pos, f = np.divmod(at, y.shape[1])
    _, lead = np.unique(owner[pos] * y.shape[1] + f, return_index=True)  # the first of equal maxima
    pos, f = pos[lead], f[lead]
    d = dtop[owner[pos], f]
    dx, dfilters, dbiases = np.zeros_like(x), [], []
    for j, w in enumerate(WIDTHS):
        mine = f // FILTERS == j
        p, c, e = pos[mine], f[mine] % FILTERS, d[mine]
        df = np.zeros((w, FILTERS, 2 * HALF), np.float32)
        for k in range(w):
            inside = p + k < len(x)
            np.add.at(df[k], c[inside], e[inside, None] * x[p[inside] + k])
            np.add.at(dx, p[inside] + k, e[inside, None] * m.filters[j][k].T[c[inside]])
        dfilters.append(df.transpose(0, 2, 1))
        dbiases.append(np.bincount(c, weights=e, minlength=FILTERS).astype(np.float32))
    used = np.flatnonzero(dx.any(axis=1) & (one > 0))
    return [*dfilters, *dbiases, dout, np.array([dbias], np.float32)], [(one[used], dx[used, :HALF]), (two[used], dx[used, HALF:])]


class Steps:
    """Mini-batch steps on a model: Adam for the dense parameters, AdaGrad for the embeddings. ``start`` is the size of squared
    gradients that the latter has seen already: more of it for a model that has learned before."""

    def __init__(self, m: Model, rate: float = 0.01, start: float = 1e-6):
        self.m, self.rate, self.t = m, rate, 0
        self.dense = [*m.filters, *m.biases, m.out, np.full(1, m.out_bias, np.float32)]
        self.first, self.second = [np.zeros_like(p) for p in self.dense], [np.zeros_like(p) for p in self.dense]
        self.sums = [np.full(TABLE, start, np.float32) for _ in range(2)]

    def step(self, texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> None:
        before = np.concatenate([[0], np.cumsum([len(c) for c in texts])])
        grads, rows = _step(self.m, np.concatenate(texts), before, label, weight)
        self.t += 1
        for p, g, a, b in zip(self.dense, grads, self.first, self.second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= self.rate * (a / (1 - 0.9**self.t)) / (np.sqrt(b / (1 - 0.999**self.t)) + 1e-8)
        self.m.out_bias = float(self.dense[-1][0])
        for table, total, (at_rows, g) in zip(self.m.tables, self.sums, rows, strict=True):
            unique, back = np.unique(at_rows, return_inverse=True)
            summed = np.zeros((len(unique), HALF), np.float32)
            np.add.at(summed, back, g)
            total[unique] += (summed * summed).mean(axis=1)
            table[unique] -= 0.1 * summed / np.sqrt(total[unique])[:, None]


def _among(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted ``words``, by binary search: np.isin would go over all words for each text."""
    return np.searchsorted(words, x, "right") > np.searchsorted(words, x)


def fit(texts: list[np.ndarray], label: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Train on word-hash arrays; both labels weigh the same in all. Words of fewer than LEAST_TEXTS texts
    are padding here, so that nothing is learned from what one text happens to hold."""
    rng = np.random.default_rng(seed)
    words, back = np.unique(np.concatenate([np.unique(x) for x in texts]), return_counts=True)
    known = words[back >= LEAST_TEXTS]
    texts = [np.where(_among(x, known), x, np.uint64(0)) for x in texts]
    steps = Steps(_new_model(rng))
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            steps.step([texts[i] for i in own], label[own], weight[own])
    return steps.m


def shortened(m: Model, words: np.ndarray) -> np.ndarray:
    """Of a text of more than BLOCK_WORDS words what a step needs: where each filter has its largest response, padding between."""
    if len(words) <= BLOCK_WORDS:
        return words
    best, place = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32), np.zeros(FILTERS * len(WIDTHS), np.int64)
    for at in range(0, len(words), BLOCK_WORDS):
        piece = words[at : at + BLOCK_WORDS + max(WIDTHS) - 1]
        one, two, _, starts = _padded(piece, np.array([0, len(piece)]))
        starts[BLOCK_WORDS:] = False
        y = _responses(m, np.concatenate([m.tables[0][one], m.tables[1][two]], axis=1), starts)
        top = y.argmax(axis=0)
        more = y.max(axis=0) > best
        best, place = np.where(more, y.max(axis=0), best), np.where(more, at + top, place)
    longer = np.concatenate([words, np.zeros(max(WIDTHS), np.uint64)])
    return np.concatenate([np.append(longer[p : p + max(WIDTHS)], np.zeros(max(WIDTHS), np.uint64)) for p in np.unique(place)])


def _flat(m: Model) -> np.ndarray:
    return np.concatenate([*(x.ravel() for x in (*m.tables, *m.filters, *m.biases, m.out)), np.array([m.out_bias], np.float32)])


def _shaped(m: Model, values: np.ndarray) -> Model:
    """A model like ``m`` with the given parameters."""
    parts = np.split(values.astype(np.float32), np.cumsum([x.size for x in (*m.tables, *m.filters, *m.biases, m.out)]))
    tables, filters, biases = ([part.reshape(x.shape).copy() for part, x in zip(parts[a:b], own, strict=True)] for a, b, own in ((0, 2, m.tables), (2, 2 + len(WIDTHS), m.filters), (2 + len(WIDTHS), 2 + 2 * len(WIDTHS), m.biases)))
    return Model(tables, filters, biases, parts[-2].copy(), float(parts[-1][0]))


def _slots_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words as rows of the two tables, 16 bits each."""
    for batch in batches:
        at = 0
        for hashes, before in words_of(batch.column(3)):
            n = len(before) - 1
            slots = np.stack([(hashes >> np.uint64(32)) % np.uint64(TABLE - 1), (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(TABLE - 1)], axis=1).astype(np.uint16)
            own = pa.array([slots[a:b].tobytes() for a, b in zip(before.tolist(), before[1:].tolist(), strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, n) for k in range(3)), own], names=["doc_id", "at", "lang", "slots"])
            at += n


def _from_slots(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of a text's words (n x 2), and hashes that lead to them."""
    slots = np.frombuffer(raw, np.uint16).reshape(-1, 2).astype(np.uint64)
    moved = slots + np.uint64(TABLE - 1)  # never zero, which is padding
    return slots.astype(np.int64), moved[:, 0] << np.uint64(32) | moved[:, 1]


def _holders_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of the task have a word in each row of either table."""
    n = np.zeros((2, TABLE), np.int64)
    for batch in batches:
        for raw in batch.column(0):
            slots = _from_slots(raw.as_buffer())[0]
            for k in (0, 1):
                n[k][np.unique(slots[:, k])] += 1
    own = np.flatnonzero(n.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n.ravel()[own])], names=["slot", "n"])


def _pass_task(shared, seed: int):
    """Steps over all rows (toxic, slots) of a task, from the shared model; yields what they changed, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, known, weights = shared.value
        steps, rng, first = Steps(_shaped(old, _flat(old)), 0.002, 1e-3), np.random.default_rng(seed), _flat(old)
        for batch in batches:
            label = np.asarray(batch.column(0)).astype(np.float32)
            texts, words, own = [], 0, []
            for i in rng.permutation(len(label)).tolist():
                slots, hashes = _from_slots(batch.column(1)[i].as_buffer())
                x = shortened(steps.m, np.where(known[0][slots[:, 0]] & known[1][slots[:, 1]], hashes, np.uint64(0)))
                if texts and (len(texts) == BATCH or words + len(x) > BLOCK_WORDS):
                    steps.step(texts, label[own], weights[label[own].astype(int)])
                    texts, words, own = [], 0, []
                texts.append(x)
                own.append(i)
                words += len(x)
            if texts:
                steps.step(texts, label[own], weights[label[own].astype(int)])
        if steps.t:
            change = _flat(steps.m) - first
            blocks = [change[a : a + BLOCK].tobytes() for a in range(0, len(change), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "change"])

    return run


def _mean_task(rows: pa.Table) -> pa.Table:
    """Of each parameter of a block the mean change, over the tasks that changed it."""
    total = times = 0
    for raw in rows.column("change"):
        change = np.frombuffer(raw.as_buffer(), np.float32)
        total, times = total + change.astype(np.float64), times + (change != 0)
    mean = (total / np.maximum(times, 1)).astype(np.float32)
    return pa.table({"block": rows.column("block").slice(0, 1), "change": pa.array([mean.tobytes()], pa.binary())})


def refined(m: Model, rows: DataFrame, counts: dict[int, int]) -> Model:
    """The model after one pass over all labelled rows (part, toxic, slots), a part at a time: the tasks of a part learn from
    their rows, each on its own, and their changes are averaged."""
    spark = rows.sparkSession
    seen = rows.select("slots").mapInArrow(_holders_task, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    known = np.zeros(2 * TABLE, bool)
    known[np.asarray(seen.select("slot").toArrow().column(0))] = True
    weights = np.array([sum(counts.values()) / (2 * counts[k]) for k in (0, 1)])
    for part in range(PARTS):
        shared = spark.sparkContext.broadcast((m, known.reshape(2, TABLE), weights))
        changes = rows.filter(F.col("part") == part).select("toxic", "slots").mapInArrow(_pass_task(shared, part), "block int, change binary")
        got = changes.groupBy("block").applyInArrow(_mean_task, "block int, change binary").orderBy("block").toArrow()
        if got.num_rows:
            m = _shaped(m, _flat(m) + np.concatenate([np.frombuffer(x, np.float32) for x in got.column("change").to_pylist()]))
    return m


def _best_cut(z: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of z with the best F1: the middle of the gap below it."""
    order = np.argsort(-z, kind="stable")
    zs, hit, all_ = z[order], np.cumsum((label * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (label * weight).sum())
    f1[:-1][zs[:-1] == zs[1:]] = -1
    best = int(f1.argmax())
    return float((zs[best] + zs[best + 1]) / 2) if best + 1 < len(zs) else float(zs[best] - 1e-3)


def calibrate(m: Model, rows: DataFrame, counts: dict[int, int]) -> None:
    """Set the scale and shift that put the best cut at CUT, and the languages' thresholds, from all of the rows (toxic, lang,
    slots). What comes to the driver are counts of rows by raw output, on a grid."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [raw_outputs(shared.value, x, np.array([0, len(x)]))[0] for x in (_from_slots(raw.as_buffer())[1] for raw in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.rint(np.clip(z, -99, 99) * GRID).astype(np.int64))], names=["toxic", "lang", "z"])

    cells = stored(rows.select("toxic", "lang", "slots").mapInArrow(task, "toxic int, lang string, z long").groupBy("toxic", "lang", "z").agg(F.count("*").alias("n")), "cells")
    own = {r.toxic: r.n for r in cells.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    share = counts[1] / (counts[0] + counts[1])

    def grid(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z, label, n = (np.asarray(table.column(k)).astype(np.float64) for k in ("z", "toxic", "n"))
        return z / GRID, label, n * np.where(label == 1, share / max(1, own.get(1, 0)), (1 - share) / max(1, own.get(0, 0)))

    z, label, weight = grid(cells.groupBy("toxic", "z").agg(F.sum("n").alias("n")).orderBy("z", "toxic").toArrow())
    cut = _best_cut(z, label, weight)
    spread = float(np.average(np.abs(z - cut), weights=weight)) or 1.0
    m.scale = 3.0 / spread
    m.shift = float(np.log(CUT / (1 - CUT))) - m.scale * cut
    of = cells.filter("lang IS NOT NULL AND lang <> ''")
    enough = of.groupBy("lang").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    enough = enough.filter((F.col("a") >= LEAST_BY_LANGUAGE) & (F.col("b") >= LEAST_BY_LANGUAGE)).select("lang")
    for lang in sorted(r.lang for r in enough.collect()):
        m.thresholds[lang] = float(_squash(m, np.array([_best_cut(*grid(of.filter(F.col("lang") == lang).orderBy("z", "toxic").toArrow()))]))[0])


def _squash(m: Model, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m.scale * z + m.shift, -40, 40)))


def _hashing_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for hashes, before in words_of(batch.column(2)):
            n = len(before) - 1
            ids = [hashes[a:b].tobytes() for a, b in zip(before.tolist(), before[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + n], batch.column(1)[at : at + n], pa.array(ids, pa.binary())], names=["toxic", "lang", "words"])
            at += n


def fitting_rows(rows: list[tuple[int, int]], most: int) -> list[int]:
    """Of (row, size), in order, those that together have at most ``most`` bytes: one that no longer fits is passed over,
    and the next are taken. Where none fits, the smallest is taken."""
    held, out = 0, []
    for at, size in rows:
        if held + size <= most:
            held += size
            out.append(at)
    return out or [min(rows, key=lambda r: r[1])[0]] if rows else []


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit and calibrate on the labelled rows of ``docs`` (doc_id, text, lang); None without both labels.

    The driver begins with a top-k by hash for each label, so it holds 2 * sample rows and 2 * sample_bytes of
    text, or one longer text of a label that has no shorter one; the pass over all rows and the counts for the thresholds are Spark's."""
    toxic = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1))
    at = F.xxhash64("doc_id", "text")
    kept = F.pmod(F.xxhash64("at", F.lit(3)), F.lit(4)) == 3
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", at.alias("at"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    eligible = rows.join(toxic, "doc_id").withColumn("kept", kept)
    sizes = {(r.toxic, r.kept): r.n for r in eligible.groupBy("toxic", "kept").agg(F.count("*").alias("n")).collect()}
    counts = {k: sum(n for (label, _), n in sizes.items() if label == k) for k in (0, 1)}
    if not min(counts.values()):
        return None
    apart = len(sizes) == 4  # or there are too few rows to keep some from training
    fitting = eligible.filter("NOT kept") if apart else eligible
    top = [[(r.at, r.size) for r in fitting.filter(F.col("toxic") == k).orderBy("at", "doc_id").limit(sample).collect()] for k in (0, 1)]
    first = [fitting_rows(own, sample_bytes) for own in top]
    chosen = docs.sparkSession.createDataFrame([(at, k) for k, own in enumerate(first) for at in own], "at long, toxic int").dropDuplicates(["at"])
    some = docs.filter("doc_id IS NOT NULL").withColumn("at", at).select("at", "lang", "text").join(F.broadcast(chosen), "at").dropDuplicates(["at"])
    got = some.orderBy("at").select("toxic", "lang", "text").mapInArrow(_hashing_task, "toxic int, lang string, words binary").toArrow()
    m = fit([np.frombuffer(x, np.uint64) for x in got.column("words").to_pylist()], np.asarray(got.column("toxic")).astype(np.float32))
    own = docs.filter("doc_id IS NOT NULL").select("doc_id", at.alias("at"), "lang", "text").mapInArrow(_slots_task, "doc_id long, at long, lang string, slots binary")
    part = F.when(kept & F.lit(apart), -1).otherwise(F.pmod(F.xxhash64("at", F.lit(5)), F.lit(PARTS))).cast("int")
    path = new_path(docs.sparkSession, "labelled")
    labelled = own.join(toxic.hint("merge"), "doc_id")  # labels grow with the documents: the same plan, and its disk, at any size
    labelled.select("toxic", "lang", "slots", part.alias("part")).write.partitionBy("part").option("compression", "zstd").parquet(path)
    labelled = docs.sparkSession.read.schema("toxic int, lang string, slots binary, part int").parquet(path)
    learned = labelled.filter("part >= 0")
    if any(len(own) < (sizes[k, False] if apart else counts[k]) for k, own in enumerate(first)):
        m = refined(m, learned, counts)
    calibrate(m, labelled.filter("part < 0") if apart else learned, counts)
    return m


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang, score) of each row of ``docs``; lang is passed through for ``flag`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = 0
            for hashes, before in words_of(batch.column(2)):
                n = len(before) - 1
                s = np.zeros(n) if m is None else _squash(m, raw_outputs(m, hashes, before))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + n], batch.column(1)[at : at + n], pa.array(s, pa.float64())], names=["doc_id", "lang", "score"])
                at += n

    return docs.select("doc_id", "lang", "text").mapInArrow(task, "doc_id long, lang string, score double")


def flag(scored: DataFrame, model: Model | None) -> Column:
    """True where the score reaches the threshold of the row's language (CUT for others)."""
    limit = F.lit(CUT)
    for lang, cut in sorted((model.thresholds if model else {}).items()):
        limit = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(limit)
    return F.col("score") >= limit


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.filter(fold_of(F.col("doc_id"), 3) != 1), labels.filter(fold_of(F.col("doc_id"), 3) != 1))
    scored = score(docs, model)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), flag(scored, model).alias("flagged"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
