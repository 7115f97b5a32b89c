"""Operator 2, benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of all training tokens: a row for each segment (some MB of whole texts)
with its sorted term hashes, their counts, and the ascending word positions of each. ``phrase_hits`` takes
the test items in blocks of bounded size; for each block it sums the terms' counts over the whole index
(reading the terms and counts alone), orders every phrase's terms from the rarest, and intersects the
offset-adjusted position lists segment by segment until none or exact occurrences are left.
``proximity_hits`` finds the segments' documents that hold all given terms within some words of each other.
Nothing but small per-document rows is ever shuffled, so no term or source can make a hot partition.

Terms are 64-bit hashes of words. A phrase could be matched wrongly only where a document's word at the same
place has the hash of another word; for 10^9 distinct words the odds that any two share a hash are 1 in 36.

A window is ``WINDOW`` consecutive words of an item; an item of fewer, but not none, is one window.

Results for odd rows: a null, empty or wordless text has no words, no hits and is not contaminated. A null
or wordless item matches nothing; items of one item_id count as one item, a null item_id as the id ''. Rows
that share a doc_id are judged one by one. Without items nothing is hit; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._bytes import LOWER, NO_WORD, flat, word_hashes, word_spans
from foliant.llm._segments import from_planes, planes, segments_of
from foliant.llm._tables import documents, stored

WINDOW = 13
SEGMENT_BYTES = 8 << 20
#: Test texts that one block holds; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: A proximity match: the NEAR_TERMS rarest words of an item within NEAR words.
NEAR_TERMS, NEAR = 4, 40

INDEX = "segment long, doc_ids array<long>, word_starts binary, terms binary, counts binary, positions binary"


def _index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for segment, ids, data, offsets in segments_of(batches, SEGMENT_BYTES):
        data = LOWER[data]
        starts, ends, text = word_spans(data, offsets, NO_WORD)
        h = word_hashes(data, starts, ends)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        word_starts = np.searchsorted(text, np.arange(len(ids) + 1))
        row = [[segment], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64())), [planes(word_starts)], [h[first].tobytes()], [planes(np.diff(np.append(first, len(h))))], [planes(order)]]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64() if i == 0 else pa.binary()) for i, x in enumerate(row)], names=["segment", "doc_ids", "word_starts", "terms", "counts", "positions"])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of the texts; ``key`` is a long."""
    return stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_index_task, INDEX), "index")


@dataclass
class Phrases:
    """Distinct phrases, padded with -1 behind their length: term numbers and, once ranked, the order from the rarest."""

    terms: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]
    order: np.ndarray | None = None
    near: list[tuple[str, np.ndarray]] | None = None


def phrases_of(ids: list[str], texts: pa.Array, window: int = WINDOW) -> tuple[Phrases, list[tuple[str, np.ndarray]]]:
    """The distinct windows of some items, and each item's distinct term numbers."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, text = word_spans(data, offsets, NO_WORD)
    h = word_hashes(data, starts, ends)
    terms, number = np.unique(h, return_inverse=True)
    found: dict[tuple, set] = {}
    own_terms = []
    for i, name in enumerate(ids):
        a, b = np.searchsorted(text, [i, i + 1])
        own = number[a:b].tolist()
        if own:
            own_terms.append((name, np.unique(number[a:b])))
        for j in range(max(1, len(own) - window + 1) if own else 0):
            found.setdefault(tuple(own[j : j + window]), set()).add(name)
    words = np.full((len(found), window), -1)
    for k, w in enumerate(found):
        words[k, : len(w)] = w
    return Phrases(terms, words, np.array([len(w) for w in found], dtype=np.int64), [sorted(x) for x in found.values()]), own_terms


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences of each of the given sorted terms in the whole index; reads its terms and counts alone."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for raw, counts in zip(batch.column(0), batch.column(1), strict=True):
                own, n = np.frombuffer(raw.as_buffer(), np.uint64), from_planes(counts.as_buffer())
                at, there = _find(own, shared.value)
                total[there] += n[at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    got = index.select("terms", "counts").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(terms), dtype=np.int64)
    total[np.asarray(got.column("term"))] = np.asarray(got.column("n"))
    return total


def _find(own: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted term stands in the sorted ``own``, and whether it does."""
    if not len(own):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    return at, own[at] == wanted


class Segment:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.word_starts = from_planes(row["word_starts"])
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.counts = from_planes(row["counts"])
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        self.raw = row["positions"]
        self.positions: np.ndarray | None = None

    def postings(self, at: int) -> np.ndarray:
        """Ascending positions of the term that stands at ``at``."""
        if self.positions is None:
            self.positions = from_planes(self.raw)
        return self.positions[self.begin[at] : self.begin[at + 1]]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.word_starts, positions, "right") - 1


def phrase_starts(seg: Segment, at: np.ndarray, words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Start positions of one phrase in a segment: its terms' lists, moved back by their offsets, are
    intersected from the rarest on. at: where each term number stands in the segment."""
    starts = None
    for offset in order:
        moved = seg.postings(at[words[offset]]) - offset
        if starts is None:
            starts = moved[moved >= 0]
        elif len(starts):
            spot = np.minimum(np.searchsorted(moved, starts), len(moved) - 1)
            starts = starts[moved[spot] == starts]
        if not len(starts):
            break
    last = starts + len(order) - 1
    last_word = int(seg.word_starts[-1])
    starts = starts[last < last_word]
    return starts[seg.doc_of(starts) == seg.doc_of(starts + len(order) - 1)]


def near_docs(seg: Segment, lists: list[np.ndarray], distance: int) -> np.ndarray:
    """Numbers of the segment's texts in which a run of at most ``distance`` words holds every list's term."""
    lists = sorted(lists, key=len)
    rarest = lists[0]
    kept = []
    for x in lists:  # only what lies within reach of the rarest term can take part
        a = np.searchsorted(rarest, x - distance + 1)
        kept.append(x[(a < len(rarest)) & (rarest[np.minimum(a, len(rarest) - 1)] <= x + distance - 1)])
    pos = np.concatenate(kept)
    if not len(pos):
        return np.zeros(0, int)
    kind = np.repeat(np.arange(len(kept)), [len(x) for x in kept])
    order = np.argsort(pos, kind="stable")
    pos, kind = pos[order], kind[order]
    begin = np.full(len(pos), np.iinfo(np.int64).max)
    for k in range(len(kept)):
        begin = np.minimum(begin, np.maximum.accumulate(np.where(kind == k, pos, -(2**40))))
    ok = (pos - begin < distance) & (begin >= 0)
    a, b = seg.doc_of(np.maximum(begin[ok], 0)), seg.doc_of(pos[ok])
    return np.unique(b[a == b])


def _matching_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                at, there = _find(seg.terms, p.terms)
                runs: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                near: dict[int, set[str]] = {}
                whole = np.where(p.words >= 0, there[p.words], True).all(axis=1) if len(p.words) else np.zeros(0, bool)
                for k in np.flatnonzero(whole).tolist():
                    n = int(p.lengths[k])
                    starts = phrase_starts(seg, at, p.words[k], p.order[k, :n])
                    for s, d in zip(starts.tolist(), seg.doc_of(starts).tolist(), strict=True):
                        runs.setdefault(d, []).append((s, s + n))
                        items.setdefault(d, set()).update(p.items[k])
                for name, own in p.near or ():
                    if there[own].all():
                        for d in near_docs(seg, [seg.postings(at[t]) for t in own], NEAR).tolist():
                            near.setdefault(d, set()).add(name)
                docs = sorted(runs.keys() | near.keys())
                if docs:
                    merged = [_merged(runs.get(d, [])) for d in docs]
                    yield pa.RecordBatch.from_pylist(
                        [{"segment": row["segment"], "ordinal": d, "runs": m, "items": sorted(items.get(d, ())), "near": sorted(near.get(d, ()))} for d, m in zip(docs, merged, strict=True)],
                        schema=HITS_ARROW,
                    )

    return run


HITS = "segment long, ordinal int, runs array<struct<a: long, b: long>>, items array<string>, near array<string>"
HITS_ARROW = pa.schema([("segment", pa.int64()), ("ordinal", pa.int32()), ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])


def _merged(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"a": a, "b": b} for a, b in out]


def _blocks(items: DataFrame) -> Iterator[tuple[list[str], pa.Array]]:
    """The test items in blocks of about BLOCK_BYTES, streamed to the driver one partition at a time."""
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row.item)
        texts.append(row.text)
        held += len(row.text)
        if held >= BLOCK_BYTES:
            yield ids, pa.array(texts, pa.large_string())
            ids, texts, held = [], [], 0
    if ids:
        yield ids, pa.array(texts, pa.large_string())


def phrase_hits(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of items (item_id, text): a row for each document with a hit: segment, ordinal (its number in the
    segment), the word runs covered by windows, the items that have them, and the items that are near."""
    spark = index.sparkSession
    hits = None
    named = items.filter("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    for ids, texts in _blocks(named):
        p, own_terms = phrases_of(ids, texts, window)
        if not len(p.words):
            continue
        n = term_counts(index, p.terms)
        rank = np.where(p.words >= 0, n[p.words], np.iinfo(np.int64).max)
        p.order = np.argsort(rank, axis=1, kind="stable")
        p.near = [(name, own[np.argsort(n[own], kind="stable")][:NEAR_TERMS]) for name, own in own_terms if len(own) >= NEAR_TERMS]
        found = index.mapInArrow(_matching_task(spark.sparkContext.broadcast(p)), HITS)
        hits = found if hits is None else hits.unionAll(found)
    if hits is None:
        return spark.createDataFrame([], HITS + ", n_hit long")
    # a document hit by several blocks: its runs are merged once more
    grouped = hits.groupBy("segment", "ordinal").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("b"))
    step = lambda s, r: F.struct((s.n + F.greatest(F.lit(0), r.b - F.greatest(r.a, s.b))).alias("n"), F.greatest(s.b, r.b).alias("b"))
    return grouped.withColumn("n_hit", F.aggregate("runs", state, step, lambda s: s.n))


def proximity_hits(index: DataFrame, terms: list[str], distance: int) -> DataFrame:
    """(doc_id) of each text in which ``distance`` consecutive words hold all ``terms``."""
    p, own = phrases_of([""], pa.array([" ".join(terms)], pa.large_string()), 1)
    shared = index.sparkSession.sparkContext.broadcast((p.terms, own[0][1] if own else np.zeros(0, int)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, own = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                at, there = _find(seg.terms, wanted)
                if len(own) and there[own].all():
                    docs = near_docs(seg, [seg.postings(at[t]) for t in own], distance).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([seg.ids[d] for d in docs], pa.int64())], names=["doc_id"])

    return index.mapInArrow(task, "doc_id long")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items, near and contaminated for each row of ``docs``."""
    index = build_index(docs)
    hits = phrase_hits(index, items, window)
    all_docs = index.select("segment", "doc_ids", "word_starts").mapInArrow(_doc_rows, "segment long, ordinal int, doc_id long, n_words long")
    none = F.array().cast("array<string>")
    joined = all_docs.join(hits, ["segment", "ordinal"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


def _doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment, ids, starts in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            n = np.diff(from_planes(starts.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array([segment.as_py()] * len(n), pa.int64()), pa.array(np.arange(len(n), dtype=np.int32)), ids.values, pa.array(n)], names=["segment", "ordinal", "doc_id", "n_words"])


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; all columns stay. Repeated ids are told apart by text."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    marked = decontaminate(docs.select(key.alias("doc_id"), "text"), items).filter("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(marked, key == F.col("__bad"), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict[str, str] = {}
