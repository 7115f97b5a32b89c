"""Operator 11, ranked lexical search by MaxScore over shards.

``build_index`` stores a row for each shard (some MB of whole texts): its sorted term hashes, and of each term the
texts that hold it, the occurrences in each, how many there are, the largest number of occurrences and the shortest
length among them. ``search`` takes the items in blocks. For each block one scan of the terms and counts gives the
terms' weights over all texts; a second one searches shard by shard. There a term's upper bound is its weight times the
impact that its most occurrences would have in its shortest text. The terms with the smallest bounds, as long as their
sum stays below what the item's ``top``-th document has so far, are non-essential: only texts that hold an essential
term are scored at all, and the non-essential lists, from the largest bound on, are probed for those texts alone that
the bounds still let in. A task keeps the best documents of each item from shard to shard, so the later ones skip
most postings; it returns ``top`` rows for each item, of which a window takes the best.

Scores are integers, as the contract has them: w * ((1000000000 * tf) div (1000 * tf + 8 * m)), summed over the item's
terms with repeats. Terms are 64-bit hashes; of t item terms and v words in the texts, one of each shares a hash
with odds t * v / 2^64.

Results for odd rows: null, empty and wordless texts count in no statistic and are never found. Rows that share a
doc_id are documents of their own; of equal scores the smaller doc_id comes first, a null one last. Items of one item_id
(null is one, too) are one item with the terms of all its rows; items without terms have no rows. A text is indexed in
pieces, so that the memory for a very long one is its bytes and a few words for each of its distinct terms. An empty table on
either side gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm._bytes import LOWER, NO_WORD, text_groups, word_hashes, word_spans
from foliant.llm._segments import from_planes, planes, segments_of
from foliant.llm._tables import documents, new_path, stored

TOP = 10
SHARD_BYTES = 4 << 20
#: Bytes of a shard whose words are counted at a time, and distinct item terms that a block has on average.
PIECE, BLOCK_TERMS = 4 << 20, 1 << 20
#: Slices in which an item's rows are ranked first.
SLICES = 64

INDEX = "segment long, doc_ids array<long>, lengths binary, terms binary, holders binary, most binary, shortest binary, texts binary, times binary, n_docs long, n_terms long"


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of parts of about ``most`` bytes that end where no word is."""
    first = 0
    while first < len(data):
        last = min(len(data), first + most)
        while last < len(data) and not NO_WORD[data[last]]:
            stop = np.flatnonzero(NO_WORD[data[last : last + 4096]])
            last = min(len(data), last + (int(stop[0]) if len(stop) else 4096))
        yield data[first:last], np.clip(offsets - first, 0, last - first)
        first = last


def postings(data: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term hash, text number and occurrences, ascending by term and text, of lower-cased texts."""
    parts = []
    for piece, own in pieces(data, offsets, most):
        starts, ends, text = word_spans(piece, own, NO_WORD)
        parts.append(_summed(word_hashes(piece, starts, ends), text, np.ones(len(starts), np.int64)))
    return parts[0] if len(parts) == 1 else _summed(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _summed(term: np.ndarray, text: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with ascending texts, summed by term and text."""
    order = np.argsort(term, kind="stable")
    term, text, times = term[order], text[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])])) if len(term) else np.zeros(0, int)
    return term[first], text[first], np.add.reduceat(times, first) if len(first) else times


def _index_task(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, ids, data, offsets in segments_of(batches, shard_bytes):
            term, text, times = postings(LOWER[data], offsets)
            lengths = np.bincount(text, times, len(ids)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, int)
            most, shortest = (np.maximum.reduceat(times, first), np.minimum.reduceat(lengths[text], first)) if len(first) else (first, first)
            blobs = [planes(lengths), term[first].tobytes(), planes(np.diff(np.append(first, len(term)))), planes(most), planes(shortest), planes(text), planes(times)]
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64()))
            numbers = [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
            names = ["segment", "doc_ids", "lengths", "terms", "holders", "most", "shortest", "texts", "times", "n_docs", "n_terms"]
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), lists, *(pa.array([b], pa.binary()) for b in blobs), *numbers], names=names)

    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored index of the texts; ``key`` is a long."""
    return stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_index_task(shard_bytes), INDEX), "index")


def _term_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in text_groups(batch.column(1)):
            term, text, times = postings(LOWER[data], offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(text)), pa.array(term.view(np.int64)), pa.array(times)], names=["item_id", "term", "times"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): the distinct terms of each item."""
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(_term_task, f"item_id {kind}, term long, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


@dataclass
class Items:
    """A block of items: ids, where each one's terms begin, and of each term its number, occurrences and weight."""

    ids: pa.Array
    begins: np.ndarray
    term: np.ndarray
    times: np.ndarray
    terms: np.ndarray
    weights: np.ndarray | None = None


def _block(rows: pa.Table) -> Items:
    ids, number = rows.column("item_id").combine_chunks(), None
    coded = ids.dictionary_encode(null_encoding="encode")
    number = np.asarray(coded.indices)
    order = np.argsort(number, kind="stable")
    terms, term = np.unique(np.asarray(rows.column("term")).view(np.uint64), return_inverse=True)
    return Items(coded.dictionary, np.searchsorted(number[order], np.arange(len(coded.dictionary) + 1)), term[order], np.asarray(rows.column("times"))[order], terms)


def find(own: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted term stands in the sorted ``own``, and whether it does."""
    if not len(own):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    return at, own[at] == wanted


def weights(index: DataFrame, terms: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of each of the sorted terms by the documents that hold it; reads the index's terms and counts alone."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for raw, holders in zip(batch.column(0), batch.column(1), strict=True):
                at, there = find(np.frombuffer(raw.as_buffer(), np.uint64), shared.value)
                total[there] += from_planes(holders.as_buffer())[at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "n"])

    got = index.select("terms", "holders").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms), np.int64)
    df[np.asarray(got.column("term"))] = np.asarray(got.column("n"))
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def damping(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each length; the product may need more than 64 bits, so distinct lengths go through whole numbers."""
    distinct, at = np.unique(lengths, return_inverse=True)
    return np.array([25 + 75 * int(n) * n_docs // n_terms for n in distinct], np.int64)[at]


def impact(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 8 * m)


class Shard:
    """One row of the index, opened: its postings are read once a search wants them."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        ids = row["doc_ids"]
        self.null = np.fromiter((x is None for x in ids), bool, len(ids))
        self.ids = np.fromiter((x or 0 for x in ids), np.int64, len(ids))
        self.m = damping(from_planes(row["lengths"]), n_docs, n_terms)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(from_planes(row["holders"]))])
        self.bounds = impact(from_planes(row["most"]), damping(from_planes(row["shortest"]), n_docs, n_terms)) if len(self.terms) else np.zeros(0, np.int64)
        self.texts, self.times = from_planes(row["texts"]), from_planes(row["times"])
        self.scored = 0

    def essential(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts of the term that stands at ``at``, with its impact there."""
        own = slice(self.begin[at], self.begin[at + 1])
        self.scored += own.stop - own.start
        texts = self.texts[own]
        return texts, impact(self.times[own], self.m[texts])

    def probed(self, at: int, texts: np.ndarray) -> np.ndarray:
        """The term's impact in the given texts."""
        own = slice(self.begin[at], self.begin[at + 1])
        spot, there = find(self.texts[own], texts)
        self.scored += len(texts)
        out = np.zeros(len(texts), np.int64)
        out[there] = impact(self.times[own][spot[there]], self.m[texts[there]])
        return out


class Best:
    """The best documents of one item so far."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a document must reach to come in."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.concatenate([self.score, score]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -score))[: self.top]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def search_shard(shard: Shard, at: np.ndarray, factor: np.ndarray, best: Best) -> None:
    """One item in one shard. at: where its terms stand; factor: their weights times their occurrences in the item."""
    bound = factor * shard.bounds[at]
    order = np.argsort(bound, kind="stable")
    at, factor, up_to = at[order], factor[order], np.cumsum(bound[order])
    least = best.least()
    essential = int(np.searchsorted(up_to, least))  # below it, all bounds together stay under what is wanted
    if essential == len(at):
        return
    score = np.zeros(len(shard.m), np.int64)
    seen = np.zeros(len(shard.m), bool)
    for k in range(essential, len(at)):
        texts, gain = shard.essential(at[k])
        score[texts] += factor[k] * gain
        seen[texts] = True
    texts = np.flatnonzero(seen)
    score = score[texts]
    if len(texts) > best.top:
        least = max(least, int(np.partition(score, len(score) - best.top)[len(score) - best.top]))
    for k in range(essential - 1, -1, -1):
        able = score + up_to[k] >= least
        texts, score = texts[able], score[able]
        if not len(texts):
            return
        score = score + factor[k] * shard.probed(at[k], texts)
    able = score >= least
    best.add(score[able], shard.ids[texts[able]], shard.null[texts[able]])


def _search_task(shared, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        best = [Best(top) for _ in items.ids]
        for batch in batches:
            for k in range(len(batch)):
                shard = Shard(batch.slice(k, 1).to_pylist()[0], n_docs, n_terms)
                at, there = find(shard.terms, items.terms)
                for i, own in enumerate(best):
                    mine = slice(items.begins[i], items.begins[i + 1])
                    term = items.term[mine]
                    here = there[term]
                    factor = items.weights[term[here]] * items.times[mine][here]
                    if (factor > 0).any():
                        search_shard(shard, at[term[here]][factor > 0], factor[factor > 0], own)
        number = np.repeat(np.arange(len(best)), [len(x.score) for x in best])
        if len(number):
            ids = pa.array(np.concatenate([x.ids for x in best]), mask=np.concatenate([x.null for x in best]))
            yield pa.RecordBatch.from_arrays([items.ids.take(pa.array(number)), ids, pa.array(np.concatenate([x.score for x in best]))], names=["item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""
    spark = index.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    found_schema = f"item_id {kind}, doc_id long, score long"
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    wanted = stored(item_terms(items), "items")
    blocks = -(-wanted.count() // block_terms) if n_docs else 0
    path = new_path(spark, "found")
    spark.createDataFrame([], found_schema).write.parquet(path)
    for k in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        if rows.num_rows:
            block = _block(rows)
            block.weights = weights(index, block.terms, n_docs)
            shared = spark.sparkContext.broadcast(block)
            index.mapInArrow(_search_task(shared, n_docs, n_terms, top), found_schema).write.mode("append").parquet(path)
            shared.destroy()
    found = spark.read.schema(found_schema).parquet(path)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SLICES)))
    part = part.withColumn("at", F.row_number().over(Window.partitionBy("item_id", "slice").orderBy(*order))).filter(F.col("at") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op11_lexical_search": op11_lexical_search}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {
    "op11_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
n AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, sum(n) AS terms FROM n),
m AS (SELECT r, doc_id, 25 + CAST((75 * n * docs) // terms AS BIGINT) AS m FROM n, s),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY t, docs),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
scored AS (
  SELECT item_id, m.r, m.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY item_id, m.r, m.doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
}
