"""Near copies by the similarity of word shingles, for the pipeline.

Two texts are near copies if the Jaccard similarity of their sets of ``SHINGLE``-word shingles is at least 0.8.
Candidates come from operator 10, with fingerprints over the same shingles: its links join texts within 4 bits. At
0.8 most fingerprints are farther apart than that, so each set also gets ``BANDS`` codes, each over the minima of
``ROWS`` random orders of the set, and texts that share a code meet in a bucket. A pair at 0.8 shares no code with
odds (1 - 0.8 ^ ROWS) ^ BANDS = 5e-8, and closer pairs with less. Every link is then checked on the sets themselves.

Texts with equal sets are one node. Two exact bounds come first: a shingle that no other candidate has is in no
intersection, so a node with over a fifth of such shingles has no near copy, and two nodes can't be near copies if
the shingles that either shares with others are under 4 / 9 of both sizes. A bucket then compares each node with
the one that has the least share of shingles of its own (the likely common source). What is left are nodes of a bucket that
lie in different components; among these an exact prefix filter (``prefix_pairs``) finds the pairs to compare. So no
pair that shares a bucket is left out, and a group of near copies takes about one comparison for each text.

Results for odd rows: a text of fewer words has one shingle of all of them; null, empty and blank texts have the
empty set and are near copies of each other. The rest is as in ``simhash.keep_one``. Shingles, sets and rows
are 64-bit hashes; of n distinct ones two share a hash with odds n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm import simhash
from foliant.llm._bytes import LOWER, mixed, text_groups, word_hashes, word_spans
from foliant.llm._segments import packed, unpacked
from foliant.llm._tables import stored
from foliant.llm.simhash import components

SHINGLE = 5
#: Similarity, as a fraction.
LEAST = 4, 5
BANDS, ROWS = 32, 4
_STEP, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ORDERS = np.random.default_rng(20240611).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the shingles' hashes, text by text and repeats included, and the n + 1 offsets."""
    for first, last, data, offsets in text_groups(column, 1 << 18):
        data = LOWER[data]
        starts, ends, text = word_spans(data, offsets)
        word, n = word_hashes(data, starts, ends), last - first
        begins = np.searchsorted(text, np.arange(n + 1))
        words = np.diff(begins)
        sizes = np.where(words > 0, np.maximum(1, words - SHINGLE + 1), 0)
        out = np.concatenate([[0], np.cumsum(sizes)])
        of = np.repeat(np.arange(n), sizes)
        at = begins[of] + np.arange(out[-1]) - out[of]
        length = np.minimum(words[of], SHINGLE)
        h = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            h = np.where(k < length, h * _STEP + word[np.minimum(at + k, max(0, len(word) - 1))], h) if len(at) else h
        yield mixed(h + length.astype(np.uint64) * _SIZE), out


def codes(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """BANDS codes for each run of ``h`` (none empty)."""
    out = np.zeros((len(begins), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((h ^ _ORDERS[0, k]) * _ORDERS[1, k], begins)
        out[:, k // ROWS] = mixed(out[:, k // ROWS] * _STEP + least + np.uint64(k))
    return out


def fingerprints(h: np.ndarray, out: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """The SimHash of each text's shingle hashes; 0 for none. The bits are counted block by block."""
    n = len(out) - 1
    counts = np.zeros((n, 64), np.int64)
    for a in range(0, len(h), block):
        part = h[a : a + block]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1)
        text = np.searchsorted(out, np.arange(a, a + len(part)), "right") - 1
        first = np.flatnonzero(np.diff(text, prepend=-1))
        counts[text[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > np.diff(out)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _key(own: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), 42)


def _signature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = 0
        for h, out in shingles(batch.column(2)):
            n = len(out) - 1
            keys = np.fromiter((_key(np.unique(h[a:b])) for a, b in zip(out[:-1], out[1:], strict=True)), np.uint64, n)
            some = np.diff(out) > 0
            own = codes(h, out[:-1][some]) if some.any() else np.zeros((0, BANDS), np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(own.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(keys.view(np.int64)), pa.array(fingerprints(h, out).view(np.int64)), lists], names=["doc_id", "at", "key", "fp", "codes"])
            row += n


def _set_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = 0
        for h, out in shingles(batch.column(1)):
            n = len(out) - 1
            sets = [np.unique(h[a:b]) for a, b in zip(out[:-1], out[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array([len(x) for x in sets], pa.int64()), pa.array([packed(x) for x in sets], pa.binary())], names=["key", "n", "own"])
            row += n


def _shingle_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = unpacked(raw.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), key, np.int64))], names=["shingle", "key"])


def _similar_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, q = LEAST
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(q * both >= p * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _row(docs: DataFrame):
    """A number of the row's id and text."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that connect all nodes whose fingerprints are within the radius of operator 10."""
    fps = stored(nodes.groupBy("fp").agg(F.min("key").alias("lead")), "fingerprints")
    same = nodes.join(fps, "fp").filter("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    x, y = (fps.select(F.col("fp").alias(k), F.col("lead").alias(f"lead_{k}")) for k in "ab")
    near = simhash.links(fps.select("fp"), fps.count()).join(x, "a").join(y, "b")
    return same.unionAll(near.select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b")))


def prefix_pairs(sets: DataFrame, left: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes ``left`` (key, n, root) with different roots that may be near copies, without a loss.

    With every set's shingles in one order, the rarest first, near copies share one of their first n - 0.8 n + 1, and
    behind the first one that they share, at places i and j, both have at least the rest of the common ones. A common
    shingle is among the first only where a set has few rare ones."""
    p, q = LEAST
    tokens = sets.join(left.select("key"), "key").select("key", "own").mapInArrow(_shingle_task, "shingle long, key long")
    times = tokens.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1")
    own = Window.partitionBy("key")
    ranked = tokens.join(times, "shingle").withColumns({"at": F.row_number().over(own.orderBy("times", "shingle")), "all": F.count("*").over(own)}).join(left, "key")
    place = F.col("at") + F.col("n") - F.col("all")  # shingles of one set alone come first
    first = ranked.withColumn("at", place).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * p / q) + 1).select("shingle", "key", "n", "root", "at")
    x, y = (first.withColumnsRenamed({"key": k, "n": f"n_{k}", "root": f"root_{k}", "at": f"at_{k}"}) for k in "ab")
    within = (p + q) * (1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))) >= p * (F.col("n_a") + F.col("n_b"))
    return x.join(y, "shingle").filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & within).select("a", "b").distinct()


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes (key, first, at, fp, codes) that connect all near copies."""
    close = stored(simhash_pairs(nodes), "close")
    held = nodes.select("key", F.explode("codes").alias("code"))
    several = held.groupBy("code").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").select("code")
    shared = stored(held.join(several, "code"), "buckets")
    wanted = shared.select("key").unionAll(close.select("a")).unionAll(close.select("b")).distinct().join(nodes.select("key", "at"), "key")
    texts = docs.select(_row(docs).alias("at"), "text").join(wanted, "at").select("key", "text")
    sets = stored(texts.mapInArrow(_set_task, "key long, n long, own binary").dropDuplicates(["key"]), "sets")
    # shingles of one node alone are in no intersection
    seen = sets.select("key", "own").mapInArrow(_shingle_task, "shingle long, key long").groupBy("shingle").agg(F.count("*").alias("times"), F.min("key").alias("key"))
    alone = seen.filter("times = 1").groupBy("key").agg(F.count("*").alias("alone"))
    sized = sets.select("key", "n").join(alone, "key", "left").select("key", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
    able = stored(sized.filter(LEAST[1] * F.col("common") >= LEAST[0] * F.col("n")), "able")
    bound = (LEAST[0] + LEAST[1]) * F.least("common_a", "common_b") >= LEAST[0] * (F.col("n_a") + F.col("n_b"))

    def named(df: DataFrame, k: str) -> DataFrame:
        return df.withColumnsRenamed({"key": k, **{c: f"{c}_{k}" for c in ("n", "common", "root")}})

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        x, y = (sets.select(F.col("key").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
        return stored(pairs.join(x, "a").join(y, "b").select("a", "b", "own_a", "own_b").mapInArrow(_similar_task, "a long, b long"), name)

    open_ = stored(shared.join(able, "key"), "open")
    centre = open_.groupBy("code").agg(F.min(F.struct((1 - F.col("common") / F.col("n")).alias("alone"), "key", "n", "common")).alias("c"))
    starred = open_.join(centre, "code").filter("key <> c.key").select(F.col("c.key").alias("a"), F.col("key").alias("b"), F.col("c.n").alias("n_a"), F.col("n").alias("n_b"), F.col("c.common").alias("common_a"), F.col("common").alias("common_b"))
    linked = close.join(named(able, "a"), "a").join(named(able, "b"), "b").select(*starred.columns)
    tried = stored(starred.unionAll(linked).filter(bound).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    found = similar(tried, "links")
    rooted = open_.join(components(found).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = rooted.groupBy("code").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("code")
    left = stored(rooted.join(apart, "code").select("key", "n", "root").distinct(), "apart")
    rest = prefix_pairs(sets, left).join(tried, ["a", "b"], "left_anti")
    return found.unionAll(similar(stored(rest, "pairs"), "links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each group of near copies; all columns stay."""
    signed = docs.select("doc_id", _row(docs).alias("at"), "text").mapInArrow(_signature_task, "doc_id long, at long, key long, fp long, codes array<long>")
    nodes = stored(signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("at").alias("at"), F.first("fp").alias("fp"), F.first("codes").alias("codes")), "nodes")
    roots = components(links(docs, nodes))
    rooted = nodes.select("key", "first").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("__kept")).select("__kept").distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")
