"""Operator 10, SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit where more than half of the text's shingle hashes have it. Two fingerprints within
``radius`` bits have a common variant within radius / 2 of each, so every fingerprint stands for all of its
variants within that half radius, and fingerprints that share a variant are linked. Variants are dealt out
by their leading bits: a fingerprint is sent once to each prefix that some variant of it has, and the task
that owns the prefix writes out the variants there, sorts them and links neighbours. All fingerprints at one
variant are within the full radius of each other, so linking neighbours loses no pair and needs no pairs of
a whole group; each bucket returns a forest, and the forests meet in a distributed connected-components loop.

Results for odd rows: null, empty and blank texts have fingerprint zero and link as any other. A null doc_id
never becomes a component_id unless the component has no other. Rows that share a doc_id are kept as they
are. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._bytes import LOWER
from foliant.llm._tables import documents, stored

SHINGLE = 4
RADIUS = 4
#: Variants that one bucket should hold on average; an uneven bucket is halved by further bits in its task.
BUCKET_VARIANTS = 1 << 21


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of word shingles, repeats included; 0 without words."""
    import xxhash

    words = text.translate(LOWER.tobytes()).split()
    if not words:
        return 0
    joined, k = b" ".join(words), max(1, len(words) - size + 1)
    begins = [0, *accumulate(len(w) + 1 for w in words)]
    last = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(begins[:k], begins[last:], strict=False)), np.uint64, k)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(k, 8), axis=1)
    counts = np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > k).tobytes(), "big")


def _fingerprint_task(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(x.as_py() or b"", size) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed 64-bit integer."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_task(size), "doc_id long, fp long")


def _masks(bits: int, weight: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), weight)], dtype=np.uint64)


def _join_equal(fps: np.ndarray, left: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions of fps that share a variant. left: flips still free in the low ``bits`` bits; the
    bits above agree with the bucket's prefix."""
    variants = sum(int((left >= w).sum()) * int(np.prod(np.arange(bits - w + 1, bits + 1)) // max(1, w)) for w in range(int(left.max(initial=0)) + 1))
    if variants > 2 * BUCKET_VARIANTS and bits > 24 and len(fps) > 1:
        bit, found = (fps >> np.uint64(bits - 1)) & np.uint64(1), []
        for side in (0, 1):
            free = left - (bit != side)
            own = np.flatnonzero(free >= 0)
            a, b = _join_equal(fps[own], free[own], bits - 1)
            found.append((own[a], own[b]))
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    low = fps & np.uint64((1 << bits) - 1)
    values, who = [], []
    for weight in range(int(left.max(initial=0)) + 1):
        own = np.flatnonzero(left >= weight)
        masks = _masks(bits, weight)
        values.append((low[own][:, None] ^ masks[None, :]).ravel())
        who.append(np.repeat(own, len(masks)))
    v, w = np.concatenate(values), np.concatenate(who)
    order = np.argsort(v, kind="stable")
    v, w = v[order], w[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    a, b = w[same], w[same + 1]
    pairs = np.unique(np.minimum(a, b) * np.int64(len(fps)) + np.maximum(a, b))
    return pairs // max(1, len(fps)), pairs % max(1, len(fps))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches over the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _bucket_task(prefix_bits: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(rows["fp"].to_numpy().view(np.uint64))
        bits = 64 - prefix_bits
        prefix = fps >> np.uint64(bits) if prefix_bits else np.zeros(len(fps), np.uint64)
        flips = np.bitwise_count(prefix ^ np.uint64(key[0])).astype(np.int64)
        root = forest(len(fps), *_join_equal(fps, RADIUS // 2 - flips, bits))
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[linked].view(np.int64), "b": fps[root[linked]].view(np.int64)})

    return run


def links(fps: DataFrame, n: int) -> DataFrame:
    """Links (a, b) over the n distinct fingerprints ``fps`` (column fp) that connect all pairs within RADIUS bits."""
    prefix_bits = max(0, min(24, int(n * 2081 / BUCKET_VARIANTS).bit_length()))
    if prefix_bits:
        masks = [int(m) for w in range(RADIUS // 2 + 1) for m in _masks(prefix_bits, w)]
        own = F.shiftrightunsigned("fp", 64 - prefix_bits)
        dealt = fps.select("fp", F.explode(F.transform(F.lit(masks).cast("array<long>"), lambda m: own.bitwiseXOR(m))).alias("bucket"))
    else:
        dealt = fps.select("fp", F.lit(0).cast("long").alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(_bucket_task(prefix_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable over edges (a, b). Alternates large-star and
    small-star steps, each an aggregate and a join, until the edges no longer change; every round is a table
    in the shared folder."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = stored(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.xxhash64("b", "a") % 1000003)).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``."""
    fps = stored(fingerprints(docs, size), "fingerprints")
    groups = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    roots = components(links(groups.select("fp"), groups.count()))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp", "left")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component; all columns stay."""
    kept = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
