"""Segments: runs of whole texts with a number of their own, the unit that the text indexes work on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

from foliant.llm._bytes import flat, groups_of


def segments_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Of batches (doc_id, text): (segment, doc_ids, bytes, offsets) for runs of whole texts of about ``most``
    bytes. Segment numbers are unique over the job: the task's partition above a count. They are only stable
    once they are written down, as the partitions of a re-run may differ."""
    from pyspark import TaskContext

    base, count = TaskContext.get().partitionId() << 32, 0
    ids: list[pa.Array] = []
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def full():
        nonlocal ids, parts, sizes, held, count
        lengths = np.concatenate(sizes)
        out = base + count, pa.concat_arrays(ids), np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ids, parts, sizes, held, count = [], [], [], 0, count + 1
        return out

    for batch in batches:
        data, offsets = flat(batch.column(1))
        for first, last in groups_of(offsets, most):
            size = int(offsets[last] - offsets[first])
            if held and held + size > most:
                yield full()
            ids.append(batch.column(0).slice(first, last - first))
            parts.append(data[offsets[first] : offsets[last]])
            sizes.append(np.diff(offsets[first : last + 1]))
            held += size
    if ids:
        yield full()


def planes(values: np.ndarray) -> bytes:
    """Little-endian 32-bit words with equal bytes together, which a file's codec then shortens."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


TEXTS = "segment long, doc_ids array<long>, sizes binary, data binary"
#: Files of long rows: row groups and pages of a few rows, so that neither writer nor reader holds more of a file, however large.
GROUP_BYTES = 8 << 20
#: Bytes of segments that a Python worker gets at a time, about; one more row at most.
BATCH_BYTES = 4 << 20
FEW_ROWS = {"compression": "zstd", "parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def text_segments(docs, most: int, key: str = "doc_id", text: str = "text"):
    """Stored table of segments with their texts: doc_ids, sizes in bytes (64-bit words) and the bytes."""
    from pyspark.sql import functions as F

    from foliant.llm._tables import new_path

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, ids, data, offsets in segments_of(batches, most):
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([segment]), lists, pa.array([np.diff(offsets).tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["segment", "doc_ids", "sizes", "data"])

    path = new_path(docs.sparkSession, "segments")
    docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, TEXTS).write.options(**FEW_ROWS).parquet(path)
    return docs.sparkSession.read.schema(TEXTS).parquet(path)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch of segments, one at a time: a batch may hold many, and as Python objects all would be there twice."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


@contextmanager
def few_segments(spark) -> Iterator[None]:
    """Within it, a Python worker gets two or so segments at a time instead of Arrow's default of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def opened(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, bytes and offsets of a row of ``text_segments``."""
    return row["doc_ids"], np.frombuffer(row["data"], np.uint8), np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])


def packed(sorted_words: np.ndarray) -> bytes:
    """Ascending 64-bit words as differences, byte planes apart, shortened."""
    import zstandard

    gaps = np.diff(sorted_words, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    gaps = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64)


def packed_counts(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(planes(values), 1)


def unpacked_counts(raw: bytes) -> np.ndarray:
    import zstandard

    return from_planes(zstandard.decompress(raw))
