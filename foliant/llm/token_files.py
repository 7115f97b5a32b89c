"""Operator 9, token ids in Parquet list columns.

``write_tokens`` range-partitions the documents by id, encodes each whole text inside the tasks and writes
one row for each document: ``doc_id, part, start_in_part, n_tokens, ids``. Files are in ascending id order
(``part`` numbers the ranges), row groups and pages have a set size, and the writer's page indexes let a
reader fetch the metadata columns alone or the ids of some documents alone (``read_tokens``). ``encoding``
is ``dictionary`` or ``delta`` (DELTA_BINARY_PACKED pages of the format's second version).

Results for odd rows: a null or empty text is the end id alone. Rows that share a doc_id are written one by
one, ordered by text. A null doc_id sorts first. An empty table gives no rows. Other columns are not read.

Distinct pieces are encoded once for each worker: the vocabulary's pre-tokenizer never joins characters across
ASCII white space, so a text's ids are its pieces' ids end to end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.llm._bytes import LOWER, SPACE, text_groups, word_hashes, word_spans
from foliant.llm._tables import documents, new_path, partitions_for

END_ID = 1
PART_BYTES = 24 << 20
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
MEMO = 1_000_000

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start_in_part", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)
_WRITERS = {
    "dictionary": {"parquet.enable.dictionary": "true"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"},
}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Classes of bytes within white-space-separated words, once lower-cased.
_BLANK, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _ODD, dtype=np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x61:0x7B] = _LETTER
_CLASS[SPACE] = _BLANK
_CLASS[0x27] = _ODD  # the vocabulary's pattern treats some endings behind an apostrophe as pieces
GROUP_BYTES = 4 << 20


class PieceEncoder:
    """Ids of many texts at once.

    White space ends a piece, and within words of printable ASCII and Latin-1 letters so does each change
    between letters, digits and marks; these pieces are cut in numpy. Every other word is one piece here. The
    library encodes each distinct piece once (runs of letters many in one call); a memo by the pieces'
    64-bit hashes, emptied at ``MEMO`` entries, holds its ids. Two of n pieces share a hash with odds n^2 / 2^65."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.stop = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.stop[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """hashes: of known pieces, ascending; their ids are pool[start : start + size]."""
        self.hashes, self.start, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encoded(self, pieces: list[bytes], runs: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each has; the first ``runs`` pieces are runs of letters,
        whose last token says so."""
        ids, sizes = [], []
        for first in range(0, runs, 10_000):
            some = pieces[first : min(runs, first + 10_000)]
            got = self._library(b" ".join(some).decode())
            stops = np.flatnonzero(self.stop[got]) + 1
            if len(stops) == len(some) and stops[-1] == len(got):
                ids.append(got)
                sizes.append(np.diff(stops, prepend=0))
            else:
                break
        for x in pieces[sum(map(len, sizes)) :]:
            ids.append(self._library(x.decode("utf-8", "replace")))
            sizes.append(np.array([len(ids[-1])]))
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes; starts, ends, text numbers and first classes of all pieces."""
        data = LOWER[raw]
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        upper = (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        data[lead[upper] + 1] += 32
        letter = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
        kind[np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))] = _ODD  # may begin a special token
        starts, ends, text = word_spans(data, offsets)
        # words with an odd byte stay whole, as they came
        odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
        whole = odd[ends] > odd[starts]
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        np.add.at(inside, starts[whole], 1)
        np.add.at(inside, ends[whole], -1)
        inside = np.cumsum(inside[:-1]) > 0
        data[inside] = raw[inside]
        kind[inside] = _ODD
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | ((kind[1:] == _DIGIT) & (kind[:-1] == _DIGIT))
        cut[starts] = True
        cut[:-1] &= kind != _BLANK
        begin = np.flatnonzero(cut[:-1])
        owner = np.searchsorted(starts, begin, "right") - 1
        stop = np.minimum(np.append(begin[1:], len(data)), ends[owner]) if len(begin) else begin
        return data, begin, stop, text[owner], kind[begin]

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, each text's followed by end_id; and the number of ids of each text."""
        n = len(offsets) - 1
        if len(self.hashes) > MEMO:
            self.forget()
        data, begin, stop, text, kind = self._cut(raw, offsets) if len(raw) > 1 else self._cut(np.append(raw, [0x20, 0x20]).astype(np.uint8), offsets)
        h = word_hashes(data, begin, stop) ^ (kind == _ODD).astype(np.uint64)
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[at] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(new):
            letters = kind[first[new]] == _LETTER
            new = np.concatenate([new[letters], new[~letters]])
            whole, own = data.tobytes(), first[new]
            ids, size = self._encoded([whole[a:b] for a, b in zip(begin[own].tolist(), stop[own].tolist(), strict=True)], int(letters.sum()))
            hashes = np.concatenate([self.hashes, unique[new]])
            start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.start, self.size, self.pool = hashes[order], start[order], np.concatenate([self.size, size])[order], np.concatenate([self.pool, ids])
            at = np.searchsorted(self.hashes, unique)
        size, start = self.size[at][back], self.start[at][back]
        before = np.cumsum(size) - size
        total = int(size.sum())
        out = np.full(total + n, end_id, dtype="<u4")
        spot = np.arange(total)
        out[spot + np.repeat(text, size)] = self.pool[spot + np.repeat(start - before, size)]
        return out, np.bincount(text, weights=size, minlength=n).astype(np.int64) + 1


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _encoding_task(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(path), 0
        for batch in batches:
            for first, last, data, offsets in text_groups(batch.column(1), GROUP_BYTES):
                out, sizes = enc.encode(data, offsets, end_id)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(ends - sizes + at), pa.array(sizes), ids], names=["doc_id", "start_in_part", "n_tokens", "ids"])
                at += int(ends[-1])

    return run


def file_order(docs: DataFrame) -> Column:
    """The place of each row in the files that ``docs`` is read from; the doc_id for any other DataFrame."""
    if not docs.inputFiles():
        return F.col("doc_id")
    return F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index"))


def write_tokens(docs: DataFrame, path: str, order: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID, encoding: str = "dictionary") -> None:
    """Encode ``docs`` (doc_id, text and ``order``) and write the token files to ``path``."""
    n = partitions_for(docs, PART_BYTES)
    dealt = docs.select("doc_id", "text", F.col(order).alias("__order")).repartitionByRange(n, "__order").sortWithinPartitions("__order", "text")
    rows = dealt.select("doc_id", "text").mapInArrow(_encoding_task(vocabulary or default_vocabulary(), end_id), SCHEMA)
    options = _WRITERS[encoding] | {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "compression": "zstd"}
    rows.select("doc_id", F.spark_partition_id().alias("part"), "start_in_part", "n_tokens", "ids").write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the token files with ``start``, the ids of all documents before; optionally without the ids,
    or only documents low <= doc_id <= high (pushed to row groups and pages)."""
    files = spark.read.parquet(path)
    rows = files.select("doc_id", "part", "start_in_part", "n_tokens", *(["ids"] if ids else []))
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return rows.join(read_starts(spark, path), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before", "start_in_part")


def _crc_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        offsets = np.asarray(ids.offsets).tolist()
        data = np.asarray(ids.values, dtype="<i4").tobytes()
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "part", "start_in_part")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, all from the files as written."""
    rows = spark.read.parquet(path).select("doc_id", "part", "start_in_part", "ids").mapInArrow(_crc_task, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(read_starts(spark, path), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids before each range of documents, from the metadata columns alone."""
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    return token_digests(spark, path)


QUERIES = {"op9_token_files": op9_token_files}
ORACLES: dict[str, str] = {}
