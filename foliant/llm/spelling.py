"""Operator 13, groups of spelling variants, by halves that one edit leaves intact.

``dictionary`` counts the words of all texts. Two words are near if one inserted, deleted or replaced code point
makes the one out of the other; where the shorter has s code points, such an edit leaves either the first s / 2
or the last s - s / 2 of them intact. So every word stands in the blocks of the words that share that beginning
with it (the forward dictionary, in ranges of a shared prefix) and in those that share that end (the reversed one),
for its own length and for the length below. A block of more than ``BLOCK`` words is subdivided: what its words don't
share yet is halved in the same way, and again one half of it is intact, so that no pair is lost; this ends where
one code point is left, of which there are no more kinds than letters. Words of a block are compared with each
other, and every pair is verified by its edit distance. Forms and roots follow by joins; as a form is at least
``RATIO`` times as frequent as its word, chains are short, and roots are found by doubling.

Results for odd rows: null, empty and letterless texts have no words; a null doc_id counts as the text '' in
the hash. Rows that share a doc_id are counted one by one. A text of any length is read in pieces, and a run of letters of
any length is one word. Ties of frequency go to the smallest word in code-point order. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._bytes import LOWER
from foliant.llm._tables import documents, stored

#: Code points of a word, and its occurrences, at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its word, at least.
RATIO = 5
#: One run in so many, by hash, loses a code point.
DAMAGE = 199
#: Words of a block that are compared with each other; larger blocks are subdivided.
BLOCK = 64
#: Bytes of a text that are cut into runs at a time, and words that a task counts before it sends the counts on.
PIECE, HELD = 1 << 20, 1 << 18

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % LEAST_LENGTH)
_BREAK = re.compile(rb"[^a-z\x80-\xff]")


def pieces(text: bytes, most: int = PIECE) -> Iterator[bytes]:
    """The lower-cased text, cut where no run of letters is."""
    first = 0
    while first < len(text):
        cut = _BREAK.search(text, first + most) if first + most < len(text) else None
        last = cut.start() if cut else len(text)
        yield text[first:last]
        first = last


def words_of(doc_id: int | None, text: bytes, damage: int = DAMAGE) -> Iterator[tuple[bytes, int]]:
    """The words of one text with their occurrences."""
    runs: Counter = Counter()
    for piece in pieces(text.translate(LOWER.tobytes())):
        runs.update(_RUN.findall(piece))
    begin = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
    for run, n in runs.items():
        h = zlib.crc32(run, begin)
        if h % damage == 0:
            letters = run.decode()
            at = h % len(letters)
            letters = letters[:at] + letters[at + 1 :]
            if len(letters) < LEAST_LENGTH:
                continue
            run = letters.encode()
        elif len(run) < 2 * LEAST_LENGTH and len(run.decode()) < LEAST_LENGTH:
            continue
        yield run, n


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            for word, n in words_of(doc_id, text.as_py() or b""):
                held[word] += n
            if len(held) >= HELD:
                yield sent()
    if held:
        yield sent()


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts with at least LEAST_COUNT occurrences."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count_task, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _spans(s: Column, lo: Column, tail: Column) -> list[Column]:
    """The two halves of what words of a block don't share: so many code points at the begin and at the end."""
    half = F.floor((s - lo - tail) / 2).cast("int")
    rest = s - lo - tail - half
    return [F.struct(s.alias("s"), (lo + half).alias("lo"), tail.alias("tail")), F.struct(s.alias("s"), lo.alias("lo"), (tail + rest).alias("tail"))]


def _members(words: DataFrame, spans: Column) -> DataFrame:
    """(block, s, lo, tail, word, n, length), a row for each span of a word."""
    held = words.select("word", "n", "length", F.explode(spans).alias("span")).select("word", "n", "length", "span.*")
    begin, end = F.expr("left(word, lo)"), F.expr("right(word, tail)")
    return held.withColumn("block", F.xxhash64("s", "lo", "tail", begin, end))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(block, s, word, n, length) of the blocks to compare: every near pair shares one in which the shorter word
    has s code points."""
    length, none = F.col("length"), F.lit(0)
    spans = F.concat(F.array(*_spans(length, none, none)), F.when(length > LEAST_LENGTH, F.array(*_spans(length - 1, none, none))).otherwise(F.array()))
    level, found = _members(words.withColumn("length", F.char_length("word")), spans), []
    while True:
        level = stored(level, "blocks")
        sizes = level.groupBy("block").agg(F.count("*").alias("size"), F.max(F.col("s") - F.col("lo") - F.col("tail")).alias("free")).filter("size > 1")
        sizes = sizes.withColumn("split", (F.col("size") > most) & (F.col("free") > 1))
        sized = level.join(sizes.select("block", "split"), "block")
        found.append(sized.filter("NOT split").select("block", "s", "word", "n", "length"))
        if sizes.filter("split").isEmpty():
            return reduce(DataFrame.unionAll, found)
        level = _members(sized.filter("split").select("word", "n", "length", F.array(*_spans(F.col("s"), F.col("lo"), F.col("tail"))).alias("spans")), F.col("spans"))


def near_pairs(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(a, n_a, b, n_b): each near pair of ``words`` (word, n) once."""
    held = blocks(words, most)
    x = held.filter("length = s").select("block", F.col("word").alias("a"), F.col("n").alias("n_a"), "s")
    y = held.select("block", F.col("word").alias("b"), F.col("n").alias("n_b"), "length")
    pairs = x.join(y, "block").filter(((F.col("length") > F.col("s")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of ``forms`` (word, form) along the forms to the last."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of the texts."""
    words = stored(dictionary(docs), "words")
    pairs = near_pairs(words)
    both = pairs.unionAll(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("rank"), F.col("b").alias("form"))).alias("best"))
    is_form = -F.col("best.rank") >= RATIO * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.rank")).alias("form_n")
    )
    found = stored(found, "forms")
    return found.join(roots(found.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir)).select("word", "n", "n_near", "form", "form_n", "root")


QUERIES = {"op13_spelling": op13_spelling}
#: The damage of runs by crc32 has no SQL form; tests/llm/test_spelling.py has the brute force.
ORACLES: dict[str, str] = {}
