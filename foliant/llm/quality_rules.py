"""Operator 1, quality rules: a threshold table compiled into one Spark projection.

Each rule is (name, metric, comparison, threshold). ``compile_rules`` turns the table into boolean
columns over the metrics that ``with_metrics`` projects; nothing leaves the JVM and nothing shuffles.

Results for odd rows: a null text has no words and no lines, so every count is 0, ``base_failed`` is true
and ``kept`` false; an empty text is the same. Repeated rows are judged one by one. A table without rows
gives none. Other columns of the input, whatever their names, are neither read nor returned by the query.

Repeated 3-word windows are found by sorting, in each text, 64-bit words made of a window's hash and, in
as many low bits as the text needs, its position; neighbours of equal hash count as equal only after their
words are compared. A window could be missed only where two different windows of one text share the hash
bits and interleave with a repeat (about n^3 / 2^65 for a text of n words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._tables import documents

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

#: Common function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it was with as on be by this are at from or an have not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur avec il ne se".split(),
    "es": "de la que el en y a los se del las un por con una su para es al lo como más o pero".split(),
}

#: (rule, metric, comparison, threshold); all must hold for a text that passes the base rules.
RULES = [
    ("mean_word_length_low", "mean_word_chars", ">=", 2.0),
    ("mean_word_length_high", "mean_word_chars", "<=", 14.0),
    ("symbol_ratio", "symbol_ratio", "<=", 0.2),
    ("stop_word_ratio", "stop_ratio", ">=", 0.04),
    ("duplicate_line_ratio", "dup_line_ratio", "<=", 0.5),
    ("mean_line_words", "mean_line_words", ">=", 2.0),
]

_COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _trigram(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]


def with_metrics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, the base counts, the ratios that rules may name) of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("k"), t.alias("t"))
    spaced = F.translate(F.col("t"), WHITE, " " * len(WHITE))
    words = base.select("k", "t", F.array_remove(F.split(spaced, " "), "").alias("w"), F.filter(F.split(F.col("t"), "\n"), lambda x: _without(x, WHITE) != "").alias("lines"))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    sized = words.select(
        "k",
        "w",
        F.size("w").alias("n"),
        F.length(_without(F.col("t"), WHITE)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(stop))).alias("n_stop"),
    )
    # positions need `bits` low bits; the hash of the window fills the rest
    bits = F.length(F.bin(F.col("n").cast("long")))
    shifted = sized.withColumn("bits", bits.cast("int"))
    packed = F.when(
        F.col("n") >= 4,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.col("n") - 3),
                lambda i: F.call_function("shiftleft", F.xxhash64(*_trigram(F.col("w"), i)), F.col("bits")).bitwiseOR(i.cast("long")),
            )
        ),
    )
    ordered = shifted.withColumn("s", packed)
    position = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))

    def same(i: Column, j: Column) -> Column:
        a, b = F.get("s", i), F.get("s", j)
        words_equal = F.lit(True)
        for x, y in zip(_trigram(F.col("w"), position(a)), _trigram(F.col("w"), position(b)), strict=True):
            words_equal = words_equal & (x == y)
        return F.coalesce((high(a) == high(b)) & words_equal, F.lit(False))

    # x and its neighbour in the sorted array: both are positions of a repeated window
    twice = F.filter(F.sequence(F.lit(1), F.size("s") - 1), lambda i: same(i - 1, i))
    pairs = ordered.withColumn("twice", F.when(F.size("s") >= 2, twice))
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform("twice", lambda i: F.array(position(F.get("s", i - 1)), position(F.get("s", i)))))))
    spots = pairs.withColumn("p", F.coalesce(starts, F.array().cast("array<int>"))).drop("s", "twice", "w")
    # every start covers three words, less what the next start covers again
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("p") - 1),
        F.lit(0).cast("long"),
        lambda acc, i: acc + F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - F.get("p", i), F.lit(3))).cast("long"),
    )
    counted = spots.withColumn("n_repeat_words", F.when(F.size("p") > 0, covered).otherwise(F.lit(0).cast("long")))
    n = F.col("n")
    return counted.select(
        F.col("k").alias(key),
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        _ratio(F.col("word_chars"), n).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), n).alias("symbol_ratio"),
        _ratio(F.col("n_stop"), n).alias("stop_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(n, F.col("n_lines")).alias("mean_line_words"),
    )


def compile_rules(rules: list[tuple[str, str, str, float]]) -> list[Column]:
    """A boolean column ``rule_<name>`` for each rule: true where the rule holds."""
    return [_COMPARE[op](F.col(metric), F.lit(limit)).alias(f"rule_{name}") for name, metric, op, limit in rules]


def quality(docs: DataFrame, rules: list[tuple[str, str, str, float]] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts, ``base_failed``, every rule's verdict and ``kept`` for each row of ``docs``."""
    m = with_metrics(docs, text, key)
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    holds = F.lit(True)
    for name, *_ in rules:
        holds = holds & F.col(f"rule_{name}")
    return m.select("*", failed.alias("base_failed"), *compile_rules(rules)).withColumn("kept", ~F.col("base_failed") & holds)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    rules = " AND ".join(f"{metric} {op} {limit}" for _, metric, op, limit in RULES)
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
 g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
 h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
 p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1) GROUP BY r),
 m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, len(array_to_string(w.w, ''))::BIGINT AS word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
   (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(ls) AS nl, len(list_filter(w.w, lambda x: lower(x) IN ({stop}))) AS ns
   FROM w LEFT JOIN p ON w.r = p.r),
 f AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
   CASE WHEN n_words > 0 THEN ns / n_words ELSE 0 END AS stop_ratio, CASE WHEN nl > 0 THEN n_dup_lines / nl ELSE 0 END AS dup_line_ratio, CASE WHEN nl > 0 THEN n_words / nl ELSE 0 END AS mean_line_words,
   n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM f
"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": _sql()}
