"""Operator 6, line dedup with content-defined chunks of lines.

A text's lines are hashed, and a rolling hash over the hashes of ``ROLL`` lines in a row ends a chunk behind the
last of them where it falls into the lowest quarter; so inserted or deleted lines move no boundary farther off
than ROLL lines. A chunk of two lines or more whose bytes occurred before (in a smaller (doc_id, chunk)) goes.

A first pass shuffles hashes alone and finds, by partial aggregation, the chunk hashes that occur twice and
where each occurs first. A join by hash then drops the texts of all other chunks and the rest is written down, and
the later occurrences are joined to the first ones by hash and compared byte by byte; both joins have a single row
for each hash on one side, so adaptive execution can split a hash with very many occurrences. A different text with an equal hash stays.

Results for odd rows: a null or empty text has no lines. The work grows in proportion to a text's lines, also in a
text of very many. Rows that share doc_id and text count as one document
(neither takes away the other's lines); a null doc_id comes before all others. An empty table gives no rows.
Other columns are not read, and ``dedup_lines`` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.money import let
from foliant.llm._tables import documents, stored

ROLL = 2
#: Leading hex digits of the rolling hash that end a chunk: a quarter of all, four lines on average.
ENDS = "0123"


def _lines(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def _chunks(text: Column, body: bool) -> Column:
    """Of a text: an array of (idx, first, n) with lines counted from 1 and, if asked for, each chunk's text. Every array
    on the way is bound once with ``let``: a column used inside a function of another array would be worked out again
    for each element."""

    def by_lines(lines: Column) -> Column:
        def by_hashes(h: Column) -> Column:
            def last(_: Column, i: Column) -> Column:
                rolled = F.md5(F.concat(*(F.get(h, i - k) for k in range(ROLL - 1, -1, -1))).cast("binary"))
                return F.when((i == F.size(h) - 1) | (F.instr(F.lit(ENDS), F.left(rolled, F.lit(1))) > 0), i + 1)

            return let(F.array_compact(F.transform(h, last)), by_ends)

        def by_ends(ends: Column) -> Column:
            def chunk(end: Column, k: Column) -> Column:
                begin = F.coalesce(F.get(ends, k - 1), F.lit(0)) + 1
                text = [F.array_join(F.slice(lines, begin, end - begin + 1), "\n").alias("body")] if body else []
                return F.struct(k.alias("idx"), begin.alias("first"), (end - begin + 1).alias("n"), *text)

            return F.transform(ends, chunk)

        return let(F.transform(lines, lambda x: F.md5(x.cast("binary"))), by_hashes)

    return let(_lines(text), by_lines)


def chunked(docs: DataFrame, body: bool = False) -> DataFrame:
    """doc_id, tk (hash of the text), and chunks: (idx, first, n) with lines counted from 1."""
    return docs.select("doc_id", F.xxhash64("text").alias("tk"), _chunks(F.col("text"), body).alias("chunks"))


def _occurrences(docs: DataFrame, text: bool) -> DataFrame:
    """A row for each chunk of two lines or more: doc_id, tk, idx, first, n, bytes, h and, if asked for, its text. The
    chunks' texts are cut out before they become rows, so no row carries the lines of the whole text."""
    rows = chunked(docs, True).select("doc_id", "tk", F.inline(F.filter("chunks", lambda c: c["n"] > 1)))
    return rows.select("doc_id", "tk", "idx", "first", "n", F.octet_length("body").alias("bytes"), F.xxhash64("body").alias("h"), *(["body"] if text else []))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, tk, idx, first, n, bytes of every chunk that repeats an earlier one."""
    where = F.struct("doc_id", "tk", "idx")
    seen = _occurrences(docs, False).groupBy("h").agg(F.count("*").alias("times"), F.min(where).alias("lead")).filter("times > 1").select("h", "lead")
    # how many hashes repeat grows with the table, so the join that drops all other texts is the same at any size
    again = stored(_occurrences(docs, True).join(stored(seen, "repeated").hint("merge"), "h"), "occurrences")
    is_lead = (F.col("doc_id").eqNullSafe(F.col("lead.doc_id"))) & (F.col("tk") == F.col("lead.tk")) & (F.col("idx") == F.col("lead.idx"))
    # rows that share doc_id and text give equal rows here
    leads = again.filter(is_lead).select("h", F.col("body").alias("lead_body")).dropDuplicates(["h"])
    return again.filter(~is_lead).join(leads, "h").filter(F.col("body") == F.col("lead_body")).select("doc_id", "tk", "idx", "first", "n", "bytes")


def removals(docs: DataFrame) -> DataFrame:
    """For each document (doc_id, tk) that loses chunks: removed, an array of (first, n, bytes) in line order."""
    return repeats(docs).groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set(F.struct("first", "n", "bytes"))).alias("removed"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tk"] == b["tk"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, the text without its repeated chunks. A null text stays null."""
    gone = removals(docs).select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk"), F.col("removed").alias("__removed"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__tk"]), "left")

    def kept(x: Column) -> Column:
        """The runs of lines between the removed chunks, one slice each."""
        begin = lambda k: F.coalesce(F.get(x["gone"], k - 1)["first"] + F.get(x["gone"], k - 1)["n"], F.lit(1))
        before = F.transform(x["gone"], lambda r, k: F.slice(x["lines"], begin(k), r["first"] - begin(k)))
        return F.array_join(F.concat(F.flatten(before), F.slice(x["lines"], begin(F.size(x["gone"])), F.size(x["lines"]))), "\n")

    rest = let(F.struct(F.split("text", "\n").alias("lines"), F.col("__removed").alias("gone")), kept)
    return joined.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    n_lines = let(F.col("chunks"), lambda c: F.coalesce(F.try_element_at(c, F.lit(-1))["first"] + F.try_element_at(c, F.lit(-1))["n"] - 1, F.lit(0)))
    sizes = chunked(docs).select("doc_id", "tk", n_lines.cast("long").alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"))
    gone = removals(docs)
    span = lambda r: F.concat_ws("-", r["first"].cast("string"), (r["first"] + r["n"] - 1).cast("string"))
    joined = sizes.join(gone, _same(sizes, gone), "left")
    add = lambda f: F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r[f].cast("long")), F.lit(0).cast("long"))
    return joined.select(
        sizes["doc_id"],
        "n_lines",
        "n_chunks",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed_chunks"),
        add("n").alias("n_removed_lines"),
        add("bytes").alias("n_removed_bytes"),
        F.coalesce(F.array_join(F.transform("removed", span), ","), F.lit("")).alias("removed_spans"),
    )


_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS ls FROM documents),
 l AS (SELECT doc_id, i, ls[i] AS line, len(ls) AS n, CASE WHEN i > 1 THEN md5(md5(ls[i - 1]) || md5(ls[i])) END AS r FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
 e AS (SELECT *, CASE WHEN i = n OR coalesce(contains('{ENDS}', left(r, 1)), false) THEN 1 ELSE 0 END AS e FROM l),
 c AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
 g AS (SELECT doc_id, k, min(i) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, k),
 m AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS occ FROM g WHERE n > 1),
 x AS (SELECT doc_id, count(*) AS nc, sum(n) AS nl, sum(strlen(body)) AS nb, string_agg(first || '-' || (first + n - 1), ',' ORDER BY first) AS spans FROM m WHERE occ > 1 GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_chunks FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.ls)::BIGINT AS n_lines, coalesce(t.n_chunks, 0)::BIGINT AS n_chunks, coalesce(x.nc, 0)::BIGINT AS n_removed_chunks, coalesce(x.nl, 0)::BIGINT AS n_removed_lines,
 coalesce(x.nb, 0)::BIGINT AS n_removed_bytes, coalesce(x.spans, '') AS removed_spans
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": _SQL}
