"""Levels of a table: details and their summary must not both count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings of summaries, quantities of years or lots, headings of totals and of quantities, ignoring case.
SUMMARY_HEADING = r"\b(?:riepilogo|summary|recap|totali|totaux|r[ée]sum[eé]|resumen(?:\s+de\s+cantidades)?|zusammenfassung|quantit[aà]\s+triennale|triennal[e]?|trienal|annual\s+total|total\s+quantity|totale\s+triennale|vat\s+summary|vat\s+recap|riepilogo\s+iva|total\s+unidades\s+a[nñ]o|total\s+3\s+a[nñ]os|historical|previous\s+orders|statistics)\b"
AGGREGATE_QUANTITY = r"\b(?:\d{1,3}(?:[.\s]\d{3})+|\d{4,})\s*(?:pz|pcs|cf|nr|n)\b"
TOTALS_HEADING = r"\b(?:riepilogo\s+iva|vat\s+summary|totale\s+imposta)\b"
QUANTITY_HEADING = r"\b(?:quantit[aà]\s+triennale|annual\s+total|total\s+quantity|totale\s+triennale|resumen\s+de\s+cantidades|total\s+unidades\s+a[nñ]o|total\s+3\s+a[nñ]os|triennal[e]?|trienal)\b"


def _is(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False))


def heading_role(text: Column) -> Column:
    """'totals_only', 'aggregate_summary', 'summary', or null for a line that is no such heading."""
    return F.when(_is(text, TOTALS_HEADING), "totals_only").when(_is(text, QUANTITY_HEADING), "aggregate_summary").when(_is(text, SUMMARY_HEADING), "summary")


def _tokens(text: Column) -> Column:
    """Distinct words of four letters and more."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\u00c0-\u024f]+", " "), " "), lambda w: F.length(w) >= 4))


def select_level(items: DataFrame, lines: DataFrame, totals: DataFrame) -> DataFrame:
    """The rows of ``items`` (doc, line, description, quantity, price, total) that count, with ``level`` and ``reason``.

    ``lines`` (doc, line, text) hold the headings, ``totals`` (doc, document_total) what the sums are held against. What stands from the first
    summary's heading on, names one itself, or is a quantity without a price is summary, the rest is detail. Without a heading, both
    are kept unless a summary repeats two words of details; under one, unless all rows have prices and no words are
    repeated. Else one level stays: the one with more complete rows whose sum is the document's total, in doubt the details. A heading of totals only drops rows that name it. Documents with one
    item keep it. A null description has no words; equal rows stay equal."""
    described = F.coalesce("description", F.lit(""))
    heads = lines.withColumn("role", heading_role(F.col("text"))).filter(_is(F.col("text"), SUMMARY_HEADING)).groupBy("doc").agg(F.min("line").alias("head"), F.min_by(F.coalesce("role", F.lit("summary")), "line").alias("role"))
    named = _is(described, SUMMARY_HEADING)
    lot = named | (_is(described, AGGREGATE_QUANTITY) & (F.coalesce("price", F.lit(0.0)) == 0))
    i = items.withColumn("__i", F.monotonically_increasing_id()).join(heads, "doc", "left").join(totals.select("doc", "document_total"), "doc", "left")
    i = i.withColumns({"__named": named, "__summary": F.when(F.col("role") == "totals_only", named).otherwise(lot | F.coalesce(F.col("line") >= F.col("head"), F.lit(False)))})
    complete = F.col("total").isNotNull() & (F.col("price").isNotNull() | F.col("quantity").isNotNull())
    of = lambda side, x: F.sum(F.when(F.col("__summary") == side, x))
    size = lambda side: F.count(F.when(F.col("__summary") == side, 1))

    def score(side: bool) -> Column:
        gap, whole = F.abs(F.coalesce(of(side, F.coalesce("total", F.lit(0.0))), F.lit(0.0)) - F.first("document_total", True)), F.first("document_total", True)
        fits = F.when(gap <= F.greatest(F.lit(0.05), whole * 0.02), 20.0).otherwise(-F.least(F.lit(12.0), gap / F.greatest(F.lit(1.0), whole) * 10))
        return F.coalesce(of(side, complete.cast("int")), F.lit(0)) * 4 + size(side) - (2 if side else 0) + F.when(whole > 0, fits).otherwise(0.0)

    docs = i.groupBy("doc").agg(F.count("*").alias("n"), F.first("role", True).alias("role"), size(False).alias("details"), size(True).alias("summaries"), F.min(F.col("price").isNotNull()).alias("priced"), score(False).alias("own"), score(True).alias("other"))
    words = i.select("doc", "__i", "__summary", F.explode(_tokens(F.col("description"))).alias("word"))
    counted = words.filter("NOT __summary").groupBy("doc", "word").agg(F.count("*").alias("times"))
    shared = words.filter("__summary").join(counted, ["doc", "word"]).groupBy("doc", "__i").agg(F.sum("times").alias("times")).filter("times >= 2").select("doc").distinct().withColumn("repeats", F.lit(True))
    d = docs.join(shared, "doc", "left").withColumn("repeats", F.coalesce("repeats", F.lit(False)))
    reason = (
        F.when(F.col("n") < 2, "single_item")
        .when(F.col("role") == "totals_only", "totals_heading")
        .when((F.col("details") == 0) | (F.col("summaries") == 0), "single_level")
        .when(F.col("role").isNull() & ~F.col("repeats"), "no_repeated_words")
        .when(F.col("role").isNotNull() & F.col("priced") & ~F.col("repeats"), "additive_tables")
        .when(F.col("other") > F.col("own") + 2, "summary_reconciles")
        .otherwise("details_kept")
    )
    decided = i.drop("role").join(d.select("doc", reason.alias("reason")), "doc")
    keep = F.when(F.col("reason") == "totals_heading", ~F.col("__named")).when(F.col("reason") == "summary_reconciles", F.col("__summary")).when(F.col("reason") == "details_kept", ~F.col("__summary")).otherwise(True)
    level = F.when(F.col("reason").isin("single_item", "single_level"), "only").when(F.col("__summary"), "summary").otherwise("detail")
    return decided.filter(keep).select(*items.columns, level.alias("level"), "reason")
