"""Monetary reconciliation of documents with their lines and tax summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.money import close_enough


def check_lines(lines: DataFrame) -> DataFrame:
    """Adds ``consistent``: quantity * unit_price, with or without a percentage discount, is the line total.
    A line that lacks one of the three is not judged (true)."""
    gross = F.col("quantity") * F.col("unit_price")
    percent = (F.col("discount") > 0) & (F.col("discount") < 100)
    net = F.when(percent, gross * (1 - F.col("discount") / 100)).otherwise(gross)
    ok = close_enough(net, F.col("line_total")) | close_enough(gross, F.col("line_total"))
    return lines.withColumn("consistent", F.coalesce(ok, F.lit(True)))


def _any_close(candidates: list[Column], target: Column) -> Column:
    out = F.lit(False)
    for c in candidates:
        out = out | F.coalesce(close_enough(c, target), F.lit(False))
    return out


def reconcile(headers: DataFrame, lines: DataFrame, taxes: DataFrame | None = None) -> DataFrame:
    """headers (doc_id, subtotal, discount_total, shipping, vat, total) against lines (doc_id, line_total) and taxes
    (doc_id, vat): doc_id, n_lines, line_sum and the conflicts in a fixed order, joined by commas.

    Lines and taxes are summed up map-side first, so documents of very many lines shuffle a row a task."""
    sums = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("line_total").alias("n_amounts"), F.sum("line_total").alias("line_sum"))
    joined = headers.join(sums, "doc_id", "left")
    if taxes is None:
        joined = joined.withColumns({"n_taxes": F.lit(0).cast("long"), "tax_sum": F.lit(None).cast("double")})
    else:
        joined = joined.join(taxes.groupBy("doc_id").agg(F.count("vat").alias("n_taxes"), F.sum("vat").alias("tax_sum")), "doc_id", "left")
    s, d, f = F.col("line_sum"), F.abs("discount_total"), F.col("shipping")
    complete = (F.col("n_lines") > 0) & (F.col("n_lines") == F.col("n_amounts")) & F.col("subtotal").isNotNull()
    conflicts = F.array_compact(
        F.array(
            F.when(complete & ~_any_close([s, s - d, s + f, s - d + f], F.col("subtotal")), "line_sum_subtotal_mismatch"),
            F.when(~close_enough(F.col("subtotal") + F.col("vat"), F.col("total")), "subtotal_vat_total_mismatch"),
            F.when((F.col("n_taxes") > 1) & ~close_enough(F.col("tax_sum"), F.col("vat")), "tax_summary_vat_mismatch"),
        )
    )
    return joined.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "line_sum", F.array_join(conflicts, ",").alias("conflicts"), (F.size(conflicts) == 0).alias("consistent"))


def arithmetic_totals(amounts: DataFrame, most: int = 48, totals: int = 24) -> DataFrame:
    """Of amounts (doc_id, value): for each document the largest total with subtotal + vat = total and vat between 3
    and 35 % of the subtotal, among its ``most`` largest distinct amounts."""
    from pyspark.sql.window import Window

    ranked = amounts.filter("value > 0").select("doc_id", "value").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("value")))).filter(F.col("rank") <= most)
    lists = ranked.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list("value"))).alias("v"))  # at most `most` values
    fits = lambda t: F.filter(
        F.transform("v", lambda s: F.struct(t.alias("total"), s.alias("subtotal"), (F.floor((t - s) * 100 + 0.5) / 100).alias("vat"))),
        lambda x: (x["vat"] >= x["subtotal"] * 0.03) & (x["vat"] <= x["subtotal"] * 0.35) & F.exists("v", lambda y: F.abs(y - x["vat"]) <= 0.02),
    )
    found = lists.select("doc_id", F.array_max(F.flatten(F.transform(F.slice("v", 1, totals), fits))).alias("best"))
    return found.filter("best IS NOT NULL").select("doc_id", "best.subtotal", "best.vat", "best.total")
