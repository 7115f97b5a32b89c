"""Queries on totals put right and on VAT columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.money import cents
from foliant.operators import repairs as R
from foliant.plans.money import _t


def repaired_totals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as totals with VAT, of sixteen fifteen damaged in a way of their own."""
    k, t = F.col("o_orderkey") % 16, F.col("o_totalprice")
    s = F.floor(t / 1.22 * 100 + 0.5) / 100
    v = F.floor((t - s) * 100 + 0.5) / 100
    total = F.when(k == 1, v).when(k == 4, t * 1000).when(k == 13, F.lit(float("nan"))).when(k == 14, F.lit(50.0)).otherwise(t)
    subtotal = F.when(k == 3, -s).when(k == 6, t * 1.5).when(k == 7, t * 1.1).when(k == 8, t).when(k.isin(9, 10), F.lit(None)).when(k == 14, F.lit(None)).otherwise(s)
    vat = F.when(k == 2, F.lit(22.0)).when(k == 5, F.lit(12345678901.0)).when(k == 9, t * 2).when(k == 10, t).when(k == 14, F.lit(9.0)).when(k == 15, F.lit(-1.0)).otherwise(v)
    rows = _t(spark, d, "orders").select("o_orderkey", total.alias("total"), subtotal.alias("subtotal"), vat.alias("vat"), F.when(k == 11, t * 3).when(k == 12, F.lit(None)).otherwise(s).alias("items"))
    found = R.repair_totals(rows)
    reasons = F.array_join(F.transform("steps", lambda x: x["reason"]), ",")
    path = F.array_join(F.transform("steps", lambda x: F.coalesce(cents(x["total"]).cast("string"), F.lit("-"))), ",")
    return found.select("o_orderkey", cents(F.col("total")).alias("total_cents"), cents(F.col("subtotal")).alias("subtotal_cents"), cents(F.col("vat")).alias("vat_cents"), reasons.alias("reasons"), path.alias("totals_behind"), "requires_review")


_BOTH = "floor((s + v) * 100 + 0.5) / 100"
_FISCAL = "(abs({0} - floor({0} + 0.5)) <= 0.05 AND floor({0} + 0.5) BETWEEN 100000000 AND 9999999999999)"
_FITS, _MORE, _DISCOUNTED = "coalesce(abs(s + v - t) <= 0.05, false)", "i > t * 1.02", "coalesce(s >= i * 0.98 AND s > t + 0.05, false)"
_STEPS = [
    ("subtotal_non_positive", "s <= 0", {"s": "NULL"}),
    ("total_non_positive", "t <= 0", {"t": "NULL"}),
    ("vat_negative", "v < 0", {"v": "NULL"}),
    ("vat_amount_looks_like_fiscal_id", _FISCAL.format("v"), {"v": "NULL"}),
    ("vat_amount_looks_like_rate", "v > 0 AND v <= 23 AND v = floor(v) AND (s IS NULL OR s > 200)", {"v": "NULL"}),
    ("subtotal_looks_like_fiscal_id", _FISCAL.format("s"), {"s": "NULL"}),
    ("total_looks_like_fiscal_id", _FISCAL.format("t"), {"t": "NULL"}),
    ("grand_total_absurd_vs_commercial_values", f"s > 0 AND v >= 0 AND t > greatest({_BOTH}, s, coalesce(i, 0), 1) * 100", {"t": _BOTH}),
    ("total_equals_vat_amount", "abs(t - v) <= 0.05 AND s > v + 0.05", {"t": _BOTH}),
    ("subtotal_exceeds_total", "s > t + 0.05 AND s > t * 1.15", {"s": "NULL", "v": "NULL"}),
    ("subtotal_before_discount", "s > t + 0.05 AND s <= t * 1.15", {}),
    ("grand_total_equals_subtotal_with_vat", f"abs(s - t) <= 0.05 AND v > 0.05 AND abs({_BOTH} - t) > 0.05", {"t": _BOTH}),
    ("vat_exceeds_total", "s IS NULL AND v > t + 0.05", {"v": "NULL"}),
    ("vat_equals_grand_total", "s IS NULL AND abs(v - t) <= 0.05", {"v": "NULL"}),
    ("line_items_exceed_total_ignored_coherent_triplet", f"{_MORE} AND {_FITS}", {}),
    ("line_items_exceed_total", f"{_MORE} AND NOT {_FITS} AND NOT {_DISCOUNTED}", {}),
    ("discount_before_total", f"{_MORE} AND NOT {_FITS} AND {_DISCOUNTED}", {}),
    ("total_too_small_vs_items", "t < 100 AND i > 200 AND i > t * 4", {"t": "NULL"}),
    ("total_too_small_vs_subtotal", "t < 100 AND s > 500", {"t": "NULL", "s": "NULL", "v": "NULL"}),
]
_AFTER = [
    f"c{n + 1} AS (SELECT o_orderkey, i, {', '.join(f'CASE WHEN {cond} THEN {new.get(c, c)} ELSE {c} END AS {c}' for c in 'tsv')}, CASE WHEN {cond} THEN list_append(r, '{reason}') ELSE r END AS r, "
    f"CASE WHEN {cond} THEN list_append(p, coalesce(floor(({new.get('t', 't')}) * 100 + 0.5)::BIGINT::VARCHAR, '-')) ELSE p END AS p FROM c{n})"
    for n, (reason, cond, new) in enumerate(_STEPS)
]
_TOTALS = f"""
WITH b AS (SELECT o_orderkey, o_orderkey % 16 AS k, o_totalprice AS t, floor(o_totalprice / 1.22::DOUBLE * 100 + 0.5) / 100 AS s, floor((o_totalprice - floor(o_totalprice / 1.22::DOUBLE * 100 + 0.5) / 100) * 100 + 0.5) / 100 AS v FROM orders),
c0 AS (SELECT o_orderkey, CASE k WHEN 11 THEN t * 3 WHEN 12 THEN NULL ELSE s END AS i, CASE k WHEN 1 THEN v WHEN 4 THEN t * 1000 WHEN 13 THEN NULL WHEN 14 THEN 50 ELSE t END AS t,
  CASE WHEN k = 3 THEN -s WHEN k = 6 THEN t * 1.5::DOUBLE WHEN k = 7 THEN t * 1.1::DOUBLE WHEN k = 8 THEN t WHEN k IN (9, 10, 14) THEN NULL ELSE s END AS s,
  CASE k WHEN 2 THEN 22 WHEN 5 THEN 12345678901 WHEN 9 THEN t * 2 WHEN 10 THEN t WHEN 14 THEN 9 WHEN 15 THEN -1 ELSE v END AS v, []::VARCHAR[] AS r, []::VARCHAR[] AS p FROM b),
{', '.join(_AFTER)}
SELECT o_orderkey, floor(t * 100 + 0.5)::BIGINT AS total_cents, floor(s * 100 + 0.5)::BIGINT AS subtotal_cents, floor(v * 100 + 0.5)::BIGINT AS vat_cents, array_to_string(r, ',') AS reasons, array_to_string(p, ',') AS totals_behind, len(r) > 0 AS requires_review FROM c{len(_STEPS)}
"""


def vat_columns(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages, their lines as rows of cells. Of five pages one names its VAT column, one has a misread header, one none, one
    no named column at all, and one has the rates where its discounts stand."""
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 5).alias("k"))
    lines = _t(spark, d, "lineitem").withColumn("page", F.col("l_orderkey"))
    rate = F.element_at(F.array(*[F.lit(x) for x in ("22%", "10 %", "4", "I0%")]), (F.floor(F.col("l_tax") * 100 + 0.5) % 4 + 1).cast("int"))
    row = [
        (F.lit(100.0), F.lit("wood")),
        (400.0 + F.col("l_linenumber") % 3, F.col("l_quantity").cast("int").cast("string")),
        (F.lit(600.0), F.lit("12,50")),
        (800.0 + (F.col("l_partkey") % 9) * 6, rate),
        (F.lit(1000.0), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")),
    ]
    cells = lines.select("page", F.explode(F.array(*[F.struct(x.cast("double").alias("x"), t.alias("text")) for x, t in row])).alias("c")).select("page", "c.x", "c.text", F.lit(False).alias("is_header"))
    heads = orders.filter("k IN (1, 2, 4)").select("page", F.when(F.col("k") == 2, 400.0).otherwise(805.0).alias("x"), F.when(F.col("k") == 1, "lva").when(F.col("k") == 2, "Q.tà").otherwise("scnto").alias("text"), F.lit(True).alias("is_header"))
    named = [("quantity", 401.0, "k <> 3"), ("price", 600.0, "k <> 3"), ("total", 1000.0, "k <> 3"), ("vat", 800.0, "k = 0"), ("discount", 815.0, "k = 4")]
    columns = reduce(DataFrame.unionAll, [orders.filter(where).select("page", F.lit(kind).alias("kind"), F.lit(x).alias("x")) for kind, x, where in named])
    found = R.vat_columns(orders.select("page", F.lit(1400.0).alias("width")), columns, cells.unionAll(heads))
    return found.select("page", F.floor(F.col("x") * 1000 + 0.5).alias("x_thousandths"), "confidence")


_VAT = """
WITH RECURSIVE o AS (SELECT o_orderkey AS page, o_orderkey % 5 AS k FROM orders),
c AS (SELECT l_orderkey AS page, 400.0::DOUBLE + l_linenumber % 3 AS x, CASE WHEN l_quantity::INT IN (4, 5, 10, 19, 20, 21, 22, 23) THEN l_quantity::INT END AS rate FROM lineitem
  UNION ALL SELECT l_orderkey, 800.0::DOUBLE + (l_partkey % 9) * 6, CASE floor(l_tax * 100 + 0.5)::INT % 4 WHEN 0 THEN 22 WHEN 2 THEN 4 ELSE 10 END FROM lineitem),
r AS (SELECT c.page, k, x, rate, row_number() OVER (PARTITION BY c.page ORDER BY x, rate) AS n FROM c JOIN o ON o.page = c.page WHERE rate IS NOT NULL AND k <> 0),
s AS (SELECT page, k, x, rate, n, 0 AS cluster, x AS total, 1 AS held FROM r WHERE n = 1
  UNION ALL
  SELECT r.page, r.k, r.x, r.rate, r.n, CASE WHEN abs(s.total / s.held - r.x) <= 35 THEN s.cluster ELSE s.cluster + 1 END, CASE WHEN abs(s.total / s.held - r.x) <= 35 THEN s.total + r.x ELSE r.x END, CASE WHEN abs(s.total / s.held - r.x) <= 35 THEN s.held + 1 ELSE 1 END
  FROM s JOIN r ON r.page = s.page AND r.n = s.n + 1),
g AS (SELECT page, k, cluster, avg(x) AS x, count(*) AS n, count(DISTINCT rate) AS kinds, max(rate) AS most FROM s GROUP BY page, k, cluster HAVING count(*) >= 2 OR k = 1),
u AS (SELECT *, k = 1 AND abs(x - 805) <= 52.5 AS above FROM g WHERE k = 3 OR (abs(x - 401) > 35 AND abs(x - 600) > 35 AND x > 614 AND (abs(x - 1000) <= 308 OR x > 965) AND NOT (k = 4 AND abs(x - 815) <= 35))),
b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY above DESC, n DESC, x DESC) AS place FROM u),
a AS (
  SELECT page, 800.0::DOUBLE AS x, 'explicit_vat_header' AS confidence FROM o WHERE k = 0
  UNION ALL SELECT page, 805.0::DOUBLE, 'fuzzy_vat_header' FROM o WHERE k = 1 AND page NOT IN (SELECT page FROM g)
  UNION ALL SELECT page, x, CASE WHEN kinds = 1 AND most = 10 AND k <> 4 AND NOT above THEN 'ambiguous_rate_column' WHEN above THEN 'fuzzy_vat_header' WHEN n >= 2 THEN 'repeated_rate_column' ELSE 'ambiguous_rate_column' END FROM b WHERE place = 1)
SELECT page, floor(x * 1000 + 0.5)::BIGINT AS x_thousandths, confidence FROM a
"""

QUERIES = {"repaired_totals": repaired_totals, "vat_columns": vat_columns}
ORACLES = {"repaired_totals": _TOTALS, "vat_columns": _VAT}
