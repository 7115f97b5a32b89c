"""Queries on checks of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import checks as C
from foliant.plans.money import _t


def total_checks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as totals: of five, one has no VAT, one a VAT that fits, one that does not, one equal to the total, one none at all."""
    k, total = F.col("o_orderkey") % 5, F.col("o_totalprice")
    subtotal = F.when(k < 2, total).when(k < 4, total - 100)
    vat = F.when(k.isin(0, 2), F.lit(100.0)).when(k == 1, F.lit(0.0)).when(k == 3, total)
    rows = _t(spark, d, "orders").select("o_orderkey", total.alias("total"), subtotal.alias("subtotal"), vat.alias("vat"))
    c = rows.withColumn("c", C.checked_vat(F.col("vat"), F.col("subtotal"), F.col("total")))
    above = C.total_above(F.array(F.col("total"), F.lit(1.0), F.col("subtotal")), F.col("subtotal"))
    return c.select("o_orderkey", F.col("c.vat").isNotNull().alias("kept"), F.col("c.rejected").alias("rejected"), C.vat_cannot_be_total(F.col("vat"), F.col("total")).alias("not_total"), C.total_lacks_vat(F.col("subtotal"), F.col("vat"), F.col("total")).alias("lacks_vat"), above.isNotNull().alias("above"))


_TOTALS = """
SELECT o_orderkey, o_orderkey % 5 IN (1, 2) AS kept, CASE o_orderkey % 5 WHEN 0 THEN 'vat_conflicts_with_zero_vat_totals' WHEN 3 THEN 'vat_breaks_existing_totals' END AS rejected,
 o_orderkey % 5 = 3 OR (o_orderkey % 5 IN (0, 2) AND o_totalprice <= 100.05) AS not_total, o_orderkey % 5 = 0 AS lacks_vat, o_orderkey % 5 IN (2, 3) AND o_totalprice > 100.05 AS above FROM orders
"""

#: A cell and, by hand, its VAT rate and its discount.
_CELLS = [
    ("22%", 22.0, 22.0), ("I0 %", 10.0, None), ("10,00", None, None), ("22,00", 22.0, None), ("122", 22.0, None), ("7%", None, 7.0), ("4", 4.0, 4.0), ("12,5%", None, 12.5), ("10,009%", None, 10.0), ("99%", None, None), ("5o%", None, 5.0), ("", None, None), ("abc", None, None), ("l0%", 10.0, None), ("19,00 %", 19.0, 19.0), ("85", None, None),
]


def rate_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of rate columns over the line items."""
    cells = F.array(*[F.lit(x) for x, *_ in _CELLS])
    rows = _t(spark, d, "lineitem").select(F.element_at(cells, (F.col("l_partkey") % len(_CELLS) + 1).cast("int")).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return rows.select("cell", C.vat_rate(F.col("cell")).alias("vat"), C.discount_rate(F.col("cell")).alias("discount"), "n")


_number = lambda x: "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"
_CELL_ROWS = ", ".join(f"({i}, '{x}', {_number(v)}, {_number(p)})" for i, (x, v, p) in enumerate(_CELLS))
_RATES = f"WITH w(i, cell, vat, discount) AS (VALUES {_CELL_ROWS}) SELECT cell, vat, discount, count(*) AS n FROM lineitem JOIN w ON w.i = l_partkey % {len(_CELLS)} GROUP BY ALL"


def text_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Title case, capitals, words and labels of the parts' names and types."""
    text = F.concat(F.col("p_name"), F.lit("  d'été-à  "), F.col("p_type"))
    p = _t(spark, d, "part").select("p_partkey", text.alias("t"), "p_type")
    return p.select("p_partkey", C.title_case(F.col("t")).alias("title"), C.is_all_caps(F.col("p_type")).alias("caps"), C.is_all_caps(F.col("t")).alias("mixed"), F.size(C.tokens(F.col("t"))).alias("n"), C.label_key(F.col("t")).alias("label"), C.has_label(C.label_key(F.col("t")), F.lit("ring d ete")).alias("ring"), C.has_label(C.label_key(F.col("t")), F.lit("ring d et")).alias("never"))


_SHAPES = """
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_type AS t, p_name AS n FROM part)
SELECT p_partkey, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' D''été-À ' || upper(t[1]) || lower(t[2:]) AS title, true AS caps, false AS mixed, (len(w) + 2)::INT AS n, lower(n) || ' d ete a ' || lower(t) AS label, ends_with(n, ' ring') AS ring, false AS never FROM p
"""


def country_hints(spark: SparkSession, d: str) -> DataFrame:
    places = F.array(*[F.lit(x) for x in ("Roma, Italia", "Sialkot Pakistan", "Bruxelles, BELGIQUE", "France / Germany", "Italian", "")])
    return _t(spark, d, "customer").select("c_custkey", F.array_join(C.country_hints(F.element_at(places, (F.col("c_custkey") % 6 + 1).cast("int"))), ",").alias("hints"))


_HINTS = "SELECT c_custkey, ['IT', 'PK', 'BE', 'DE,FR', '', ''][c_custkey % 6 + 1] AS hints FROM customer"


def phone_lists(spark: SparkSession, d: str) -> DataFrame:
    """Four spellings of a customer's number: two are one number, one is too short, one is blank."""
    k = F.col("c_custkey").cast("string")
    n = F.array(F.concat(F.lit("+39 02 1000"), k), F.concat(F.lit("39/021000"), k), k, F.lit(" - "))
    return _t(spark, d, "customer").select("c_custkey", F.array_join(C.distinct_phones(n), ",").alias("phones"))


_PHONES = "SELECT c_custkey, CASE WHEN length('39021000' || c_custkey) >= 9 THEN '+39021000' || c_custkey END || ',' || c_custkey AS phones FROM customer"


def line_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Line items as boxes beside a box at 20 to 40 both ways."""
    x, y = F.col("l_quantity"), F.col("l_linenumber") * 8
    gap, share = C.vertical_gap(y, y + 6, F.lit(20), F.lit(40)), C.horizontal_overlap(x, x + 10, F.lit(20.0), F.lit(40.0))
    return _t(spark, d, "lineitem").groupBy("l_quantity", "l_linenumber").agg(F.count("*").alias("n")).select("l_quantity", "l_linenumber", gap.cast("bigint").alias("gap"), (share * 10).cast("bigint").alias("tenths"), "n")


_GEOMETRY = "SELECT l_quantity, l_linenumber, greatest(20 - (l_linenumber * 8 + 6), l_linenumber * 8 - 40, 0)::BIGINT AS gap, greatest(0, least(l_quantity + 10, 40) - greatest(l_quantity, 20))::BIGINT AS tenths, count(*) AS n FROM lineitem GROUP BY ALL"


def median_price(spark: SparkSession, d: str) -> DataFrame:
    """Exact medians; an even number of rows has the mean of the middle two."""
    return _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg((F.floor(F.median("l_quantity") * 2 + 0.5)).cast("bigint").alias("twice_median"))


_MEDIAN = "SELECT l_returnflag, l_linestatus, floor(median(l_quantity) * 2 + 0.5)::BIGINT AS twice_median FROM lineitem GROUP BY ALL"


def page_fields(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages with fields, one of them blank and one with spaces around."""
    c = _t(spark, d, "conversations")
    fields = F.map_from_arrays(F.array(F.lit(" role "), F.lit("blank"), F.lit("chars")), F.array(F.concat(F.lit(" "), F.col("role")), F.lit("  "), F.length("text").cast("string")))
    return c.filter("role IS NOT NULL AND text IS NOT NULL").select("conv_id", "turn", F.to_json(C.page_fields(fields, F.col("turn"))).alias("fields"))


_FIELDS = """SELECT conv_id, turn, '{"page_' || turn + 1 || '_role":"' || role || '","page_' || turn + 1 || '_chars":"' || length(text) || '"}' AS fields FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL"""


def shipped_same_day(spark: SparkSession, d: str) -> DataFrame:
    l = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    return l.groupBy("l_linenumber").agg(F.count_if(C.same_day(F.col("l_shipdate"), F.col("o_orderdate"))).alias("n_same"), F.count("*").alias("n"))


_SAME_DAY = "SELECT l_linenumber, count(*) FILTER (l_shipdate::DATE = o_orderdate::DATE) AS n_same, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"

QUERIES = {f.__name__: f for f in (total_checks, rate_cells, text_shapes, country_hints, phone_lists, line_geometry, median_price, page_fields, shipped_same_day)}
ORACLES = {"total_checks": _TOTALS, "rate_cells": _RATES, "text_shapes": _SHAPES, "country_hints": _HINTS, "phone_lists": _PHONES, "line_geometry": _GEOMETRY, "median_price": _MEDIAN, "page_fields": _FIELDS, "shipped_same_day": _SAME_DAY}
