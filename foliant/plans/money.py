"""Queries on amounts: reconciliation, tax recaps, parsing of amounts and dates, label classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import money as M
from foliant.operators import money as O


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    net = M.cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), net.alias("net"), M.cents(F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.col("l_tax")).alias("tax"), "l_tax")


_SQL_LINES = "SELECT l_orderkey AS doc_id, CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS net, CAST(floor(l_extendedprice * (1 - l_discount) * l_tax * 100 + 0.5) AS BIGINT) AS tax, l_tax FROM lineitem"
_CLOSE = "(abs({a} - {b}) <= greatest(0.02, greatest(abs({a}), abs({b})) * 0.00005))"


def close(a: str, b: str) -> str:
    return _CLOSE.format(a=f"({a})", b=f"({b})")


def monetary_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Headers made from the line sums with known errors: every seventh order is a unit off, every fifth a cent."""
    lines = _lines(spark, d)
    sums = lines.groupBy("doc_id").agg(F.sum("net").alias("net"), F.sum("tax").alias("tax"))
    k = F.col("doc_id")
    off = F.when(k % 7 == 0, 100).when(k % 5 == 0, 1).otherwise(0)
    subtotal, vat = (F.col("net") + off) / 100, (F.col("tax") + F.when(k % 11 == 0, 300).otherwise(0)) / 100
    none = F.lit(None).cast("double")
    heads = sums.select("doc_id", subtotal.alias("subtotal"), none.alias("discount_total"), none.alias("shipping"), vat.alias("vat"), ((F.col("net") + off + F.col("tax")) / 100).alias("total"))
    rates = lines.groupBy("doc_id", "l_tax").agg((F.sum("tax") / 100).alias("vat"))
    found = O.reconcile(heads, lines.select("doc_id", (F.col("net") / 100).alias("line_total")), rates)
    return found.select("doc_id", "n_lines", M.cents(F.col("line_sum")).alias("line_cents"), "conflicts", "consistent")


_RECONCILIATION = f"""
WITH l AS ({_SQL_LINES}),
 s AS (SELECT doc_id, sum(net)::BIGINT AS net, sum(tax)::BIGINT AS tax, count(*) AS n FROM l GROUP BY doc_id),
 r AS (SELECT doc_id, count(*) AS nr, sum(v) AS v FROM (SELECT doc_id, l_tax, sum(tax) / 100.0::DOUBLE AS v FROM l GROUP BY ALL) GROUP BY doc_id),
 h AS (SELECT doc_id, n, net, (net + CASE WHEN doc_id % 7 = 0 THEN 100 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) / 100.0::DOUBLE AS subtotal, (tax + CASE WHEN doc_id % 11 = 0 THEN 300 ELSE 0 END) / 100.0::DOUBLE AS vat,
   (net + tax + CASE WHEN doc_id % 7 = 0 THEN 100 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) / 100.0::DOUBLE AS total FROM s),
 c AS (SELECT h.*, concat_ws(',', CASE WHEN NOT {close("net / 100.0::DOUBLE", "subtotal")} THEN 'line_sum_subtotal_mismatch' END, CASE WHEN NOT {close("subtotal + vat", "total")} THEN 'subtotal_vat_total_mismatch' END,
   CASE WHEN r.nr > 1 AND NOT {close("r.v", "vat")} THEN 'tax_summary_vat_mismatch' END) AS conflicts FROM h JOIN r USING (doc_id))
SELECT doc_id, n AS n_lines, net AS line_cents, conflicts, conflicts = '' AS consistent FROM c
"""


def monetary_raw_header(spark: SparkSession, d: str) -> DataFrame:
    """Every order's own total against its lines, orders without lines among them."""
    sums = _lines(spark, d).groupBy("doc_id").agg(F.sum(F.col("net") + F.col("tax")).alias("gross"), F.count("*").alias("n"))
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), M.cents(F.col("o_totalprice")).alias("total_cents"))
    j = orders.join(sums, "doc_id", "left")
    ok = M.close_enough(F.col("gross") / 100, F.col("total_cents") / 100)
    return j.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_lines"), "total_cents", F.col("gross").alias("gross_cents"), F.when(F.col("n").isNull(), "no_lines").when(ok, "match").otherwise("mismatch").alias("verdict"))


_RAW = f"""
WITH s AS (SELECT doc_id, sum(net + tax)::BIGINT AS g, count(*) AS n FROM ({_SQL_LINES}) GROUP BY doc_id), o AS (SELECT o_orderkey AS doc_id, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS t FROM orders)
SELECT o.doc_id, coalesce(n, 0) AS n_lines, t AS total_cents, g AS gross_cents, CASE WHEN n IS NULL THEN 'no_lines' WHEN {close("g / 100.0::DOUBLE", "t / 100.0::DOUBLE")} THEN 'match' ELSE 'mismatch' END AS verdict FROM o LEFT JOIN s USING (doc_id)
"""


def line_consistency(spark: SparkSession, d: str) -> DataFrame:
    l = _t(spark, d, "lineitem")  # noqa: E741
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    gross = F.col("l_quantity") * price
    total = F.when(F.col("l_orderkey") % 3 == 0, gross * (1 - F.col("l_discount"))).when(F.col("l_orderkey") % 3 == 1, gross).otherwise(F.col("l_extendedprice") + F.col("l_linenumber"))
    rows = l.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), price.alias("unit_price"), (F.col("l_discount") * 100).alias("discount"), F.when(F.col("l_linenumber") < 7, total).alias("line_total"))
    return O.check_lines(rows).groupBy("l_linenumber", "consistent").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


_LINE_CONSISTENCY = f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS p, l_discount * 100 AS d, l_discount, l_extendedprice FROM lineitem),
 y AS (SELECT *, q * p AS g, CASE WHEN l_linenumber < 7 THEN CASE WHEN l_orderkey % 3 = 0 THEN q * p * (1 - l_discount) WHEN l_orderkey % 3 = 1 THEN q * p ELSE l_extendedprice + l_linenumber END END AS t FROM x),
 z AS (SELECT l_orderkey, l_linenumber, coalesce({close("CASE WHEN d > 0 AND d < 100 THEN g * (1 - d / 100) ELSE g END", "t")} OR {close("g", "t")}, true) AS consistent FROM y)
SELECT l_linenumber, consistent, count(*) AS n, min(l_orderkey) AS first_order FROM z GROUP BY ALL
"""


def tax_recap_by_rate(spark: SparkSession, d: str) -> DataFrame:
    rate = M.cents(F.col("l_tax")).alias("rate_percent")
    return _lines(spark, d).groupBy(rate).agg(F.count("*").alias("n_lines"), F.sum("net").alias("taxable_cents"), F.sum("tax").alias("vat_cents"))


_RECAP = f"SELECT CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS rate_percent, count(*) AS n_lines, sum(net)::BIGINT AS taxable_cents, sum(tax)::BIGINT AS vat_cents FROM ({_SQL_LINES}) GROUP BY 1"


def arithmetic_totals(spark: SparkSession, d: str) -> DataFrame:
    """Line amounts of an order with, for every other order, a tax of 22 % and a total thrown in."""
    l = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (M.cents(F.col("l_extendedprice")) / 100).alias("value"), "l_linenumber")  # noqa: E741
    one = l.filter((F.col("l_linenumber") == 1) & (F.col("doc_id") % 2 == 0))
    vat = F.floor(F.col("value") * 22 + 0.5) / 100
    extra = one.select("doc_id", F.explode(F.array(vat, F.floor((F.col("value") + vat) * 100 + 0.5) / 100)).alias("value"))
    found = O.arithmetic_totals(l.select("doc_id", "value").unionAll(extra))
    return found.select("doc_id", M.cents(F.col("subtotal")).alias("subtotal_cents"), M.cents(F.col("vat")).alias("vat_cents"), M.cents(F.col("total")).alias("total_cents"))


_TRIPLETS = """
WITH l AS (SELECT l_orderkey AS doc_id, floor(l_extendedprice * 100 + 0.5)::BIGINT / 100.0::DOUBLE AS value, l_linenumber FROM lineitem),
 o AS (SELECT doc_id, value, floor(value * 22 + 0.5) / 100 AS vat FROM l WHERE l_linenumber = 1 AND doc_id % 2 = 0),
 a AS (SELECT doc_id, value FROM l UNION SELECT doc_id, vat FROM o UNION SELECT doc_id, floor((value + vat) * 100 + 0.5) / 100 FROM o),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC) AS k FROM a WHERE value > 0),
 x AS (SELECT t.doc_id, t.value AS total, s.value AS subtotal, floor((t.value - s.value) * 100 + 0.5) / 100 AS vat FROM r t JOIN r s ON t.doc_id = s.doc_id AND t.k <= 24 AND s.k <= 48),
 y AS (SELECT x.* FROM x WHERE vat >= subtotal * 0.03 AND vat <= subtotal * 0.35 AND EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND r.k <= 48 AND abs(r.value - x.vat) <= 0.02)),
 z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, subtotal DESC, vat DESC) AS k FROM y)
SELECT doc_id, floor(subtotal * 100 + 0.5)::BIGINT AS subtotal_cents, floor(vat * 100 + 0.5)::BIGINT AS vat_cents, floor(total * 100 + 0.5)::BIGINT AS total_cents FROM z WHERE k = 1
"""


def amount_parse(spark: SparkSession, d: str) -> DataFrame:
    """Order totals written in seven ways, read back."""
    o = _t(spark, d, "orders").select("o_orderkey", M.cents(F.col("o_totalprice")).alias("c"))
    unit, rest = F.expr("c div 100"), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    head, tail = F.expr("c div 100000").cast("string"), F.lpad(F.expr("(c div 100) % 1000").cast("string"), 3, "0")
    k = F.col("o_orderkey") % 7
    text = (
        F.when(k == 0, F.concat(head, F.lit("."), tail, F.lit(","), rest))
        .when(k == 1, F.concat(F.lit("EUR "), head, F.lit(","), tail, F.lit("."), rest))
        .when(k == 2, F.concat(unit.cast("string"), F.lit(","), rest, F.lit(" €")))
        .when(k == 3, F.concat(F.lit("-"), head, F.lit("'"), tail, F.lit("."), rest))
        .when(k == 4, F.concat(head, F.lit("."), tail))
        .when(k == 5, F.concat(head, F.lit(" "), tail, F.lit(","), rest))
        .otherwise(F.lit("23/05/2025"))
    )
    p = o.select("o_orderkey", text.alias("written")).withColumn("p", M.parse_amount(F.col("written")))
    return p.select("o_orderkey", "written", M.cents(F.col("p.value")).alias("cents"), "p.currency", "p.ambiguous", "p.reason")


_AMOUNTS = """
WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM orders),
 x AS (SELECT *, (c // 100000)::VARCHAR AS h, lpad(((c // 100) % 1000)::VARCHAR, 3, '0') AS t, lpad((c % 100)::VARCHAR, 2, '0') AS r FROM o)
SELECT o_orderkey, CASE k WHEN 0 THEN h || '.' || t || ',' || r WHEN 1 THEN 'EUR ' || h || ',' || t || '.' || r WHEN 2 THEN (c // 100)::VARCHAR || ',' || r || ' €' WHEN 3 THEN '-' || h || '''' || t || '.' || r WHEN 4 THEN h || '.' || t
 WHEN 5 THEN h || ' ' || t || ',' || r ELSE '23/05/2025' END AS written,
 CASE k WHEN 3 THEN -c WHEN 4 THEN c // 100 * 100 WHEN 6 THEN NULL ELSE c END AS cents, CASE WHEN k IN (1, 2) THEN 'EUR' END AS currency, k = 4 AS ambiguous,
 CASE k WHEN 0 THEN 'mixed_separators_last_is_decimal' WHEN 1 THEN 'mixed_separators_last_is_decimal' WHEN 2 THEN 'one_or_two_decimal_digits' WHEN 3 THEN 'one_or_two_decimal_digits' WHEN 4 THEN 'three_digit_group_thousands_separator'
 WHEN 5 THEN 'one_or_two_decimal_digits' ELSE 'calendar_date_not_amount' END AS reason FROM x
"""


def date_parse(spark: SparkSession, d: str) -> DataFrame:
    """Order dates in five notations, half of them with a language."""
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 5
    names = F.array(*[F.lit(x) for x in M.MONTHS["fr"]])
    text = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(k == 2, F.date_format(day, "d.M.yyyy"))
        .when(k == 3, F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(names, F.month(day)), F.year(day).cast("string")))
        .otherwise(F.concat(F.lit("99/99/"), F.year(day).cast("string")))
    )
    lang = F.when(F.col("o_orderkey") % 2 == 0, "de")
    p = _t(spark, d, "orders").select("o_orderkey", text.alias("written"), lang.alias("lang")).withColumn("p", M.parse_date(F.col("written"), F.col("lang")))
    return p.select("o_orderkey", "written", F.col("p.value").alias("day"), F.col("p.ambiguous").alias("ambiguous"), F.array_join("p.alternatives", "|").alias("alternatives"))


_FR = ", ".join(f"'{x}'" for x in M.MONTHS["fr"])
_DATES = f"""
WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'de' END AS lang, CAST(o_orderdate AS DATE) AS y FROM orders),
 x AS (SELECT *, strftime(y, '%Y-%m-%d') AS iso, CASE WHEN day(y) <= 12 THEN strftime(make_date(year(y), day(y), month(y)), '%Y-%m-%d') END AS swapped FROM o)
SELECT o_orderkey, CASE k WHEN 0 THEN iso WHEN 1 THEN strftime(y, '%d/%m/%Y') WHEN 2 THEN day(y) || '.' || month(y) || '.' || year(y) WHEN 3 THEN day(y) || ' ' || [{_FR}][month(y)] || ' ' || year(y) ELSE '99/99/' || year(y) END AS written,
 CASE WHEN k IN (0, 3) THEN iso WHEN k = 4 THEN NULL WHEN swapped IS NULL OR swapped = iso OR lang IS NOT NULL THEN iso END AS day,
 k IN (1, 2) AND swapped IS NOT NULL AND swapped <> iso AS ambiguous,
 CASE WHEN k IN (1, 2) THEN CASE WHEN swapped IS NULL OR swapped = iso THEN iso ELSE iso || '|' || swapped END ELSE '' END AS alternatives FROM x
"""

#: A label and, by hand, what it announces.
_LABELS = [
    ("Totale documento", "grand_total"), ("Subtotal", "net_taxable"), ("IVA 22%", "vat_rate"), ("VAT amount", "vat_amount"), ("Sconto", "unknown"), ("Sconto merce", "discount"), ("Sconto %", "unknown"), ("Shipping costs", "shipping"), ("Prezzi iva esclusa", "net_taxable"),
    ("iva non inclusa", "net_taxable"), ("zzgl. MwSt", "net_taxable"), ("I prezzi si intendono al netto", "net_taxable"), ("Manodopera", "labor"), ("main d'oeuvre", "labor"), ("gross weight", "gross"), ("Total:", "grand_total"), ("Total TTC", "grand_total"),
    ("Imponibile", "net_taxable"), ("Totale imposta", "vat_amount"), ("Totale impegno", "vat_amount"), ("IVA %", "vat_rate"), ("Sconto IVA", "vat_amount"), ("Frais de port", "shipping"), ("Gesamtbetrag", "grand_total"), ("Note", "unknown"),
]


def money_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label classes over line items that carry one of two dozen labels."""
    labels = F.array(*[F.lit(x) for x, _ in _LABELS])
    rows = _t(spark, d, "lineitem").select(F.element_at(labels, (F.col("l_partkey") % len(_LABELS) + 1).cast("int")).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).select("label", M.money_class(F.col("label")).alias("class"), "n")


_LABEL_ROWS = ", ".join("({}, '{}', '{}')".format(i, x.replace("'", "''"), c) for i, (x, c) in enumerate(_LABELS))
_LABEL_SQL = f"WITH w(i, label, class) AS (VALUES {_LABEL_ROWS}) SELECT label, class, count(*) AS n FROM lineitem JOIN w ON w.i = l_partkey % {len(_LABELS)} GROUP BY ALL"


def credit_costs(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("user_id") % 3 == 0, "business_card_ai").when(F.col("user_id") % 3 == 1, "pdf_page_ai").otherwise("document_page_ai")
    cost = M.credits(kinds, (F.floor("value") % 130).cast("int"))
    return _t(spark, d, "events").select(kinds.alias("operation"), cost.alias("c")).groupBy("operation").agg(F.count("*").alias("n"), F.sum("c").alias("credits"), F.max("c").cast("bigint").alias("most"))


_CREDITS = """
WITH e AS (SELECT CASE user_id % 3 WHEN 0 THEN 'business_card_ai' WHEN 1 THEN 'pdf_page_ai' ELSE 'document_page_ai' END AS operation, floor(value)::BIGINT % 130 AS p FROM events),
 c AS (SELECT operation, CASE WHEN operation = 'business_card_ai' THEN 1 ELSE least(100, greatest(1, p)) END AS c FROM e)
SELECT operation, count(*) AS n, sum(c)::BIGINT AS credits, max(c)::BIGINT AS most FROM c GROUP BY operation
"""

QUERIES = {f.__name__: f for f in (monetary_reconciliation, monetary_raw_header, line_consistency, tax_recap_by_rate, arithmetic_totals, amount_parse, date_parse, money_labels, credit_costs)}
ORACLES = {
    "monetary_reconciliation": _RECONCILIATION, "monetary_raw_header": _RAW, "line_consistency": _LINE_CONSISTENCY, "tax_recap_by_rate": _RECAP, "arithmetic_totals": _TRIPLETS,
    "amount_parse": _AMOUNTS, "date_parse": _DATES, "money_labels": _LABEL_SQL, "credit_costs": _CREDITS,
}
