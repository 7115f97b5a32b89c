"""Queries on cells that are written from the values of the tables, read row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import documents as K
from foliant.functions import fields as C
from foliant.functions.checks import VAT_RATES, vat_rate
from foliant.plans.money import _t

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def _cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("bigint")


def amounts_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Prices of line items as text, in eight styles."""
    cents = _cents(F.col("l_extendedprice"))
    whole, part = F.expr("floor(l_extendedprice * 100 + 0.5) div 100"), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped, bare = F.format_number(whole, 0), whole.cast("string")
    styles = [
        F.concat(bare, F.lit(","), part), F.concat(F.translate(grouped, ",", "."), F.lit(","), part), F.concat(grouped, F.lit("."), part), F.concat(F.translate(grouped, ",", " "), F.lit(","), part),
        F.concat(F.lit("EUR "), bare, F.lit("."), part), F.concat(bare, F.lit("."), part, F.lit(" €")), F.concat(F.lit("-"), bare, F.lit(","), part), F.concat(bare, F.lit(","), part, F.lit("0")),
    ]
    rows = _t(spark, d, "lineitem").select(*KEY, F.element_at(F.array(*styles), (F.col("l_partkey") % 8 + 1).cast("int")).alias("text"))
    return rows.select(*KEY, "text", _cents(C.strict_amount(F.col("text"))).alias("cents"), C.checked_amount(F.col("text"))["status"].alias("status"))


_AMOUNTS = """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 8 AS s, floor(l_extendedprice * 100 + 0.5)::BIGINT AS c FROM lineitem),
p AS (SELECT *, (c // 100)::VARCHAR AS bare, lpad((c % 100)::VARCHAR, 2, '0') AS part, format('{:,}', c // 100) AS grouped FROM l)
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE s WHEN 0 THEN bare || ',' || part WHEN 1 THEN replace(grouped, ',', '.') || ',' || part WHEN 2 THEN grouped || '.' || part WHEN 3 THEN replace(grouped, ',', ' ') || ',' || part WHEN 4 THEN 'EUR ' || bare || '.' || part WHEN 5 THEN bare || '.' || part || ' €' WHEN 6 THEN '-' || bare || ',' || part ELSE bare || ',' || part || '0' END AS text,
  CASE WHEN s < 6 THEN c WHEN s = 6 THEN -c WHEN c < 100000 THEN c * 1000 END AS cents, CASE WHEN s < 6 OR (s = 7 AND c < 100000) OR c = 0 THEN 'valid' ELSE 'invalid' END AS status FROM p
"""


def quantities_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Quantities as text, with and without units."""
    q = F.col("l_quantity").cast("int").cast("string")
    styles = [F.concat(q, F.lit(" pz")), q, F.concat(q, F.lit(",5 kg")), F.concat(q, F.lit(".25")), F.concat(F.lit("pz "), q), F.concat(F.lit("-"), q), F.concat(q, F.lit("000"))]
    rows = _t(spark, d, "lineitem").select(*KEY, F.element_at(F.array(*styles), (F.col("l_partkey") % 7 + 1).cast("int")).alias("text"))
    return rows.select(*KEY, "text", _cents(C.quantity_cell(F.col("text"))).alias("hundredths"))


_QUANTITIES = """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 7 AS s, l_quantity::INT AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE s WHEN 0 THEN q || ' pz' WHEN 1 THEN q::VARCHAR WHEN 2 THEN q || ',5 kg' WHEN 3 THEN q || '.25' WHEN 4 THEN 'pz ' || q WHEN 5 THEN '-' || q ELSE q || '000' END AS text,
  CASE WHEN s < 2 THEN q * 100 WHEN s = 2 THEN q * 100 + 50 WHEN s = 3 THEN q * 100 + 25 WHEN s = 6 AND q <= 10 THEN q * 100000 END::BIGINT AS hundredths FROM l
"""


def days_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Days of shipping as text; every second line's day is confirmed."""
    at = F.to_date("l_shipdate")
    text = F.element_at(F.array(*[F.date_format(at, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "d.M.yyyy", "dd/MM/yy")], F.concat(F.date_format(at, "yyyy-MM-"), F.lit("32"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = _t(spark, d, "lineitem").select(*KEY, text.alias("text"), (F.col("l_linenumber") % 2 == 0).alias("confirmed"))
    found = rows.withColumn("x", K.strict_day(F.col("text"), F.col("confirmed")))
    return found.select(*KEY, "text", "confirmed", F.col("x.value").alias("day"), F.col("x.status").alias("status"), F.col("x.reason").alias("reason"))


_DAYS = """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 5 AS s, l_shipdate AS t, l_linenumber % 2 = 0 AS confirmed, day(l_shipdate) AS d, month(l_shipdate) AS m FROM lineitem),
c AS (SELECT *, s IN (1, 2) AND d <= 12 AND d <> m AS open FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, CASE s WHEN 0 THEN strftime(t, '%Y-%m-%d') WHEN 1 THEN strftime(t, '%d/%m/%Y') WHEN 2 THEN d || '.' || m || '.' || year(t) WHEN 3 THEN strftime(t, '%d/%m/%y') ELSE strftime(t, '%Y-%m-') || '32' END AS text, confirmed,
  CASE WHEN s < 3 THEN strftime(t, '%Y-%m-%d') END AS day, CASE WHEN s > 2 THEN 'invalid' WHEN open AND NOT confirmed THEN 'ambiguous' ELSE 'valid' END AS status,
  CASE s WHEN 3 THEN 'invalid_date_format' WHEN 4 THEN 'invalid_calendar_date' ELSE CASE WHEN open THEN CASE WHEN confirmed THEN 'user_confirmed_day_month' ELSE 'ambiguous_day_month' END ELSE 'valid_calendar_date' END END AS reason FROM c
"""


def rates_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Quantities written as rates of VAT."""
    q = F.col("l_quantity").cast("int").cast("string")
    styles = [F.concat(q, F.lit("%")), q, F.concat(q, F.lit(",00 %")), F.concat(q, F.lit(",00")), F.concat(q, F.lit(" EUR"))]
    rows = _t(spark, d, "lineitem").select(*KEY, F.element_at(F.array(*styles), (F.col("l_partkey") % 5 + 1).cast("int")).alias("text"))
    return rows.select(*KEY, "text", vat_rate(F.col("text")).cast("bigint").alias("rate"))


_RATES = f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 5 AS s, l_quantity::BIGINT AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE s WHEN 0 THEN q || '%' WHEN 1 THEN q::VARCHAR WHEN 2 THEN q || ',00 %' WHEN 3 THEN q || ',00' ELSE q || ' EUR' END AS text,
  CASE WHEN q IN ({', '.join(map(str, VAT_RATES))}) AND (s < 3 OR (s = 3 AND q BETWEEN 19 AND 23)) THEN q END AS rate FROM l
"""


def provinces_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of parts and suppliers as postal codes."""
    code = F.lpad((F.col("l_partkey") * 7919 % 100000 + F.col("l_suppkey")).cast("string"), 5, "0")
    rows = _t(spark, d, "lineitem").select(*KEY, "l_suppkey", F.when(F.col("l_linenumber") == 1, F.concat(F.left(code, F.lit(2)), F.lit(" "), F.substr(code, F.lit(3)))).otherwise(code).alias("code"))
    return rows.select(*KEY, "l_suppkey", "code", C.province(F.col("code")).alias("province"))


_PROVINCES = f"""
WITH p(digits, province) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in C.PROVINCES.items())}),
l AS (SELECT *, lpad((l_partkey * 7919 % 100000 + l_suppkey)::VARCHAR, 5, '0') AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN left(left(c, 5), 2) || ' ' || substr(left(c, 5), 3) ELSE left(c, 5) END AS code, province FROM l LEFT JOIN p ON digits = left(c, 2)
"""

QUERIES = {f.__name__: f for f in (amounts_of_lines, quantities_of_lines, days_of_lines, rates_of_lines, provinces_of_parts)}
ORACLES = {"amounts_of_lines": _AMOUNTS, "quantities_of_lines": _QUANTITIES, "days_of_lines": _DAYS, "rates_of_lines": _RATES, "provinces_of_parts": _PROVINCES}
