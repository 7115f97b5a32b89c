"""Queries on single fields and on rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import fields as C
from foliant.operators import exports as X
from foliant.operators import ordered as O
from foliant.operators.merging import decision_counts
from foliant.plans.money import _t


def _dealt(spark: SparkSession, d: str, values: list[tuple], **types: str) -> DataFrame:
    """The line items with one row of ``values`` each, counted: columns named and typed as said, and n."""
    rows = F.array(*[F.struct(*[F.lit(x).cast(t).alias(c) for x, (c, t) in zip(v, types.items(), strict=False)]) for v in values])
    given = _t(spark, d, "lineitem").select(F.element_at(rows, (F.col("l_partkey") % len(values) + 1).cast("int")).alias("x"))
    return given.groupBy("x").agg(F.count("*").alias("n")).select("x.*", "n")


def _sql(x: object) -> str:
    if x is None or isinstance(x, bool):
        return "NULL" if x is None else str(x).lower()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _expected(values: list[tuple], **types: str) -> str:
    """What ``_dealt`` and a query's results come to, from the values that were worked out by hand."""
    rows = ", ".join(f"({i}, {', '.join(f'{_sql(x)}::{t}' for x, t in zip(v, types.values(), strict=True))})" for i, v in enumerate(values))
    return f"WITH w(i, {', '.join(types)}) AS (VALUES {rows}) SELECT {', '.join(types)}, count(*) AS n FROM lineitem JOIN w ON w.i = l_partkey % {len(values)} GROUP BY ALL"


def _hundredths(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


#: By hand: a cell, its amount in cents, status and reason.
_AMOUNTS = [
    ("1.234,50 €", 123450, "valid", "valid_amount"), ("EUR 12", 1200, "valid", "valid_amount"), ("1,234.5", 123450, "valid", "valid_amount"), ("-3,00", None, "invalid", "invalid_amount"), ("1 234 567,89", 123456789, "valid", "valid_amount"), ("12 34", None, "invalid", "invalid_amount_format"),
    ("1.23.4", None, "invalid", "invalid_amount_format"), ("  ", None, "missing", "missing_value"), (None, None, "missing", "missing_value"), ("n/a", None, "missing", "missing_value"), ("1.234", 123400, "valid", "valid_amount"), ("$+7.5", 750, "valid", "valid_amount"), ("12,345,678.90 USD", 1234567890, "valid", "valid_amount"), ("3 kg", None, "invalid", "invalid_amount_format"),
    ("1'000", 100000, "valid", "valid_amount"), ("5-6", None, "invalid", "invalid_amount_format"),
]


def strict_amounts(spark: SparkSession, d: str) -> DataFrame:
    rows = _dealt(spark, d, _AMOUNTS, cell="string").withColumn("c", C.checked_amount(F.col("cell")))
    return rows.select("cell", _hundredths(F.col("c.value")).alias("cents"), F.col("c.status").alias("status"), F.col("c.reason").alias("reason"), "n")


#: By hand: a cell and its quantity in hundredths.
_QUANTITIES = [("3 pz", 300), ("2,5kg", 250), ("12", 1200), ("-1", None), ("0", None), ("10001", None), ("10000", 1000000), ("12 x 4", None), ("7 n.r.", 700), ("pz 3", None), ("", None), ("1.250", 125), (" 4 MQ ", 400), ("5 metri", None)]


def quantity_cells(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d, _QUANTITIES, cell="string").select("cell", _hundredths(C.quantity_cell(F.col("cell"))).alias("quantity"), "n")


#: By hand: a cell, how it was read, price, quantity and the total in cents that stands.
_TOTALS = [
    ("1.234", 1234.0, 1.2, 1.0, 123), ("1.234", 1234.0, 1.2, None, 123), ("1.234", 1234.0, 1.2, 3.0, None), ("1.234", 1234.0, 100.0, 12.0, 123400), ("1.234,00", 1234.0, 1.2, 1.0, 123400),
    ("99.500", 99500.0, 9.95, 10.0, 9950), ("99.500", 99500.0, 9.95, None, None), ("1.234", 1234.0, None, 2.0, 123400), ("€ 1.234", 1234.0, 1.2, 1.0, 123400), ("abc", None, 1.2, 1.0, None), ("12.345", 12345.0, 200.0, None, 1234), ("12.345", 12345.0, 300.0, None, 1234500),
]


def line_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _dealt(spark, d, _TOTALS, cell="string", read="double", price="double", quantity="double")
    return rows.select("cell", "read", "price", "quantity", _hundredths(C.line_total(F.col("cell"), F.col("read"), F.col("price"), F.col("quantity"))).alias("total"), "n")


#: By hand: a damaged day and the day.
_DAYS = [("27IO3/2026", "27/03/2026"), ("27/03/2026", "27/03/2026"), ("1l2/26", "01/02/2026"), ("1/2/26", "01/02/2026"), ("5o11v2024", "05/11/2024"), ("32/01/2024", None), ("12/13/2024", None), ("12/12/1989", None), ("1 2/1 2/2 0 2 4", "12/12/2024"), ("abc", None), (None, None)]


def repaired_days(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d, _DAYS, cell="string").select("cell", C.repaired_day(F.col("cell")).alias("day"), "n")


#: By hand: a postal code, a country, their codes.
_PLACES = [("20100", "Italia", "MI", "IT"), ("00 187", "österreich", "RM", "AT"), ("2010", "U.K.", None, None), ("99999", "great-britain", None, "GB"), (None, "España", None, "ES"), ("41012", "it", "BO", "IT"), ("abcde", None, None, None), ("34100", "Costa  Rica", "GO", "CR"), ("10121", "Atlantis", "TO", None)]


def place_codes(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d, _PLACES, cap="string", country="string").select("cap", "country", C.province(F.col("cap")).alias("province"), C.country_code(F.col("country")).alias("code"), "n")


#: By hand: an address, its country, whether it is in Italy.
_ADDRESSES = [("Via Roma 1, Berlin, Germany", None, False), ("Via Roma 1", None, True), ("Main Street 5 (MI)", None, True), ("Main Street 5", None, False), ("Via Roma 1", "DE", False), ("Via Roma 1", "it", True), ("Rome, ITALY", "FR", True), ("", None, False), (None, None, False), ("Località Pian 3", "", True)]


def italian_addresses(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d, _ADDRESSES, address="string", country="string").select("address", "country", C.is_italian_address(F.col("address"), F.col("country")).alias("italian"), "n")


#: By hand: two readings of a line, the address that stands, whether it is the second one's.
_READINGS = [
    ("a.b@acme.it", "a.b@acne.it", "a.b@acne.it", True), ("a.b@acme.it", "c.b@acne.it", "a.b@acme.it", False), ("a.b@acme.it", "a.b@acxx.it", "a.b@acme.it", False), ("a.b@acme.com", "ab@acme.com.br", "ab@acme.com.br", True), ("x@y.it", "", "x@y.it", False), ("tel 12", "Mail: X @ y . it", "x@y.it", True),
    ("x@y.it", "X@Y.IT", "x@y.it", False), ("", "", None, False), ("a@acme.it", "a@acme.com", "a@acme.it", False),
]


def focused_emails(spark: SparkSession, d: str) -> DataFrame:
    rows = _dealt(spark, d, _READINGS, observed="string", focused="string").withColumn("c", C.focused_email(F.col("observed"), F.col("focused")))
    return rows.select("observed", "focused", "c.selected", "c.changed", "n")


def stored_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of orders stored as days, as instants and as neither."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return _t(spark, d, "orders").select("o_orderkey", C.day_only(text).alias("day"), C.stored_day(text).cast("string").alias("stored"))


_STORED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS stored FROM orders"


def export_times(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.col("event_id") % 4 > 0, F.col("ts"))
    return _t(spark, d, "events").select("event_id", X.time_text(at, "en").alias("en"), X.time_text(at, "it").alias("it"))


_TIMES = "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN strftime(ts, '%m/%d/%Y %H:%M') ELSE '' END AS en, CASE WHEN event_id % 4 > 0 THEN strftime(ts, '%d/%m/%Y %H:%M') ELSE '' END AS it FROM events"


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit(" \t a|b\r\n  c\n\n\n\nd  "), F.col("c_name"), F.lit("\r\r\r"))
    return _t(spark, d, "customer").select("c_custkey", C.clean_text(text).alias("text"))


_CLEAN = "SELECT c_custkey, 'aIb' || chr(10) || chr(10) || 'c' || chr(10) || chr(10) || 'd ' || c_name AS text FROM customer"


def role_bonuses(spark: SparkSession, d: str) -> DataFrame:
    name, role = F.when(F.col("l_partkey") % 9 > 0, F.col("l_partkey") % 5 - 1), F.col("l_linenumber")
    rows = _t(spark, d, "lineitem").select(name.alias("name"), role.alias("role")).groupBy("name", "role").agg(F.count("*").alias("n"))
    return rows.select("name", "role", _hundredths(C.role_bonus(F.col("name"), F.col("role"))).alias("bonus"), "n")


_BONUS = "SELECT CASE WHEN l_partkey % 9 > 0 THEN l_partkey % 5 - 1 END AS name, l_linenumber AS role, CASE WHEN name < 0 OR name IS NULL THEN 0 ELSE CASE l_linenumber - name WHEN 1 THEN 35 WHEN 2 THEN 27 WHEN 3 THEN 19 ELSE 0 END END::BIGINT AS bonus, count(*) AS n FROM lineitem GROUP BY ALL"


def top_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Eight contributions of each line item; equal sizes keep their order."""
    parts = F.array(*[F.struct(F.lit(f"r{i}").alias("name"), (F.col("l_partkey") * (i + 3) % 11 - 5).alias("value")) for i in range(8)])
    rows = _t(spark, d, "lineitem").select((F.col("l_partkey") % 11).alias("k"), F.array_join(C.top_reasons(parts), " ").alias("reasons"))
    return rows.groupBy("k", "reasons").agg(F.count("*").alias("n"))


_REASONS = """
WITH k AS (SELECT l_partkey % 11 AS k, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT k, n, i, row_number() OVER (PARTITION BY k ORDER BY abs(k * (i + 3) % 11 - 5) DESC, i) AS place FROM k, range(8) r(i))
SELECT k, string_agg('r' || i, ' ' ORDER BY place) AS reasons, n FROM x WHERE place <= 6 GROUP BY k, n
"""


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of 1 to 130 lines for each customer."""
    return _t(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), (F.col("c_custkey") % 130 + 1).cast("int"))).alias("line"))


def scan_order(spark: SparkSession, d: str) -> DataFrame:
    return O.scan_order(_sheets(spark, d), "c_custkey", "line")


_SCAN = """
WITH s AS (SELECT c_custkey, unnest(range(1, c_custkey % 130 + 2))::INT AS line, least(c_custkey % 130 + 1, 80) AS most FROM customer)
SELECT c_custkey, line, CASE WHEN line <= 24 THEN line WHEN line > most - 16 THEN greatest(24, 24 + line - greatest(24, most - 16) ) ELSE line + least(16, most - 24) END::INT AS scan FROM s WHERE line <= most
"""


def clamped_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = O.clamp_lines(_sheets(spark, d).withColumn("text", F.expr("repeat('xyz', line)")), "c_custkey", "text", "line")
    return lines.groupBy("c_custkey").agg(F.max("line").alias("lines"), F.sum(F.length("text")).alias("chars"))


_CLAMP = "WITH s AS (SELECT c_custkey, unnest(range(1, c_custkey % 130 + 2))::INT AS line FROM customer) SELECT c_custkey, max(line) AS lines, sum(least(180, 3 * line))::BIGINT AS chars FROM s WHERE line <= 120 GROUP BY 1"


def page_places(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as pages in one total order."""
    return O.page_order(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"), "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey").select("o_custkey", "o_orderkey", "place")


_PAGES = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, o_orderkey)::INT AS place FROM orders"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents with one row for each line number: doc, n, p."""
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.max("l_partkey").alias("p"))


_ITEMS = "SELECT l_orderkey AS doc, l_linenumber AS n, max(l_partkey) AS p FROM lineitem GROUP BY ALL"


def block_places(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    blocks = _items(spark, d).select("doc", F.col("n").alias("id"), (p % 2).alias("page"), (p % 40).cast("double").alias("y"), (p % 7).cast("double").alias("x"))
    return O.block_order(blocks, "doc").select("doc", "id", "place")


_BLOCKS = f"WITH i AS ({_ITEMS}) SELECT doc, n AS id, row_number() OVER (PARTITION BY doc ORDER BY p % 2, p % 40 // 6, p % 7, p % 40, n)::INT AS place FROM i"


def repeated_shipping(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    description = F.when(p % 3 == 0, F.concat(F.lit("part "), p.cast("string"))).when(p % 2 == 0, "Trasporto").otherwise("shipping costs")
    total = F.when(p % 4 > 0, F.floor(p / 3) % 3 * F.lit(0.04))
    items = _items(spark, d).select("doc", "n", description.alias("description"), total.cast("double").alias("total"))
    return O.drop_repeated_shipping(items, ["doc"], "n").select("doc", "n", "description", _hundredths(F.col("total")).alias("cents"))


_SHIPPING = f"""
WITH RECURSIVE l AS ({_ITEMS}),
 i AS (SELECT doc, n, row_number() OVER (PARTITION BY doc ORDER BY n) AS k, p % 3 > 0 AS ship, CASE WHEN p % 3 = 0 THEN 'part ' || p WHEN p % 2 = 0 THEN 'Trasporto' ELSE 'shipping costs' END AS description, CASE WHEN p % 4 > 0 THEN p // 3 % 3 * 4 END AS cents FROM l),
 x AS (SELECT doc, k, {{'n': n, 'ship': ship, 'description': description, 'cents': cents}} AS row FROM i),
 r(doc, k, kept) AS (
   SELECT doc, k, [row] FROM x WHERE k = 1
   UNION ALL
   SELECT r.doc, x.k, CASE WHEN NOT (kept[-1].ship AND row.ship AND (row.cents IS NULL OR kept[-1].cents IS NULL OR abs(row.cents - kept[-1].cents) <= 5)) THEN list_append(kept, row)
     WHEN kept[-1].cents IS NULL AND row.cents IS NOT NULL THEN list_append(list_slice(kept, 1, len(kept) - 1), row) ELSE kept END
   FROM r JOIN x ON x.doc = r.doc AND x.k = r.k + 1),
 e AS (SELECT doc, unnest(arg_max(kept, k)) AS row FROM r GROUP BY doc)
SELECT doc, row.n AS n, row.description AS description, row.cents::BIGINT AS cents FROM e
"""


def continued_lines(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    text = F.when(p % 3 > 0, F.concat(F.lit(" e  figli "), p.cast("string"))).otherwise(F.concat(F.lit("Rossi "), p.cast("string")))
    lines = _items(spark, d).select("doc", "n", text.alias("text"), (p % 7 == 0).alias("role"))
    return O.join_continued(lines, ["doc"], "n", "text", F.col("role")).select("doc", "n", "text")


_CONTINUED = f"""
WITH RECURSIVE l AS ({_ITEMS}),
 i AS (SELECT doc, n, row_number() OVER (PARTITION BY doc ORDER BY n) AS k, p % 3 > 0 AS e, p % 7 = 0 AS role, CASE WHEN p % 3 > 0 THEN 'e figli ' ELSE 'Rossi ' END || p AS text FROM l),
 r(doc, k, n, role, text, gone) AS (
   SELECT doc, k, n, role, text, false FROM i WHERE k = 1
   UNION ALL
   SELECT i.doc, i.k, i.n, i.role, i.text, i.e AND NOT r.gone AND NOT r.role FROM r JOIN i ON i.doc = r.doc AND i.k = r.k + 1),
 x AS (SELECT doc, n, gone, text || CASE WHEN lead(gone) OVER w THEN ' ' || lead(text) OVER w ELSE '' END AS text FROM r WINDOW w AS (PARTITION BY doc ORDER BY k))
SELECT doc, n, text FROM x WHERE NOT gone
"""


def date_role_days(spark: SparkSession, d: str) -> DataFrame:
    """Customers as documents with a line for each order."""
    k = F.col("o_orderkey")
    label = F.element_at(F.array(*[F.lit(x) for x in ("Data ordine", "Data fattura", "Scadenza", "Valido fino al", "Data consegna", "Rif.")]), (k % 6 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("order"), F.lit("invoice"), F.lit("letter")), (F.col("o_custkey") % 3 + 1).cast("int"))
    lines = _t(spark, d, "orders").select("o_custkey", (k % 2).alias("page"), (k % 50).alias("y"), F.lit(0).alias("x"), k.alias("id"), F.concat(label, F.lit(" "), F.date_format("o_orderdate", "dd/MM/yyyy")).alias("text"), kind.alias("kind"))
    return O.date_roles(lines, "o_custkey", "text", "kind")


_ROLES = """
WITH l AS (SELECT o_custkey, o_orderkey % 6 AS r, o_orderkey % 2 AS page, o_orderkey % 50 AS y, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, (o_custkey % 3 = 0) = (o_orderkey % 6 = 0) AS wanted FROM orders WHERE o_orderkey % 6 < 4),
 b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, greatest(r, 1) ORDER BY NOT wanted, page, y, id) AS place FROM l)
SELECT o_custkey, max(day) FILTER (r < 2) AS issue, max(day) FILTER (r = 3) AS validity, max(day) FILTER (r = 2) AS due FROM b WHERE place = 1 GROUP BY 1
"""


def released_leases(spark: SparkSession, d: str) -> DataFrame:
    """Every third event as a lease, and events that give some of them back, once or twice."""
    e, k = _t(spark, d, "events"), F.col("event_id")
    requests = e.select("event_id", F.when(k % 5 > 0, k - k % 2).alias("lease"))
    return O.give_back(e.filter(k % 3 == 0).select(k.alias("lease")), requests, "lease", "event_id").select("event_id", "released")


_RELEASED = """
WITH r AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id - event_id % 2 END AS lease FROM events), h AS (SELECT DISTINCT event_id AS lease FROM events WHERE event_id % 3 = 0)
SELECT event_id, h.lease IS NOT NULL AND row_number() OVER (PARTITION BY r.lease ORDER BY event_id) = 1 AS released FROM r LEFT JOIN h ON h.lease = r.lease
"""


def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    states = F.array(*[F.lit(x) for x in ("pending", "accepted", "rejected", "manual", "other", None)])
    rows = _t(spark, d, "events").select("user_id", F.element_at(states, (F.col("event_id") % 6 + 1).cast("int")).alias("decision"))
    return decision_counts(rows, "user_id", "decision")


_DECISIONS = "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_id % 6 = {i}) AS {x}" for i, x in enumerate(("pending", "accepted", "rejected", "manual"))) + " FROM events GROUP BY 1"

QUERIES = {f.__name__: f for f in (strict_amounts, quantity_cells, line_totals, repaired_days, place_codes, italian_addresses, focused_emails, stored_days, export_times, clean_texts, role_bonuses, top_reasons, scan_order, clamped_lines, page_places, block_places, repeated_shipping, continued_lines, date_role_days, released_leases, review_decisions)}
ORACLES = {
    "strict_amounts": _expected(_AMOUNTS, cell="VARCHAR", cents="BIGINT", status="VARCHAR", reason="VARCHAR"),
    "quantity_cells": _expected(_QUANTITIES, cell="VARCHAR", quantity="BIGINT"),
    "line_totals": _expected(_TOTALS, cell="VARCHAR", read="DOUBLE", price="DOUBLE", quantity="DOUBLE", total="BIGINT"),
    "repaired_days": _expected(_DAYS, cell="VARCHAR", day="VARCHAR"),
    "place_codes": _expected(_PLACES, cap="VARCHAR", country="VARCHAR", province="VARCHAR", code="VARCHAR"),
    "italian_addresses": _expected(_ADDRESSES, address="VARCHAR", country="VARCHAR", italian="BOOLEAN"),
    "focused_emails": _expected(_READINGS, observed="VARCHAR", focused="VARCHAR", selected="VARCHAR", changed="BOOLEAN"),
    "stored_days": _STORED,
    "export_times": _TIMES,
    "clean_texts": _CLEAN,
    "role_bonuses": _BONUS,
    "top_reasons": _REASONS,
    "scan_order": _SCAN,
    "clamped_lines": _CLAMP,
    "page_places": _PAGES,
    "block_places": _BLOCKS,
    "repeated_shipping": _SHIPPING,
    "continued_lines": _CONTINUED,
    "date_role_days": _ROLES,
    "released_leases": _RELEASED,
    "review_decisions": _DECISIONS,
}
