"""Queries on kinds of documents, their export rows, strict days, mail evidence, table headers and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import documents as C
from foliant.operators import exports as X
from foliant.plans.fields import _dealt, _expected
from foliant.plans.money import _t

#: By hand: a text, whether it was confirmed, its day, status and reason.
_DAYS = [
    ("2024-02-29", False, "2024-02-29", "valid", "valid_calendar_date"), ("2023-02-29", False, None, "invalid", "invalid_calendar_date"), ("05/06/2024", False, "2024-06-05", "ambiguous", "ambiguous_day_month"), ("5.6.2024", True, "2024-06-05", "valid", "user_confirmed_day_month"), ("06-06-2024", None, "2024-06-06", "valid", "valid_calendar_date"),
    ("13/06/2024", False, "2024-06-13", "valid", "valid_calendar_date"), ("06/13/2024", False, None, "invalid", "invalid_calendar_date"), ("05/06/24", False, None, "invalid", "invalid_date_format"), ("N/A", False, None, "missing", "missing_value"), (None, None, None, "missing", "missing_value"), (" 0999-01-01 ", True, None, "invalid", "invalid_calendar_date"), ("2024-01-05", None, "2024-01-05", "valid", "valid_calendar_date"),
]


def strict_days(spark: SparkSession, d: str) -> DataFrame:
    rows = _dealt(spark, d, _DAYS, text="string", confirmed="boolean").withColumn("c", C.strict_day(F.col("text"), F.col("confirmed")))
    return rows.select("text", "confirmed", F.col("c.value").alias("day"), F.col("c.status").alias("status"), F.col("c.reason").alias("reason"), "n")


#: By hand: a kind or category, the category of the kind, what it is processed as, its labels and which number it has.
_KINDS = [
    ("quote", "quote", "quote", "Preventivo", "Quote", "q"), ("order", "order", "order", "Ordine", "Order", "o"), ("invoice", "invoice", "invoice", "Fattura", "Invoice", "i"), ("free_document", "generic_document", None, "Altro", "Other", "f"),
    ("delivery_document", None, "order", None, None, None), ("proforma_invoice", None, "invoice", None, None, None), ("generic_document", None, "free_document", None, None, None), ("generic_image", None, "free_document", None, None, None), ("card", None, None, None, None, None), (None, None, None, None, None, None),
]


def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("kind")
    number = C.by_kind(k, *[F.lit(x) for x in "qoif"])
    return _dealt(spark, d, _KINDS, kind="string").select("kind", C.category_of(k).alias("category"), C.processed_as(k).alias("processed"), C.kind_label(k, "it").alias("it"), C.kind_label(k, "en").alias("en"), number.alias("number"), "n")


_FIELDS = [("valid", False, True), ("valid", True, False), ("unverified", None, True), ("invalid", False, False), ("ambiguous", False, False), (None, False, False), ("missing", None, False)]


def applicable_fields(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d, _FIELDS, status="string", conflict="boolean").select("status", "conflict", C.may_apply(F.col("status"), F.col("conflict")).alias("applies"), "n")


def safe_emails(spark: SparkSession, d: str) -> DataFrame:
    """Customers with three addresses, one of them twice and one malformed; of five, one has no evidence at all, and one each
    lacks what makes it usable."""
    k = F.col("c_custkey")
    own = F.concat(F.lit("c"), k.cast("string"), F.lit("@example.org"))
    seen = lambda e, origin: F.struct(e.alias("value"), F.when(k % 5 == 1, "invalid").otherwise("valid").alias("status"), (k % 5 == 2).alias("review"), (k % 5 != 3).alias("confirmed"), F.lit(origin).alias("origin"))
    evidence = F.when(k % 5 > 0, F.array(seen(F.upper(own), "observed"), seen(F.lit("z@example.org"), "inferred"), seen(F.lit("y@example.org"), "user")))
    emails = F.array(own, F.lit("z@example.org"), F.upper(own), F.lit("nobody"), F.lit(" Y@example.org"))
    return _t(spark, d, "customer").select("c_custkey", F.array_join(C.safe_emails(emails, evidence), ",").alias("emails"))


_EMAILS = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'c' || c_custkey || '@example.org,y@example.org' ELSE '' END AS emails FROM customer"

_SCRIPTS = [("東京", True), ("東 A", True), ("한 Acme", False), ("Acme", False), ("カ1", True), ("カ12", False), ("", False), ("Acme 株式会社 Ltd 2024", True)]


def cjk_lines(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d, _SCRIPTS, line="string").select("line", C.is_cjk(F.col("line")).alias("cjk"), "n")


#: By hand: columns from left to right as kind:x, confidence and violations.
_SCHEMAS = [
    ("code:1,description:20,quantity:50,price:70,total:90", "strong", ""), ("description:20,unit:60,quantity:50,total:90", "medium", ""), ("description:20,price:70,vat:80,discount:85,total:90", "medium", "vat_after_discount"), ("quantity:5,description:20,price:70,total:90", "weak", "quantity_after_description"),
    ("description:20,total:60,quantity:90", "weak", "total_after_quantity quantity_right_of_total"), ("description:20,quantity:50", "weak", "missing_core_columns"), ("description:20,price:50,price:70,total:90", "weak", "duplicate_column_role"), ("total:5", "weak", "missing_core_columns"),
]


def table_schemas(spark: SparkSession, d: str) -> DataFrame:
    columns = F.transform(F.split("columns", ","), lambda c: F.struct(F.split_part(c, F.lit(":"), F.lit(1)).alias("kind"), F.split_part(c, F.lit(":"), F.lit(2)).cast("double").alias("x")))
    rows = _dealt(spark, d, _SCHEMAS, columns="string").withColumn("c", C.schema_score(columns))
    return rows.select("columns", F.col("c.confidence").alias("confidence"), F.array_join("c.violations", " ").alias("violations"), "n")


#: By hand: description, code, quantity, price, total; whether the text is none of an item's, and whether the row is kept.
_ITEMS = [
    ("Filtro aria", None, 2.0, 5.0, 10.0, False, True), ("Totale", None, None, None, 10.0, False, False), ("Acconto versato", None, 1.0, 5.0, 5.0, False, False), ("", "AB12", 1.0, 1.0, 1.0, True, False), (None, None, None, None, None, True, False), ("Pannello", "AB-12", None, None, None, False, True),
    ("Pannello", "AB", None, None, None, False, False), ("Logo included", None, None, None, None, False, True), ("Condizioni generali", None, 1.0, None, None, True, False), ("Condizioni generali servizio", None, 1.0, None, None, True, True), ("Riporto da pagina 2", None, None, None, None, True, False), ("Campione", None, None, 0.0, None, False, True), ("Campione", None, 0.0, 0.0, None, False, False), ("IBAN IT60", None, None, None, 3.0, True, False),
]


def item_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _dealt(spark, d, _ITEMS, description="string", code="string", quantity="double", price="double", total="double")
    t = F.col("description")
    return rows.select("description", "code", "quantity", "price", "total", C.is_no_item(t).alias("no_item"), C.is_item(t, *[F.col(c) for c in ("code", "quantity", "price", "total")]).alias("kept"), "n")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents of four kinds that all have every field, but for some blank ones."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    some = lambda name, m: F.when(k % m > 0, F.concat(F.lit(f" {name} "), k.cast("string"))).alias(name)
    fields = F.map_from_arrays(F.array(F.lit("colour"), F.lit("rawText"), F.lit("size"), F.lit("blank")), F.array(F.lit(" red"), F.lit("x"), k.cast("string"), F.lit(" ")))
    return _t(spark, d, "orders").select(
        k.alias("doc_id"), F.element_at(F.array(*[F.lit(x) for x in C.KINDS]), (k % 4 + 1).cast("int")).alias("kind"), some("title", 3), k.cast("string").alias("number"), F.when(k % 5 > 0, day).alias("day"), day.alias("valid_until"), day.alias("delivery_day"), F.when(k % 3 > 0, day).alias("due_day"),
        some("customer", 2), some("customer_vat", 7), some("subject", 5), some("shipping_address", 3), F.floor("o_totalprice").alias("subtotal"), (k % 9).alias("vat_amount"), (F.floor("o_totalprice") + k % 9).alias("total"), F.lit(" eur").alias("currency"), some("notes", 11), fields.alias("fields"),
        day.alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
    )


def document_export(spark: SparkSession, d: str) -> DataFrame:
    return X.document_rows(_documents(spark, d), "it")


def document_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.summary_rows(X.document_rows(_documents(spark, d), "en"))


def document_details(spark: SparkSession, d: str) -> DataFrame:
    return X.detail_rows(X.document_rows(_documents(spark, d), "it"))


def _rows_sql(labels: str, day: str) -> str:
    on = lambda kind, value: f"CASE WHEN k % 4 = {kind} THEN {value} ELSE '' END"
    some = lambda name, m: f"CASE WHEN k % {m} > 0 THEN '{name} ' || k ELSE '' END"
    return f"""
WITH o AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS t, strftime(o_orderdate, '{day}') AS day, strftime(o_orderdate, '{day} %H:%M') AS stamp FROM orders),
 r AS (SELECT k AS doc_id, [{labels}][k % 4 + 1] AS type, {some('title', 3)} AS title, k::VARCHAR AS number, CASE WHEN k % 5 > 0 THEN day ELSE '' END AS date,
  {on(0, 'day')} AS valid_until, {on(1, 'day')} AS delivery_date, {on(2, "CASE WHEN k % 3 > 0 THEN day ELSE '' END")} AS due_date, CASE WHEN k % 4 < 3 THEN {some('customer', 2)} ELSE '' END AS customer_name,
  CASE WHEN k % 4 < 3 THEN {some('customer_vat', 7)} ELSE '' END AS customer_vat, {on(3, some('subject', 5))} AS subject, {on(1, some('shipping_address', 3))} AS shipping_address, CASE WHEN k % 4 < 3 THEN t END AS subtotal, '' AS vat_rate,
  CASE WHEN k % 4 < 3 THEN k % 9 END AS vat_amount, CASE WHEN k % 4 < 3 THEN t + k % 9 END AS total, CASE WHEN k % 4 < 3 THEN 'EUR' ELSE '' END AS currency, {some('notes', 11)} AS notes, {on(3, "'colour: red; size: ' || k")} AS extracted_summary,
  stamp AS created_at, '' AS updated_at FROM o)
"""


_IT, _EN = _rows_sql("'Preventivo', 'Ordine', 'Fattura', 'Altro'", "%d/%m/%Y"), _rows_sql("'Quote', 'Order', 'Invoice', 'Other'", "%m/%d/%Y")
_SUMMARY = _EN + "SELECT doc_id, type, number, title, date, customer_name, '' AS supplier, subtotal, vat_rate, vat_amount, total, currency FROM r"
_DETAILS = _IT + "SELECT doc_id, type, number, valid_until, delivery_date, due_date, customer_vat, subject, shipping_address, notes, extracted_summary, created_at, updated_at, doc_id % 4 IN (0, 1, 3) OR doc_id % 3 > 0 OR doc_id % 7 > 0 OR doc_id % 11 > 0 AS told FROM r"


def day_columns(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of days, one of them kept as instants."""
    texts = _t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("b"))
    return X.with_days(texts, "a", "b")


_DAY_COLUMNS = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b FROM orders"


def live_assets(spark: SparkSession, d: str) -> DataFrame:
    """Images of contacts (two each, one for every third) and of documents (one, none for every second)."""
    image = lambda c, i: F.concat(F.lit(f"{i}-"), F.col(c).cast("string"), F.lit(".jpg"))
    contacts = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.array(image("c_custkey", 0), image("c_custkey", 1))).otherwise(F.array(image("c_custkey", 0))).alias("images"))
    docs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.array(image("o_orderkey", 0))).alias("images"))
    return X.live_assets({"contact": contacts, "document": docs}, "id", "images")


_ASSETS = """
SELECT 'contact' AS owner, c_custkey AS id, '0-' || c_custkey || '.jpg' AS asset FROM customer UNION ALL SELECT 'contact', c_custkey, '1-' || c_custkey || '.jpg' FROM customer WHERE c_custkey % 3 > 0
UNION ALL SELECT 'document', o_orderkey, '0-' || o_orderkey || '.jpg' FROM orders WHERE o_orderkey % 2 = 0
"""

QUERIES = {f.__name__: f for f in (strict_days, document_kinds, applicable_fields, safe_emails, cjk_lines, table_schemas, item_rows, document_export, document_summary, document_details, day_columns, live_assets)}
ORACLES = {
    "strict_days": _expected(_DAYS, text="VARCHAR", confirmed="BOOLEAN", day="VARCHAR", status="VARCHAR", reason="VARCHAR"),
    "document_kinds": _expected(_KINDS, kind="VARCHAR", category="VARCHAR", processed="VARCHAR", it="VARCHAR", en="VARCHAR", number="VARCHAR"),
    "applicable_fields": _expected(_FIELDS, status="VARCHAR", conflict="BOOLEAN", applies="BOOLEAN"),
    "safe_emails": _EMAILS,
    "cjk_lines": _expected(_SCRIPTS, line="VARCHAR", cjk="BOOLEAN"),
    "table_schemas": _expected(_SCHEMAS, columns="VARCHAR", confidence="VARCHAR", violations="VARCHAR"),
    "item_rows": _expected(_ITEMS, description="VARCHAR", code="VARCHAR", quantity="DOUBLE", price="DOUBLE", total="DOUBLE", no_item="BOOLEAN", kept="BOOLEAN"),
    "document_export": _IT + "SELECT * FROM r",
    "document_summary": _SUMMARY,
    "document_details": _DETAILS,
    "day_columns": _DAY_COLUMNS,
    "live_assets": _ASSETS,
}
