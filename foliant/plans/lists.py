"""Queries on lists of records: search, filter, sort, batch, export, upsert and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import money as M
from foliant.functions import text as T
from foliant.operators import exports as X
from foliant.operators import lists as L
from foliant.plans.money import _t


def customer_search(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.filter(L.matches(L.search_blob("c_name", "c_mktsegment", "n_name"), "AUTÓ")).select("c_custkey", "c_name", "n_name")


_CUSTOMER = "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(strip_accents(lower(concat_ws(' ', c_name, c_mktsegment, n_name))), 'auto')"


def doc_search(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").filter(L.matches(F.col("text"), "Élle", short_ids=False)).select("doc_id", "lang")


_DOCS = "SELECT doc_id, lang FROM documents WHERE contains(strip_accents(lower(text)), 'elle')"


def short_query(spark: SparkSession, d: str) -> DataFrame:
    """Two-letter queries match everything; two-character identifiers do not."""
    n, p = _t(spark, d, "nation"), _t(spark, d, "part")
    return L.union_counts({"two_letters": n.filter(L.matches(F.col("n_name"), "zz")), "identifier": p.filter(L.matches(F.col("p_brand"), "#1")), "id_letter": p.filter(L.matches(F.col("p_brand"), "d2"))})


_SHORT = "SELECT 'two_letters' AS name, count(*) AS n FROM nation UNION ALL SELECT 'identifier', count(*) FROM part UNION ALL SELECT 'id_letter', count(*) FROM part WHERE contains(lower(p_brand), 'd2')"


def type_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = _t(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "P") & L.matches(L.search_blob("o_orderpriority", "o_orderstatus"), "urgent"))
    return kept.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


_TYPES = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_orderstatus IN ('F', 'P') AND contains(lower(concat_ws(' ', o_orderpriority, o_orderstatus)), 'urgent') GROUP BY ALL"


def export_sort_newest(spark: SparkSession, d: str) -> DataFrame:
    """Newest first, equal instants in input order."""
    return L.with_ordinal(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_orderkey", "ordinal")


def export_sort_name(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", T.fold(F.col("c_mktsegment")).alias("k"))
    return L.with_ordinal(c, F.asc("k"), F.asc("c_custkey")).select("c_custkey", "ordinal")


def export_batches(spark: SparkSession, d: str) -> DataFrame:
    return L.batches(L.with_ordinal(_t(spark, d, "customer").select("c_custkey", "c_name"), F.asc("c_name"), F.asc("c_custkey")))


_BATCHES = "WITH x AS (SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS o FROM customer) SELECT (o - 1) // 30 + 1 AS batch, min(o) AS first, max(o) AS last, count(*) AS n FROM x GROUP BY 1"


def line_item_export(spark: SparkSession, d: str) -> DataFrame:
    """A row for each line, labelled by its order; orders without lines give none."""
    o, l = _t(spark, d, "orders"), _t(spark, d, "lineitem")  # noqa: E741
    label = F.concat_ws("-", F.col("o_orderpriority"), F.col("o_orderkey").cast("string"))
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(label.alias("document"), F.col("l_linenumber").alias("line"), X.decimal_text(F.col("l_extendedprice"), "it").alias("amount"), X.day_text(F.col("l_shipdate"), "it").alias("day"))


_LINES = "SELECT o_orderpriority || '-' || o_orderkey AS document, l_linenumber AS line, translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS amount, strftime(l_shipdate, '%d/%m/%Y') AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def csv_render(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    row = X.csv_row(F.concat(F.col("c_name"), F.lit(' "x", y')), F.col("n_name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")), M.cents(F.col("c_acctbal")))
    return c.select("c_custkey", row.alias("csv"))


_CSV = """SELECT c_custkey, '"' || c_name || ' ""x"", y","' || n_name || '","' || CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END || '","' || CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) || '"' AS csv FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def vcard_render(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    phone = F.concat(F.lit("+39 0"), F.col("c_custkey").cast("string"))
    phones = F.array(F.struct(phone.alias("number"), F.when(F.col("c_custkey") % 2 == 0, "mobile").otherwise("other").alias("type")), F.struct(F.lit(" ").alias("number"), F.lit("fax").alias("type")))
    emails = F.when(F.col("c_custkey") % 4 == 0, F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.org")))).otherwise(F.array().cast("array<string>"))
    card = X.vcard(F.col("c_name"), F.lit("A;B, C\\D"), F.col("c_mktsegment"), F.lit(None).cast("string"), emails, phones, F.lit(" "), F.concat(F.col("n_name"), F.lit("\nx")), F.lit(None).cast("string"))
    return c.select("c_custkey", card.alias("vcard"))


_VCARD = r"""
SELECT c_custkey, 'BEGIN:VCARD' || e || 'VERSION:3.0' || e || 'FN:' || c_name || ' A\;B\, C\\D' || e || 'N:A\;B\, C\\D;' || c_name || ';;;' || e || 'ORG:' || c_mktsegment || e
 || CASE WHEN c_custkey % 4 = 0 THEN 'EMAIL:c' || c_custkey || '@example.org' || e ELSE '' END || 'TEL' || CASE WHEN c_custkey % 2 = 0 THEN ';TYPE=CELL' ELSE '' END || ':+39 0' || c_custkey || e
 || 'ADR:;;' || n_name || '\nx;;;;' || e || 'END:VCARD' || e AS vcard
FROM customer JOIN nation ON c_nationkey = n_nationkey, (SELECT chr(13) || chr(10) AS e)
"""


def json_render(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("json"))


_JSON = """SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS json FROM nation"""


def text_render(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    return s.select("s_suppkey", X.labelled(("Name", F.col("s_name")), ("Note", F.when(F.col("s_suppkey") % 2 == 0, F.lit("even"))), ("Balance", M.cents(F.col("s_acctbal")))).alias("text"))


_TEXT = "SELECT s_suppkey, 'Name: ' || s_name || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN 'Note: even' || chr(10) ELSE '' END || 'Balance: ' || CAST(floor(s_acctbal * 100 + 0.5) AS BIGINT) AS text FROM supplier"


def file_names(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    return p.select("p_partkey", X.file_token(F.concat(F.col("p_name"), F.lit(" / v1.2 : "), F.col("p_type"), F.lit("  end_"))).alias("token"))


_FILES = "SELECT p_partkey, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name || ' / v1.2 : ' || p_type || '  end_', '[<>:\"/\\\\|?*.]+', '', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 48) AS token FROM part"


def fingerprint_hash(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", X.fingerprint(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("sha256"))


_HASH = """SELECT c_custkey, sha256('{"id":' || c_custkey || ',"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS sha256 FROM customer"""


def union_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.union_counts({n: _t(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")})


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))


def orphans_anti(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return L.delete(_t(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


def live_semi(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return L.live(_t(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Events as versions of a record per user and type: the last one stays."""
    e = _t(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"), F.col("event_id").alias("version"), M.cents(F.col("value")).alias("cents"))
    return L.upsert(e.filter("version % 2 = 0"), e.filter("version % 2 = 1"), "id", "version")


_UPSERT = "WITH e AS (SELECT user_id || ':' || event_type AS id, event_id AS version, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events) SELECT id, max(version) AS version, arg_max(cents, version) AS cents FROM e GROUP BY id"


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A record by its key, from the first of two stores that has it."""
    a = _t(spark, d, "customer").filter("c_custkey = 7").select(F.col("c_name").alias("name"), F.lit(1).alias("store"))
    b = _t(spark, d, "supplier").filter("s_suppkey = 7").select(F.col("s_name").alias("name"), F.lit(2).alias("store"))
    return a.unionAll(b).orderBy("store").limit(1)


_POINT = "SELECT c_name AS name, 1 AS store FROM customer WHERE c_custkey = 7"

def consent_register(spark: SparkSession, d: str) -> DataFrame:
    """Events as consents by installation and version; those of the first days are stored already."""
    e = _t(spark, d, "events").select("event_id", F.col("user_id").alias("installation"), F.col("event_type").alias("version"))
    found = L.register_once(e.filter("event_id < 300"), e.filter("event_id >= 300"), ["installation", "version"], "event_id")
    return found.groupBy("version").agg(F.count("*").alias("n"), F.count_if("created").alias("n_created"), F.max(F.when(F.col("created"), F.col("event_id"))).alias("last_created"))


_CONSENT = "WITH e AS (SELECT event_id, user_id AS i, event_type AS v FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY i, v ORDER BY event_id) = 1 AND NOT EXISTS (SELECT 1 FROM e k WHERE k.event_id < 300 AND k.i = e.i AND k.v = e.v) AS created FROM e WHERE event_id >= 300) SELECT v AS version, count(*) AS n, count(*) FILTER (created) AS n_created, max(event_id) FILTER (created) AS last_created FROM r GROUP BY v"


def bounded_settings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).when(k % 4 == 2, F.lit("12.5")).otherwise(F.lit("99999999999"))
    return _t(spark, d, "part").select("p_partkey", L.bounded_int(text, 5, 40).alias("setting"))


_SETTINGS = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_partkey BETWEEN 5 AND 40 THEN p_partkey::INT WHEN p_partkey % 4 = 1 AND p_size BETWEEN 5 AND 40 THEN p_size END AS setting FROM part"

QUERIES = {
    f.__name__: f
    for f in (customer_search, doc_search, short_query, type_filter, export_sort_newest, export_sort_name, export_batches, line_item_export, csv_render, vcard_render, json_render, text_render, file_names, fingerprint_hash, union_counts, orphans_anti, live_semi, upsert_latest, point_lookup, consent_register, bounded_settings)
}
ORACLES = {
    "customer_search": _CUSTOMER, "doc_search": _DOCS, "short_query": _SHORT, "type_filter": _TYPES,
    "export_sort_newest": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS ordinal FROM orders",
    "export_sort_name": "SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) AS ordinal FROM customer",
    "export_batches": _BATCHES, "line_item_export": _LINES, "csv_render": _CSV, "vcard_render": _VCARD, "json_render": _JSON, "text_render": _TEXT, "file_names": _FILES, "fingerprint_hash": _HASH, "union_counts": _COUNTS,
    "orphans_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "live_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    "upsert_latest": _UPSERT, "point_lookup": _POINT, "consent_register": _CONSENT, "bounded_settings": _SETTINGS,
}
