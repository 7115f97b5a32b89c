"""Queries on regions and zones of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import regions as R
from foliant.plans.money import _t

#: Order of a supplier's line items; an order has several of one number.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
#: By hand: a label, what it announces as a region (none: the zone decides), and as a zone.
LABELS = [
    ("Übertrag", "table_subtotal", 0.9, "carry_forward_label", None),
    ("Résumé", "historical_recap", 0.88, "historical_or_statistical_recap", None),
    ("TOTAL 3 AÑOS", "historical_recap", 0.88, "historical_or_statistical_recap", "totals"),
    ("Riepilogo IVA", "tax_recap", 0.9, "tax_recap_heading", "tax_summary"),
    ("Ship to", "ship_to_block", 0.85, "ship_to_anchor", None),
    ("Spettabile", "customer_block", 0.85, "customer_anchor", None),
    ("Customer", "customer_block", 0.85, "customer_anchor", "customer"),
    ("Fornitore", "issuer_block", 0.8, "issuer_anchor", None),
    ("ACME Ltd", None, None, None, "issuer"),
    ("Oggetto", None, None, None, "subject"),
    ("Subject", None, None, None, "subject"),
    ("Gesamtbetrag", "document_totals", 0.82, "totals_label", "totals"),
    ("IBAN", "payment_terms", 0.75, "payment_or_notes", "payment"),
    ("Q.TÀ", "commercial_table_header", 0.7, "table_header_token", None),
    ("Qty / Descrizione / Prezzo", "commercial_table_header", 0.7, "table_header_token", "items_table"),
    ("wood", None, None, None, None),
    ("steel", None, None, None, None),
    ("Numero", None, None, None, "metadata"),
    ("Bemerkung", None, None, None, "notes"),
]
#: By hand: zones of lines by flag and status, and their regions.
ZONES = [("R", "F", "items_table", "commercial_table_body"), ("A", "F", "footer", "footer"), ("N", "O", None, None), ("N", "F", "subject", "references")]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """The line items of a supplier as lines of a document, with a label, an amount and a zone."""
    label = F.element_at(F.array(*[F.lit(x[0]) for x in LABELS]), (F.pmod(F.col("l_partkey") * 7 + F.col("l_linenumber"), F.lit(len(LABELS))) + 1).cast("int"))
    zone = F.lit(None).cast("string")
    for flag, status, name, _ in ZONES:
        zone = F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), name).otherwise(zone)
    text = F.concat_ws("  ", label, F.col("l_quantity").cast("int").cast("string"))
    return _t(spark, d, "lineitem").select("l_suppkey", *ORDER, "l_quantity", "l_discount", text.alias("text"), zone.alias("zone"))


def document_regions(spark: SparkSession, d: str) -> DataFrame:
    found = R.annotate_regions(_lines(spark, d), ["l_suppkey"], ORDER)
    return found.select("l_suppkey", "l_orderkey", "l_linenumber", "text", "region", F.round(F.col("confidence") * 100).cast("int").alias("percent"), "reason")


def line_zones(spark: SparkSession, d: str) -> DataFrame:
    c = R.classify_lines(_lines(spark, d), ["l_suppkey"], ORDER, "text", F.col("l_quantity") == 1, F.col("l_quantity") == 2, F.col("l_discount") * 10)
    return c.select("l_suppkey", "l_orderkey", "l_linenumber", "text", "kind", "reason", "requires_review")


def _sql(x: object) -> str:
    return "NULL" if x is None else "'" + x + "'" if isinstance(x, str) else repr(x)


_VALUES = ", ".join(f"({i}, {', '.join(map(_sql, x))})" for i, x in enumerate(LABELS))
_SQL_LINES = f"""
w(i, label, region, sure, reason, kind) AS (VALUES {_VALUES}),
z(flag, status, zone, region) AS (VALUES {', '.join(f"({', '.join(map(_sql, x))})" for x in ZONES)}),
l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_discount, label || '  ' || l_quantity::INT AS text, kind, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(ORDER)}) AS k,
  coalesce(w.region, z.region, 'unknown') AS region, CASE WHEN w.region IS NOT NULL THEN (w.sure * 100)::INT WHEN z.region IS NOT NULL THEN 55 ELSE 20 END AS percent, CASE WHEN w.region IS NOT NULL THEN w.reason WHEN z.region IS NOT NULL THEN 'zone_' || zone ELSE 'unclassified' END AS reason
  FROM lineitem JOIN w ON w.i = (l_partkey * 7 + l_linenumber) % {len(LABELS)} LEFT JOIN z ON flag = l_returnflag AND status = l_linestatus)"""

_REGIONS = f"""
WITH RECURSIVE {_SQL_LINES},
s AS (
  SELECT l_suppkey, 0::BIGINT AS k, '' AS latch, NULL::BIGINT AS l_orderkey, NULL::INT AS l_linenumber, '' AS text, '' AS found, 0 AS percent, '' AS why FROM l WHERE k = 1
  UNION ALL
  SELECT l.l_suppkey, l.k, CASE WHEN l.region IN ('historical_recap', 'tax_recap') THEN l.region WHEN l.region IN ('commercial_table_header', 'commercial_table_body') THEN '' ELSE s.latch END,
    l.l_orderkey, l.l_linenumber::INT, l.text,
    CASE WHEN s.latch <> '' AND l.percent < 75 AND l.region NOT IN ('historical_recap', 'tax_recap', 'document_totals', 'commercial_table_header', 'commercial_table_body') THEN s.latch ELSE l.region END, l.percent,
    CASE WHEN s.latch <> '' AND l.percent < 75 AND l.region NOT IN ('historical_recap', 'tax_recap', 'document_totals', 'commercial_table_header', 'commercial_table_body') THEN l.reason || '+latched_recap' ELSE l.reason END
  FROM s JOIN l ON l.l_suppkey = s.l_suppkey AND l.k = s.k + 1)
SELECT l_suppkey, l_orderkey, l_linenumber, text, found AS region, percent, why AS reason FROM s WHERE k > 0
"""

# detected kind, customer context and open table, line by line
_KINDS = f"""
WITH RECURSIVE {_SQL_LINES},
m AS (SELECT *, CASE WHEN l_quantity IN (1, 2) THEN 'items_table' ELSE kind END AS d, coalesce(CASE WHEN l_quantity IN (1, 2) THEN 'items_table' ELSE kind END, '') AS e FROM l),
s AS (
  SELECT l_suppkey, 0::BIGINT AS k, 0 AS context, false AS open, NULL::BIGINT AS l_orderkey, NULL::INT AS l_linenumber, '' AS text, NULL::VARCHAR AS own, false AS near, 0::DOUBLE AS q, 0::DOUBLE AS centre FROM m WHERE k = 1
  UNION ALL
  SELECT m.l_suppkey, m.k,
    CASE WHEN m.e = 'customer' OR (s.context > 0 AND m.e IN ('', 'issuer')) THEN 3 WHEN m.e IN ('metadata', 'items_table', 'tax_summary', 'totals', 'payment', 'notes') THEN 0 ELSE greatest(s.context - 1, 0) END,
    CASE WHEN m.e = 'items_table' THEN true WHEN m.e IN ('totals', 'tax_summary', 'payment', 'notes') THEN false ELSE s.open END,
    m.l_orderkey, m.l_linenumber::INT, m.text, CASE WHEN s.context > 0 AND m.e IN ('', 'issuer') THEN 'customer' ELSE m.d END, s.context > 0 AND m.e IN ('', 'issuer'), m.l_quantity, m.l_discount * 10
  FROM s JOIN m ON m.l_suppkey = s.l_suppkey AND m.k = s.k + 1)
SELECT l_suppkey, l_orderkey, l_linenumber, text,
  CASE WHEN own IS NOT NULL THEN own WHEN open THEN 'items_table' WHEN centre <= 0.16 THEN 'header' WHEN centre >= 0.84 THEN 'footer' ELSE 'unknown' END AS kind,
  CASE WHEN near THEN 'party_field_near_customer_anchor' WHEN q = 1 THEN 'geometric_table_header' WHEN q = 2 THEN 'within_geometric_table_bounds' WHEN own IS NOT NULL THEN own || '_words' WHEN open THEN 'within_table_bounds' WHEN centre <= 0.16 THEN 'upper_page_geometry' WHEN centre >= 0.84 THEN 'lower_page_geometry' ELSE 'no_universal_zone_signal' END AS reason,
  coalesce(near OR (q <> 1 AND (q = 2 OR own IS NULL OR own = 'issuer')), true) AS requires_review
FROM s WHERE k > 0
"""

QUERIES = {"document_regions": document_regions, "line_zones": line_zones}
ORACLES = {"document_regions": _REGIONS, "line_zones": _KINDS}
