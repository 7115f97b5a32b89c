"""Queries on labels of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.labels import TYPES, label_rows, label_table
from foliant.operators import labels as L
from foliant.plans.money import _t

_ROWS = label_rows()
_CONCEPTS = ["total", "customer", "quantity", "unit_price", "description", "issuer"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """The line items of an order as lines of a document: a quantity, a label, and in every third line a price and another label."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    values = F.array(*[F.lit(r[4]) for r in _ROWS])
    at = lambda x: F.element_at(values, (x % len(_ROWS) + 1).cast("int"))
    first, second = at(F.col("l_partkey") * 3 + F.col("l_linenumber")), at(F.col("l_suppkey") * 7 + F.col("l_partkey"))
    text = F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_partkey") % 2 == 0, F.upper(first)).otherwise(first), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.col("l_suppkey").cast("string"), F.lit(": "), second)))
    return _t(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).alias("line"), text.alias("text"))


def document_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.line_labels(_lines(spark, d), label_table(spark), ["l_orderkey", "line"], _CONCEPTS)


def label_languages(spark: SparkSession, d: str) -> DataFrame:
    return L.document_languages(_lines(spark, d), label_table(spark), "l_orderkey", "line")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_KEY = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9%]+', ' ', 'g'))"
_SQL_LINES = f"""
b(place, concept, language, priority, label) AS (VALUES {', '.join(f"({p}, '{c}', '{lang}', {n}, {_quoted(x)})" for p, c, lang, n, x in _ROWS)}),
t AS (SELECT *, {_KEY.format('label')} AS key, len(string_split({_KEY.format('label')}, ' ')) AS words FROM b),
l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)::INT AS line, l_quantity::INT || ' ' || CASE WHEN l_partkey % 2 = 0 THEN upper(x.label) ELSE x.label END || CASE WHEN l_partkey % 3 = 0 THEN ' ' || l_suppkey || ': ' || y.label ELSE '' END AS text
  FROM lineitem JOIN b x ON x.place = (l_partkey * 3 + l_linenumber) % {len(_ROWS)} JOIN b y ON y.place = (l_suppkey * 7 + l_partkey) % {len(_ROWS)}),
k AS (SELECT *, ' ' || {_KEY.format('text')} || ' ' AS folded FROM l),
m AS (SELECT k.l_orderkey, k.line, t.* FROM k JOIN t ON contains(k.folded, ' ' || t.key || ' '))"""
_LABELS = f"""
WITH {_SQL_LINES},
f AS (SELECT l_orderkey, line, concept, language, label, row_number() OVER (PARTITION BY l_orderkey, line ORDER BY priority DESC, length(label) DESC, list_position([{', '.join(map(_quoted, _CONCEPTS))}], concept), place) AS o FROM m WHERE concept IN ({', '.join(map(_quoted, _CONCEPTS))})),
y AS (SELECT l_orderkey, line, arg_min(concept, list_position([{', '.join(map(_quoted, TYPES))}], concept)) AS type FROM m WHERE concept IN ({', '.join(map(_quoted, TYPES))}) GROUP BY ALL)
SELECT l.l_orderkey, l.line, f.concept, f.language, f.label, y.type FROM l LEFT JOIN f ON f.l_orderkey = l.l_orderkey AND f.line = l.line AND o = 1 LEFT JOIN y ON y.l_orderkey = l.l_orderkey AND y.line = l.line
"""
# line by line, while no language has 6 points
_LANGUAGES = f"""
WITH RECURSIVE {_SQL_LINES},
o AS (SELECT l_orderkey, line, arg_min(language, place) AS language, CASE WHEN max(words) > 1 OR length(key) >= 12 THEN greatest(2, least(4, max(words))) ELSE 1 END AS w FROM m JOIN k USING (l_orderkey, line) WHERE regexp_matches(folded, '[a-z]{{3}}') GROUP BY l_orderkey, line, key),
p AS (SELECT l_orderkey, line, coalesce(sum(w) FILTER (language = 'de'), 0) AS de, coalesce(sum(w) FILTER (language = 'en'), 0) AS en, coalesce(sum(w) FILTER (language = 'es'), 0) AS es, coalesce(sum(w) FILTER (language = 'fr'), 0) AS fr, coalesce(sum(w) FILTER (language = 'it'), 0) AS it FROM o GROUP BY ALL),
s AS (
  SELECT l_orderkey, 0 AS line, 0::HUGEINT AS de, 0::HUGEINT AS en, 0::HUGEINT AS es, 0::HUGEINT AS fr, 0::HUGEINT AS it, 99 AS fde, 99 AS fen, 99 AS fes, 99 AS ffr, 99 AS fit FROM (SELECT DISTINCT l_orderkey FROM l)
  UNION ALL
  SELECT s.l_orderkey, l.line, s.de + coalesce(p.de, 0), s.en + coalesce(p.en, 0), s.es + coalesce(p.es, 0), s.fr + coalesce(p.fr, 0), s.it + coalesce(p.it, 0),
    CASE WHEN p.de > 0 THEN least(fde, l.line) ELSE fde END, CASE WHEN p.en > 0 THEN least(fen, l.line) ELSE fen END, CASE WHEN p.es > 0 THEN least(fes, l.line) ELSE fes END, CASE WHEN p.fr > 0 THEN least(ffr, l.line) ELSE ffr END, CASE WHEN p.it > 0 THEN least(fit, l.line) ELSE fit END
  FROM s JOIN l ON l.l_orderkey = s.l_orderkey AND l.line = s.line + 1 LEFT JOIN p ON p.l_orderkey = l.l_orderkey AND p.line = l.line WHERE greatest(s.de, s.en, s.es, s.fr, s.it) < 6),
e AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY line DESC) = 1),
r AS (SELECT l_orderkey, list_sort(list_filter([{{'p': -de, 'f': fde, 'g': 'de'}}, {{'p': -en, 'f': fen, 'g': 'en'}}, {{'p': -es, 'f': fes, 'g': 'es'}}, {{'p': -fr, 'f': ffr, 'g': 'fr'}}, {{'p': -it, 'f': fit, 'g': 'it'}}], lambda z: z.p < 0)) AS r, de + en + es + fr + it AS total FROM e)
SELECT l_orderkey, r[1].g AS language, array_to_string(list_transform(r[2:], lambda z: z.g), ',') AS others, (-r[1].p)::BIGINT AS points, floor(least(1.0::DOUBLE, (-r[1].p)::DOUBLE / greatest(4, total)) * 100 + 0.5)::BIGINT AS percent, len(r) > 1 AND coalesce(-r[2].p, 0) >= greatest(2.0::DOUBLE, (-r[1].p) * 0.35::DOUBLE) AS mixed FROM r WHERE len(r) > 0
"""

QUERIES = {"document_labels": document_labels, "label_languages": label_languages}
ORACLES = {"document_labels": _LABELS, "label_languages": _LANGUAGES}
