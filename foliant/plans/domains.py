"""Query on mail domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import domains as D
from foliant.plans.money import _t

_ROOTS = ["bluetree", "kapitol", "kapitel", "northwind", "acme"]


def mail_domains(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of customers at a few firms; of each firm's some are cut short or misread, by the customer's number."""
    k = F.col("c_custkey")
    root = F.element_at(F.array(*[F.lit(x) for x in _ROOTS]), (F.col("c_nationkey") % len(_ROOTS) + 1).cast("int"))
    host = F.when(k % 23 == 0, F.substr(root, F.lit(1), F.length(root) - 1 - k % 3)).when(k % 29 == 0, F.concat(F.left(root, F.lit(2)), F.lit("x"), F.substr(root, F.lit(4)))).when(k % 31 == 0, F.concat(F.lit("firm"), k.cast("string"))).otherwise(root)
    email = F.when(k % 37 == 0, F.lit(None)).when(k % 41 == 0, F.lit("someone@gmail.com")).when(k % 43 == 0, F.concat(F.lit("a@"), host, F.lit(".example"))).otherwise(F.concat(F.lit("C"), k.cast("string"), F.lit("@"), host, F.when(k % 2 == 0, ".it").otherwise(".com")))
    return D.complete_domains(_t(spark, d, "customer").select(k.alias("id"), email.alias("email")))


# every domain against every other one
_SQL = f"""
WITH c AS (SELECT c_custkey AS k, [{', '.join(f"'{x}'" for x in _ROOTS)}][c_nationkey % {len(_ROOTS)} + 1] AS root FROM customer),
h AS (SELECT k, CASE WHEN k % 23 = 0 THEN substr(root, 1, (length(root) - 1 - k % 3)::INT) WHEN k % 29 = 0 THEN left(root, 2) || 'x' || substr(root, 4) WHEN k % 31 = 0 THEN 'firm' || k ELSE root END AS host FROM c),
e AS (SELECT k AS id, host, CASE WHEN k % 2 = 0 THEN 'it' ELSE 'com' END AS tail, k % 37 = 0 OR k % 41 = 0 OR k % 43 = 0 AS other, CASE WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN 'someone@gmail.com' WHEN k % 43 = 0 THEN 'a@' || host || '.example' ELSE 'C' || k || '@' || host || CASE WHEN k % 2 = 0 THEN '.it' ELSE '.com' END END AS email FROM h),
n AS (SELECT host, tail, count(*) AS n FROM e WHERE NOT other GROUP BY ALL),
p AS (SELECT a.host, a.tail, b.host AS long, b.n, row_number() OVER w AS o, lead(b.n) OVER w AS next FROM n a JOIN n b ON a.tail = b.tail AND a.host <> b.host AND length(b.host) >= 3 AND b.n >= 3 * a.n AND ((length(a.host) >= 2 AND starts_with(b.host, a.host)) OR (abs(length(a.host) - length(b.host)) <= 2 AND levenshtein(a.host, b.host) <= 2)) WINDOW w AS (PARTITION BY a.host, a.tail ORDER BY b.n DESC, b.host))
SELECT e.id, e.email, CASE WHEN NOT e.other AND p.long IS NOT NULL AND p.n >= 3 * coalesce(p.next, 0) THEN 'c' || e.id || '@' || p.long || '.' || e.tail ELSE e.email END AS completed,
  CASE WHEN e.other THEN 'none' WHEN p.long IS NULL THEN 'kept' WHEN p.n < 3 * coalesce(p.next, 0) THEN 'ambiguous' ELSE 'completed' END AS status
FROM e LEFT JOIN p ON p.host = e.host AND p.tail = e.tail AND o = 1
"""

QUERIES = {"mail_domains": mail_domains}
ORACLES = {"mail_domains": _SQL}
