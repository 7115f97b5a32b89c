"""Queries on lines, zones, quality, language and candidates, and on quotas, limits and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import money as M
from foliant.functions import text as T
from foliant.operators import layout as L
from foliant.operators import state as S
from foliant.plans.money import _t

# Function words by language.
FUNCTION_WORDS = {"de": ["der", "die", "und", "ist", "mit"], "en": ["the", "of", "and", "is", "with"], "es": ["de", "la", "que", "el", "con"], "fr": ["le", "la", "les", "et", "des"]}
WEIGHTS = {"has_legal_form": 0.62, "is_title_case": 0.14, "position_rank": 0.08, "has_catalog_keyword": -0.28}


def zone_islands(spark: SparkSession, d: str) -> DataFrame:
    return L.zones(_t(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type", F.min("event_id").alias("low"), F.max("event_id").alias("high"))


_ZONES = "WITH e AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), z AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS zone FROM e) SELECT user_id, zone, event_type, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM z GROUP BY ALL"


def context_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    e = L.carry(_t(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", 4)
    return e.select("user_id", "event_id", F.col("distance").cast("bigint").alias("distance"), "in_context")


_CARRY = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), a AS (SELECT *, k - last_value(CASE WHEN event_type = 'purchase' THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS d FROM e) SELECT user_id, event_id, d AS distance, coalesce(d <= 4, false) AS in_context FROM a"


def ocr_quality_score(spark: SparkSession, d: str) -> DataFrame:
    lines = L.lines_of(_t(spark, d, "documents"))
    q = lines.select("doc_id", F.floor(T.line_quality(F.col("line")) * 1000 + 0.5).alias("q"))
    return q.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("q").alias("sum_permille"), F.min("q").alias("low_permille"))


_READ, _COMMON = r"[\p{L}\p{N}@.+\-_/():,;''’&]", r"[\p{L}\p{N}@.+\-_/():,;''’&€$£%#]"
_LINES = r"l AS (SELECT doc_id, trim(x, ' ') AS t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS x FROM documents) WHERE trim(x, ' ') <> '')"
_SHARES = f"s AS (SELECT doc_id, t, length(regexp_replace(t, '\\s', '', 'g')) AS n, length(regexp_replace(regexp_replace(t, '\\s', '', 'g'), '{_READ}', '', 'g')) AS odd, length(regexp_replace(regexp_replace(t, '\\s', '', 'g'), '{_COMMON}', '', 'g')) AS rare FROM l)"
_Q = "q AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE (n - odd) / n END AS read, CASE WHEN n = 0 THEN 0 ELSE rare / n END AS unusual FROM s), r AS (SELECT *, floor(least(1.0, greatest(0.0, 0.2 + least(length(t) / 24, 1.0) * 0.25 + read * 0.35 + 0.5 * 0.2 - least(unusual * 2, 1.0) * 0.35)) * 1000 + 0.5) / 1000 AS line FROM q)"
_QUALITY = f"WITH {_LINES}, {_SHARES}, {_Q} SELECT doc_id, count(*) AS n_lines, sum(floor(line * 1000 + 0.5))::BIGINT AS sum_permille, min(floor(line * 1000 + 0.5))::BIGINT AS low_permille FROM r GROUP BY doc_id"


def quality_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Labels of documents rolled up by source: all good, any toxic, the share of good ones."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    g = docs.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("n_measured"), F.min(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("all_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("any_toxic"), F.sum("quality").alias("good"))
    return g.select("source", "n", "n_measured", "all_good", "any_toxic", F.when(F.col("n") == F.col("n_measured"), F.col("good")).alias("measured_good"), F.expr("1000 * good div n_measured").alias("good_permille"))


_ROLLUP = "SELECT source, count(*) AS n, count(quality) AS n_measured, bool_and(coalesce(quality = 1, false)) AS all_good, bool_or(coalesce(toxic = 1, false)) AS any_toxic, CASE WHEN count(*) = count(quality) THEN sum(quality)::BIGINT END AS measured_good, (1000 * sum(quality) // count(quality))::BIGINT AS good_permille FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return L.detect_language(_t(spark, d, "documents"), FUNCTION_WORDS)


_HITS = ", ".join(f"{{'n': len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)})))::BIGINT, 'k': '{k}'}}" for k, ws in FUNCTION_WORDS.items())
_LANGUAGE = rf"WITH d AS (SELECT doc_id, regexp_split_to_array(strip_accents(lower(text)), '[^\p{{L}}]+') AS w FROM documents), h AS (SELECT doc_id, unnest([{_HITS}]) AS h FROM d), r AS (SELECT doc_id, h.n AS n, h.k AS k, row_number() OVER (PARTITION BY doc_id ORDER BY h.n DESC, h.k) AS o FROM h) SELECT a.doc_id, CASE WHEN a.n > 0 THEN a.k END AS language, a.n AS hits, b.n * 2 > a.n AND a.n > 0 AS mixed FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.o = 1 AND b.o = 2"


def candidate_score_topk(spark: SparkSession, d: str) -> DataFrame:
    """Parts as candidates of a brand: two best, exclusive by size."""
    p = _t(spark, d, "part")
    c = p.select("p_partkey", "p_brand", "p_size", (F.col("p_size") % 3 == 0).alias("has_legal_form"), (F.length("p_name") % 2 == 0).alias("is_title_case"), (F.col("p_size") / 50).alias("position_rank"), (F.col("p_retailprice") > 1500).alias("has_catalog_keyword"), F.when(F.col("p_size") % 4 > 0, F.lit(0.5)).alias("confidence_ocr"))
    top = L.select_top(L.score_candidates(c, WEIGHTS), ["p_brand"], "p_partkey", 4)
    milli = lambda x: F.floor(F.col(x) * 1000 + 0.5)
    return L.exclusive_lines(top, "p_brand", "p_size", "p_partkey").select("p_brand", "p_partkey", "rank", milli("score").alias("score_permille"), milli("confidence").alias("confidence_permille"))


_LOW, _HIGH = 0.35 + sum(w for w in WEIGHTS.values() if w < 0), 0.35 + sum(w for w in WEIGHTS.values() if w > 0)
_TOPK = f"""
WITH c AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_size % 4 > 0 THEN 0.5::DOUBLE END AS ocr, 0.35::DOUBLE + (p_size % 3 = 0)::INT::DOUBLE * 0.62::DOUBLE + (length(p_name) % 2 = 0)::INT::DOUBLE * 0.14::DOUBLE + (p_size / 50) * 0.08::DOUBLE + (p_retailprice > 1500)::INT::DOUBLE * -0.28::DOUBLE AS raw FROM part),
 s AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (raw - {_LOW!r}::DOUBLE) / ({_HIGH!r}::DOUBLE - {_LOW!r}::DOUBLE))) AS score FROM c),
 t AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, score * 0.72::DOUBLE + coalesce(ocr, 0.7::DOUBLE) * 0.28::DOUBLE)) AS confidence FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, confidence DESC, p_partkey) AS rank FROM t WHERE score >= 0.32),
 x AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY score DESC, p_partkey) AS k FROM r WHERE rank <= 4)
SELECT p_brand, p_partkey, rank::INT AS rank, floor(score * 1000 + 0.5)::BIGINT AS score_permille, floor(confidence * 1000 + 0.5)::BIGINT AS confidence_permille FROM x WHERE k = 1
"""


def bbox_bucket(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select("p_brand", "p_size", M.cents(F.col("p_retailprice")).alias("x"))
    return L.y_buckets(p, "p_brand", "p_size", 12.0, F.min("x").alias("left"), F.max("x").alias("right"))


_BBOX = "SELECT p_brand, floor(p_size / 12.0 + 0.5)::BIGINT AS bucket, count(*) AS n, min(CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT)) AS left, max(CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT)) AS right FROM part GROUP BY ALL"


def nearest_column(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order and the nearest quantity among its first two lines, within 10."""
    l = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")  # noqa: E741
    anchors = l.filter("l_linenumber <= 2").select("l_orderkey", F.col("l_quantity").alias("ax"), F.col("l_linenumber").alias("column"))
    return L.nearest(l.filter("l_linenumber > 2"), anchors, "l_orderkey", "l_quantity", "column", 10.0).select("l_orderkey", "l_linenumber", "column", F.col("distance").cast("bigint").alias("distance"))


_NEAREST = "WITH x AS (SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS c, abs(a.l_quantity - b.l_quantity) AS d, row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber, a.l_quantity ORDER BY abs(a.l_quantity - b.l_quantity), b.l_linenumber) AS k FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber > 2 AND b.l_linenumber <= 2 AND abs(a.l_quantity - b.l_quantity) <= 10) SELECT l_orderkey, l_linenumber, c AS column, d::BIGINT AS distance FROM x WHERE k = 1"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def fixed_window_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return S.rate_limit(_events(spark, d), "user_id", 3, 36 * 3600, S.FixedWindow).select("user_id", "event_id", "allowed", "retry_after")


_FIXED = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT user_id, event_id, k, t AS b, 1 AS c, true AS allowed, 0::BIGINT AS retry_after FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t - r.b >= 129600000000 THEN e.t ELSE r.b END, CASE WHEN e.t - r.b >= 129600000000 THEN 1 WHEN r.c >= 3 THEN r.c ELSE r.c + 1 END,
   e.t - r.b >= 129600000000 OR r.c < 3, CASE WHEN e.t - r.b < 129600000000 AND r.c >= 3 THEN greatest(1, (r.b + 129600000000 - e.t + 999999) // 1000000) ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, allowed, retry_after FROM r
"""


def sliding_log_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return S.rate_limit(_events(spark, d), "user_id", 3, 36 * 3600, S.SlidingLog).select("user_id", "event_id", "allowed", "retry_after")


_SLIDING = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT user_id, event_id, k, [t] AS h, true AS allowed, 0::BIGINT AS retry_after FROM e WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, CASE WHEN len(h) < 3 THEN list_append(h, t) ELSE h END, len(h) < 3, CASE WHEN len(h) < 3 THEN 0 ELSE greatest(1, (h[1] + 129600000000 - t + 999999) // 1000000) END
   FROM (SELECT e.user_id, e.event_id, e.k, e.t, list_filter(r.h, lambda x: x > e.t - 129600000000) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, event_id, allowed, retry_after FROM r
"""


def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    q = S.daily_quota(_t(spark, d, "events").select("event_id", "ts"), "ts", 200, F.asc("event_id"))
    return q.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.count_if("allowed").alias("admitted"), F.max(F.when(F.col("allowed"), F.col("event_id"))).alias("last_admitted"))


_QUOTA = "WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS k FROM events) SELECT day, count(*) AS calls, count(*) FILTER (k <= 200) AS admitted, max(event_id) FILTER (k <= 200) AS last_admitted FROM e GROUP BY day"


def _operations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    op = F.when(k % 7 == 0, "grant").when(k % 7 < 4, "reserve").when(k % 7 < 6, "commit").otherwise("release")
    return _events(spark, d).select("user_id", "event_id", "us", op.alias("op"), (F.expr("event_id div 4") % 9).cast("string").alias("operation"), (k % 5 + F.when(op == "grant", 6).otherwise(1)).alias("credits"), F.lit(86400 * 20).alias("lease"))


def ledger_balance(spark: SparkSession, d: str) -> DataFrame:
    j = _operations(spark, d).select("user_id", "event_id", F.when(F.col("op") == "commit", "consume").otherwise(F.col("op")).alias("kind"), "operation", "credits")
    return S.ledger_balance(j, "user_id", "operation", "kind", "credits", "event_id")


_BALANCE = """
WITH o AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'grant' WHEN event_id % 7 < 4 THEN 'reserve' WHEN event_id % 7 < 6 THEN 'consume' ELSE 'release' END AS kind, (event_id // 4) % 9 AS operation FROM events),
 f AS (SELECT *, event_id % 5 + CASE WHEN kind = 'grant' THEN 6 ELSE 1 END AS c, row_number() OVER (PARTITION BY user_id, operation, kind ORDER BY event_id) AS k FROM o)
SELECT user_id, sum(CASE kind WHEN 'grant' THEN c WHEN 'consume' THEN -c ELSE 0 END)::BIGINT AS balance, count(*) AS n_entries FROM f WHERE k = 1 GROUP BY user_id
"""


def ledger_reserve_commit(spark: SparkSession, d: str) -> DataFrame:
    """The saga of reservations; tested against a plain version."""
    return S.ledger(_operations(spark, d), "user_id").select("user_id", "event_id", "op", "outcome", "balance")


def entitlement_state(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").groupBy("user_id").agg(F.min(F.col("ts").cast("timestamp")).alias("started"), F.count("*").alias("scans"))
    now, k = F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("user_id")
    status = F.when(k % 11 == 0, "revoked").when(k % 13 == 0, "blocked").otherwise("active")
    expires = F.when(k % 17 > 0, F.timestamp_micros(F.unix_micros("started") + 86_400_000_000 * (k % 60)))
    return e.select("user_id", S.entitlement(now, F.col("started"), expires, F.col("scans"), 55 + k % 20, status).alias("state"))


_ENTITLEMENT = "WITH e AS (SELECT user_id AS k, min(ts) AS s, count(*) AS n FROM events GROUP BY 1) SELECT k AS user_id, CASE WHEN k % 11 = 0 THEN 'REVOKED' WHEN k % 17 = 0 THEN 'NONE' WHEN k % 13 = 0 THEN 'EXPIRED' WHEN epoch_us(s) + 86400000000 * (k % 60) <= epoch_us(TIMESTAMP '2024-02-01') THEN 'EXPIRED_TIME' WHEN n >= 55 + k % 20 THEN 'EXPIRED_SCANS' ELSE 'TRIAL' END AS state FROM e"

QUERIES = {
    f.__name__: f
    for f in (zone_islands, context_carry_forward, ocr_quality_score, quality_rollup, language_detect, candidate_score_topk, bbox_bucket, nearest_column, fixed_window_rate_limit, sliding_log_rate_limit, daily_quota, ledger_balance, ledger_reserve_commit, entitlement_state)
}
ORACLES = {
    "zone_islands": _ZONES, "context_carry_forward": _CARRY, "ocr_quality_score": _QUALITY, "quality_rollup": _ROLLUP, "language_detect": _LANGUAGE, "candidate_score_topk": _TOPK, "bbox_bucket": _BBOX, "nearest_column": _NEAREST,
    "fixed_window_rate_limit": _FIXED, "sliding_log_rate_limit": _SLIDING, "daily_quota": _QUOTA, "ledger_balance": _BALANCE, "entitlement_state": _ENTITLEMENT,
}
