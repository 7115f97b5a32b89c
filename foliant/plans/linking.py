"""Queries on duplicates, merged evidence and reconciled sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import money as M
from foliant.functions import text as T
from foliant.operators import linkage as K
from foliant.operators import merging as G
from foliant.plans.money import _t


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return K.duplicate_groups(docs, F.md5(T.token(F.col("text"))), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


_TOKEN = r"regexp_replace(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]', '', 'g')"
_GROUPS = f"SELECT md5({_TOKEN.format('text')}) AS key, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1"


def duplicate_keep_policy(spark: SparkSession, d: str) -> DataFrame:
    return K.newest_of_groups(_t(spark, d, "part"), T.token(F.col("p_name")), "p_partkey", "p_retailprice")


_NEWEST = f"WITH p AS (SELECT {_TOKEN.format('p_name')} AS key, *, row_number() OVER (PARTITION BY {_TOKEN.format('p_name')} ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER (PARTITION BY {_TOKEN.format('p_name')}) AS n FROM part) SELECT key, p_partkey AS removed FROM p WHERE k = 1 AND n > 1"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    cents = M.cents(F.floor(F.col("o_totalprice") / 1000) * 10)
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("day"), cents.alias("cents"))


_SQL_ORDERS = "SELECT o_orderkey AS id, o_orderstatus AS type, o_custkey AS customer, CAST(o_orderdate AS DATE) AS day, CAST(floor(floor(o_totalprice / 1000) * 10 * 100 + 0.5) AS BIGINT) AS cents FROM orders"


def possible_duplicates_2of3(spark: SparkSession, d: str) -> DataFrame:
    return K.secondary_pairs(_orders(spark, d)).filter("id < other")


_TWO_OF_THREE = f"WITH o AS ({_SQL_ORDERS}) SELECT a.id, b.id AS other, (a.customer = b.customer)::INT + (a.day = b.day)::INT + (a.cents = b.cents)::INT AS signals FROM o a JOIN o b ON a.type = b.type AND a.id < b.id AND (a.customer = b.customer)::INT + (a.day = b.day)::INT + (a.cents = b.cents)::INT >= 2"


def document_matches(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents: two in five have a number, some of them a label or a tax number."""
    k = F.col("id")
    number = F.when(k % 5 == 0, F.concat(F.lit("OF / "), F.expr("id div 50").cast("string"))).when(k % 5 == 1, F.concat(F.lit("of/"), F.expr("id div 50").cast("string"), F.lit(" "))).when(k % 5 == 2, F.lit("Fattura")).when(k % 5 == 3, F.lit("IT01234567890"))
    return K.document_match(_orders(spark, d).withColumn("number", F.coalesce(number, F.lit(""))), ["fattura", "invoice", "order"])


_MATCHES = f"""
WITH o AS (SELECT *, CASE WHEN id % 5 IN (0, 1) THEN 'of/' || id // 50 END AS key FROM ({_SQL_ORDERS})),
 s AS (SELECT a.id, 'strong' AS kind, min(b.id) AS other FROM o a JOIN o b ON a.type = b.type AND a.key = b.key AND a.id <> b.id GROUP BY a.id),
 p AS (SELECT a.id, 'possible' AS kind, min(b.id) AS other FROM o a JOIN o b ON a.key IS NULL AND b.key IS NULL AND a.type = b.type AND a.id <> b.id AND (a.customer = b.customer)::INT + (a.day = b.day)::INT + (a.cents = b.cents)::INT >= 2 GROUP BY a.id)
SELECT * FROM s UNION ALL SELECT * FROM p
"""


def fuzzy_name_pairs(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "part").select(T.token(F.concat("p_name", "p_brand")).alias("name"))
    return K.similar_pairs(names).select("a", "b", (F.floor(F.col("similarity") * 10000 + 0.5) / 10000).alias("similarity"))


_FUZZY = f"WITH n AS (SELECT DISTINCT {_TOKEN.format('p_name || p_brand')} AS name FROM part), p AS (SELECT x.name AS a, y.name AS b, 1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name)) AS s FROM n x JOIN n y ON x.name < y.name) SELECT a, b, floor(s * 10000 + 0.5) / 10000 AS similarity FROM p WHERE s >= 0.78"


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    names = F.array(*[F.lit(x) for x in ("Anna", "Marco", "Lucía", "Jürgen", "Chloé", "Paul", "Marta")])
    last = F.concat(F.lit("Rossi"), (F.expr("c_custkey div 2") % 211).cast("string"))
    return _t(spark, d, "customer").select(
        k.alias("id"), F.element_at(names, (F.expr("c_custkey div 3") % 7 + 1).cast("int")).alias("first_name"), last.alias("last_name"), F.concat(F.col("c_mktsegment"), F.when(k % 2 == 0, " S.r.l.").otherwise(" GmbH")).alias("company"),
        F.when(k % 4 == 0, F.concat(F.lit("info@firm"), (k % 50).cast("string"), F.lit(".example"))).when(k % 4 == 1, F.concat(F.lit("p"), F.expr("c_custkey div 9").cast("string"), F.lit("@gmail.com"))).alias("email"),
        F.when(k % 3 == 0, F.concat(F.lit("+39 02 "), (F.expr("c_custkey div 6") + 1000000).cast("string"))).when(k % 3 == 1, F.concat(F.lit("02"), (F.expr("c_custkey div 6") + 1000000).cast("string"))).alias("phone"),
        F.when(k % 5 == 0, F.concat(F.lit("https://www.firm"), (k % 40).cast("string"), F.lit(".example/x"))).alias("website"), F.when(k % 10 == 0, (F.expr("c_custkey div 20") + 10000000000).cast("string")).alias("tax_id"), F.concat(F.lit("City "), (k % 90).cast("string")).alias("city"), F.lit("it").alias("country"),
    )


def contact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Contacts made from the customers."""
    return K.contact_duplicates(_contacts(spark, d))


def best_contact_duplicate(spark: SparkSession, d: str) -> DataFrame:
    return K.best_duplicate(K.contact_duplicates(_contacts(spark, d)))


def contact_keys(spark: SparkSession, d: str) -> DataFrame:
    return K.contact_keys(_contacts(spark, d)).select("id", "name", "company", "email", "phone", "site", "tax", F.coalesce("mail_site", F.lit("")).alias("mail_site"))


_KEYS = """
WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m FROM customer)
SELECT k AS id, ['anna', 'marco', 'lucia', 'jurgen', 'chloe', 'paul', 'marta'][(k // 3) % 7 + 1] || 'rossi' || (k // 2) % 211 AS name, lower(m) || CASE WHEN k % 2 = 0 THEN 'srl' ELSE '' END AS company,
 CASE k % 4 WHEN 0 THEN 'info@firm' || k % 50 || '.example' WHEN 1 THEN 'p' || k // 9 || '@gmail.com' ELSE '' END AS email, CASE WHEN k % 3 < 2 THEN '02' || (k // 6 + 1000000) ELSE '' END AS phone,
 CASE WHEN k % 5 = 0 THEN 'firm' || k % 40 || '.example' ELSE '' END AS site, CASE WHEN k % 10 = 0 THEN (k // 20 + 10000000000)::VARCHAR ELSE '' END AS tax, CASE WHEN k % 4 = 0 THEN 'firm' || k % 50 || '.example' ELSE '' END AS mail_site FROM c
"""


# All pairs of contacts, by the rules written out for these contacts: no pages, images or addresses.
_BOX = "split_part({0}, '@', 1) = 'info'"
_LIKE = "CASE WHEN a.{0} = '' OR b.{0} = '' THEN 0 ELSE 1 - levenshtein(a.{0}, b.{0}) / greatest(length(a.{0}), length(b.{0})) END"
_SAME = "(a.{0} <> '' AND a.{0} = b.{0})"
_HITS = [
    ("email_same", 72, "strong", "same_email AND NOT generic"), ("email_generic", 18, "medium", "same_email AND generic AND same_name AND NOT apart"), ("email_ocr", 58, "strong", "near_email AND NOT same_email AND NOT apart AND same_name AND (same_company OR same_site) AND NOT box_a AND NOT box_b"),
    ("phone_same", 65, "strong", "same_phone AND NOT apart"), ("phone_ocr", 52, "strong", "ocr"), ("tax_id_same", 80, "strong", "same_tax"), ("domain_person", 55, "strong", "same_site AND same_name AND NOT apart"), ("name_exact", 30, "medium", "same_name"),
    ("name_fuzzy", 22, "medium", "NOT same_name AND NOT apart AND like_name >= 0.78"), ("company_exact", 16, "medium", "same_company"), ("company_fuzzy", 12, "medium", "NOT same_company AND like_company >= 0.76"), ("city_same", 10, "medium", "same_city"),
    ("domain_same", 8, "weak", "dom"), ("phone_suffix", 28, "medium", "dom AND NOT same_phone AND NOT ocr AND NOT apart AND suffix"), ("country_same", 3, "weak", "true"),
]
_any = lambda *names: "(" + " OR ".join(f"h_{n}" for n in names) + ")"
_PAIRS = f"""
WITH k AS ({_KEYS}),
 n AS (SELECT k.*, left(name, position('rossi' IN name) - 1) AS first, substr(name, position('rossi' IN name)) AS last, 'city' || id % 90 AS city, 2 + (company <> '')::INT + (email <> '')::INT + (phone <> '')::INT + (site <> '')::INT + (tax <> '')::INT AS fields FROM k),
 p AS (SELECT a.id, b.id AS other, {', '.join(_SAME.format(c) + ' AS same_' + c for c in ('name', 'company', 'email', 'phone', 'site', 'tax', 'city'))}, {_LIKE.format('name')} AS like_name, {_LIKE.format('company')} AS like_company,
  {_LIKE.format('first')} < 0.58 OR {_LIKE.format('last')} < 0.68 AS apart, {_BOX.format('a.email')} AS box_a, {_BOX.format('b.email')} AS box_b, {_SAME.format('site')} OR (a.mail_site <> '' AND a.mail_site = b.mail_site) AS dom, least(a.fields, b.fields) AS fields,
  length(a.phone) >= 9 AND length(b.phone) >= 9 AND a.phone <> b.phone AND right(a.phone, 7) = right(b.phone, 7) AS suffix, length(a.phone) >= 9 AND length(b.phone) >= 9 AND levenshtein(a.phone, b.phone) = 1 AS one_off,
  a.email <> '' AND b.email <> '' AND ((split_part(a.email, '@', 2) = split_part(b.email, '@', 2) AND least(length(split_part(a.email, '@', 1)), length(split_part(b.email, '@', 1))) >= 4 AND levenshtein(split_part(a.email, '@', 1), split_part(b.email, '@', 1)) = 1)
   OR (split_part(a.email, '@', 1) = split_part(b.email, '@', 1) AND least(length(split_part(a.email, '@', 2)), length(split_part(b.email, '@', 2))) >= 5 AND levenshtein(split_part(a.email, '@', 2), split_part(b.email, '@', 2)) = 1)) AS near_email,
  NOT (a.name = b.name AND a.company = b.company AND a.email = b.email AND a.phone = b.phone AND a.tax = b.tax) AS core FROM n a JOIN n b ON a.id < b.id),
 q AS (SELECT *, box_a AS generic, NOT same_phone AND NOT apart AND same_name AND (same_company OR dom) AND (suffix OR one_off) AS ocr FROM p),
 h AS (SELECT *, {', '.join(f'{rule} AS h_{n}' for n, _, _, rule in _HITS)} FROM q),
 s AS (SELECT *, {_any(*(n for n, _, kind, _ in _HITS if kind == 'strong'))} AS strong, {_any('email_generic', 'company_exact', 'company_fuzzy', 'city_same', 'phone_suffix')} AS medium, h_email_same::INT + h_phone_same::INT + h_tax_id_same::INT AS eligible,
  greatest(0, least(100, {' + '.join(f'{v} * h_{n}::INT' for n, v, _, _ in _HITS)} - CASE WHEN apart AND h_email_same THEN 16 ELSE 0 END)) AS score, concat_ws(',', {', '.join(f"CASE WHEN h_{n} THEN '{n}' END" for n, _, _, _ in _HITS)}) AS signals FROM h),
 t AS (SELECT id, other, score, signals, CASE WHEN NOT strong AND (fields <= 1 OR (h_name_fuzzy AND NOT medium AND NOT h_phone_suffix) OR NOT {_any('name_exact', 'name_fuzzy', 'phone_suffix')}) THEN NULL
  WHEN NOT core AND ((eligible >= 2 AND NOT apart) OR (h_name_exact AND h_company_exact AND eligible > 0)) THEN 'exact' WHEN strong THEN 'probable' WHEN score >= 28 THEN 'possible' END AS tier FROM s)
SELECT id, other, tier, score, signals FROM t WHERE tier IS NOT NULL
"""
_BEST = f"""
WITH d AS ({_PAIRS}), s AS (SELECT id, other, tier, score FROM d UNION ALL SELECT other, id, tier, score FROM d),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE tier WHEN 'exact' THEN 3 WHEN 'probable' THEN 2 ELSE 1 END DESC, score DESC, other) AS k FROM s)
SELECT id, other, tier, score FROM r WHERE k = 1
"""


def domain_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", T.domain_key(F.col("url")).alias("domain"))


_DOMAIN = r"WITH p AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^www\.', '') AS u FROM pages), q AS (SELECT page_id, regexp_replace(regexp_extract(u, '^[^/?#\s]*'), ':\d+$', '') AS h FROM p) SELECT page_id, CASE WHEN regexp_matches(h, '^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$') THEN h ELSE '' END AS domain FROM q"


def email_phone_extract(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({T.EMAIL})")), F.lower)).alias("e"), F.regexp_extract_all("text", F.lit(f"({T.PHONE})")).alias("p"))
    return docs.filter("size(e) > 0 OR size(p) > 0").select("doc_id", F.array_join(F.array_sort("e"), ",").alias("emails"), F.array_join(F.transform("p", T.phone_key), ",").alias("phones"))


_EXTRACT = r"""
WITH x AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'), lambda e: lower(e)))) AS e, regexp_extract_all(text, '\+?\d[\d ()./-]{6,}\d') AS p FROM documents),
 y AS (SELECT doc_id, e, list_transform(p, lambda v: {'plus': starts_with(v, '+'), 'd': regexp_replace(v, '\D', '', 'g')}) AS p FROM x WHERE len(e) > 0 OR len(p) > 0),
 z AS (SELECT doc_id, e, list_transform(p, lambda v: {'abroad': v.plus OR starts_with(v.d, '00'), 'd': CASE WHEN starts_with(v.d, '00') THEN substr(v.d, 3) ELSE v.d END}) AS p FROM y)
SELECT doc_id, array_to_string(e, ',') AS emails, array_to_string(list_transform(p, lambda v: CASE WHEN v.abroad AND starts_with(v.d, '39') AND length(v.d) BETWEEN 11 AND 13 THEN substr(v.d, 3) ELSE v.d END), ',') AS phones FROM z
"""


def page_first_last_merge(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as pages of a document."""
    c = _t(spark, d, "conversations")
    rows = c.select("conv_id", "turn", F.when(F.col("role") == "user", F.md5("text")).alias("first_user"), F.when(F.length("text") > 40, F.length("text")).alias("last_long"))
    return G.first_last(rows, "conv_id", F.struct("turn", "first_user", "last_long"), ["first_user"], ["last_long"])


_FIRST_LAST = "WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN md5(text) END AS f, CASE WHEN length(text) > 40 THEN length(text)::INT END AS l FROM conversations) SELECT conv_id, (list(f ORDER BY turn, f, l) FILTER (f IS NOT NULL))[1] AS first_user, (list(l ORDER BY turn DESC, f DESC NULLS LAST, l DESC) FILTER (l IS NOT NULL))[1] AS last_long FROM c GROUP BY conv_id"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select("user_id", "event_type", (F.floor(F.col("value") / 50) / 2).alias("value"), (F.col("event_id") % 3 + F.col("event_id") % 2).cast("int").alias("validation"), F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 10) / 10).alias("confidence"), F.lit("local").alias("method"), F.col("event_id").alias("page"))


def field_argmax_merge(spark: SparkSession, d: str) -> DataFrame:
    """Events as candidates for a field of a document."""
    return G.best_candidate(_candidates(spark, d), ["user_id", "event_type"])


_ARGMAX = """
WITH c AS (SELECT user_id, event_type, floor(value / 50) / 2 AS value, (event_id % 3 + event_id % 2)::INT AS v, CASE WHEN event_id % 4 > 0 THEN (event_id % 10) / 10.0::DOUBLE END AS f, event_id AS page FROM events),
 r AS (SELECT *, row_number() OVER w AS k, count(*) OVER g AS n, min(value) OVER g AS lo, max(value) OVER g AS hi, max(v) OVER g AS mv, max(f) OVER g AS mf, count(f) OVER g AS nf FROM c
   WINDOW g AS (PARTITION BY user_id, event_type), w AS (PARTITION BY user_id, event_type ORDER BY v DESC, coalesce(f, -1) DESC, value, page)),
 b AS (SELECT * FROM r WHERE k = 1),
 o AS (SELECT r.user_id, r.event_type, max(r.v) AS ov, max(r.f) AS ofx FROM r WHERE k > 1 GROUP BY ALL)
SELECT user_id, event_type, value, page, n, NOT (hi - value < 0.005 AND value - lo < 0.005) AS conflict,
 CASE WHEN n = 1 THEN 'single_candidate' WHEN hi - value < 0.005 AND value - lo < 0.005 THEN 'same_value_repeated' WHEN v > ov THEN 'stronger_validation' WHEN nf = n AND f > ofx THEN 'higher_reported_confidence' ELSE 'deterministic_conflict_tiebreak' END AS reason
FROM b LEFT JOIN o USING (user_id, event_type)
"""


def reconcile_sources(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("m"))
    local = e.filter("m % 3 < 2").select("user_id", "event_type", F.col("n").alias("value"))
    remote = e.filter("m % 3 > 0").select("user_id", "event_type", (F.col("n") + F.col("m") % 2).alias("value"))
    return G.reconcile_sources(local, remote, ["user_id", "event_type"])


_RECONCILE = """
WITH e AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS m FROM events GROUP BY ALL),
 x AS (SELECT user_id, event_type, CASE WHEN m % 3 < 2 THEN n END AS l, CASE WHEN m % 3 > 0 THEN n + m % 2 END AS r FROM e)
SELECT user_id, event_type, coalesce(l, r) AS value, CASE WHEN r IS NULL THEN 'local_only' WHEN l IS NULL THEN 'remote_only' WHEN l = r THEN 'agreed' ELSE 'conflict' END AS status FROM x
"""


def field_changes(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    new = c.select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    old = c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return G.field_changes(old, new, "c_custkey", ["c_name", "c_mktsegment"]).groupBy("field", "change").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


_CHANGES = """
WITH x AS (SELECT c_custkey, 'c_name' AS field, c_name AS b, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS a FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END FROM customer)
SELECT field, CASE WHEN b IS NOT DISTINCT FROM a THEN 'unchanged' WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'protected' ELSE 'selectable' END AS change, count(*) AS n, min(c_custkey) AS first_key FROM x GROUP BY ALL
"""


def reading_vote(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", F.lit("click").alias("observed"), F.col("event_type").alias("value"))
    return G.vote(e, "user_id", "observed", "value", 14)


_VOTE = """
WITH n AS (SELECT user_id, event_type AS v, count(*) AS n FROM events GROUP BY ALL),
 g AS (SELECT user_id, coalesce(max(n) FILTER (v = 'click'), 0) AS own, count(*) FILTER (n >= 14 AND v <> 'click') AS r, min(v) FILTER (n >= 14 AND v <> 'click') AS rv FROM n GROUP BY user_id)
SELECT user_id, CASE WHEN own < 14 AND r = 1 THEN rv ELSE 'click' END AS selected, own < 14 AND r = 1 AS changed FROM g
"""


def brand_repetitions(spark: SparkSession, d: str) -> DataFrame:
    l = _t(spark, d, "lineitem")  # noqa: E741
    return G.repeated_elsewhere(l.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), "l_suppkey", "l_linenumber", F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber", "elsewhere")


_BRAND = "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) - count(*) OVER (PARTITION BY l_suppkey, l_linenumber) AS elsewhere FROM lineitem WHERE l_quantity > 45"


def agreement_fold(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).select("user_id", "event_type", "value", F.coalesce("confidence", F.lit(0.5)).alias("score"))
    return G.fold_agreement(c, ["user_id", "event_type"], "value", "score").groupBy("user_id").agg(F.count("*").alias("n_values"), F.max(M.cents(F.col("score"))).alias("best"))


_FOLD = "WITH c AS (SELECT user_id, event_type, floor(value / 50) / 2 AS value, CASE WHEN event_id % 4 > 0 THEN (event_id % 10) / 10.0::DOUBLE ELSE 0.5 END AS s FROM events), g AS (SELECT user_id, event_type, value, least(1.0, max(s) + 0.05 * (count(*) - 1)) AS s FROM c GROUP BY ALL) SELECT user_id, count(*) AS n_values, max(CAST(floor(s * 100 + 0.5) AS BIGINT)) AS best FROM g GROUP BY user_id"


def best_attempt(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", "event_id", F.floor(F.col("value") / 100).alias("score"))
    return G.best_attempt(e, "user_id", "event_id", "score")


_ATTEMPT = "WITH e AS (SELECT user_id, event_id, floor(value / 100)::BIGINT AS score, row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 100) DESC, event_id) AS k FROM events) SELECT user_id, event_id, score FROM e WHERE k = 1"

QUERIES = {
    f.__name__: f
    for f in (duplicate_groups, duplicate_keep_policy, possible_duplicates_2of3, document_matches, fuzzy_name_pairs, contact_duplicates, best_contact_duplicate, contact_keys, domain_normalize, email_phone_extract, page_first_last_merge, field_argmax_merge, reconcile_sources, field_changes, reading_vote, brand_repetitions, agreement_fold, best_attempt)
}
ORACLES = {
    "duplicate_groups": _GROUPS, "duplicate_keep_policy": _NEWEST, "possible_duplicates_2of3": _TWO_OF_THREE, "document_matches": _MATCHES, "fuzzy_name_pairs": _FUZZY, "contact_keys": _KEYS, "contact_duplicates": _PAIRS, "best_contact_duplicate": _BEST, "domain_normalize": _DOMAIN, "email_phone_extract": _EXTRACT,
    "page_first_last_merge": _FIRST_LAST, "field_argmax_merge": _ARGMAX, "reconcile_sources": _RECONCILE, "field_changes": _CHANGES, "reading_vote": _VOTE, "brand_repetitions": _BRAND, "agreement_fold": _FOLD, "best_attempt": _ATTEMPT,
}
