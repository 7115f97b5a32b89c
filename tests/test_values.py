"""Amounts, dates, text keys, reconciliation and tables: the cases that the rules are about."""

import pytest
from foliant.functions import money as M
from foliant.functions import parsing as P
from foliant.functions import text as T
from foliant.operators import lists as L
from foliant.operators import merging as G
from foliant.operators import money as O
from foliant.operators import tables as B
from pyspark.sql import functions as F


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "value", "currency", "ambiguous"),
    [
        ("1.234,56", 1234.56, None, False), ("1,234.56 USD", 1234.56, "USD", False), ("1.234", 1234.0, None, True), ("€ 1.234", 1234.0, "EUR", False), ("12,5", 12.5, None, False), ("1'234.50", 1234.5, None, False),
        ("12 345,60", 12345.6, None, False), ("-3,00", -3.0, None, False), ("−3,00", -3.0, None, False), ("23/05/2025", None, None, False), ("1,00 2,00", None, None, False), ("60,00 0", 60.0, None, False), ("1.234.567", 1234567.0, None, False), ("12 34 56", None, None, False), ("abc", None, None, False), ("", None, None, False), (None, None, None, None),
    ],
)
def test_amounts(spark, text, value, currency, ambiguous):
    r = one(spark, M.parse_amount, text)
    if text is None:
        assert r is None or r.value is None
    else:
        assert (r.value, r.currency, bool(r.ambiguous)) == (value, currency, ambiguous)


def test_language_settles_groups(spark):
    assert not one(spark, lambda x: M.parse_amount(x, F.lit("it")), "1.234").ambiguous


@pytest.mark.parametrize(
    ("text", "language", "day", "ambiguous", "n"),
    [("2024-02-30", None, None, False, 0), ("2024-2-9", None, "2024-02-09", False, 0), ("03/04/2024", None, None, True, 2), ("03/04/2024", "de", "2024-04-03", True, 2), ("03/04/2024", "en", None, True, 2), ("31.12.2024", None, "2024-12-31", False, 1), ("5/5/2024", None, "2024-05-05", False, 1), ("12 août 2023", None, "2023-08-12", False, 0), ("3 de marzo de 2020", None, "2020-03-03", False, 0), ("no date", None, None, False, 0)],
)
def test_dates(spark, text, language, day, ambiguous, n):
    r = one(spark, lambda x: M.parse_date(x, F.lit(language).cast("string")), text)
    assert (r.value, r.ambiguous, len(r.alternatives)) == (day, ambiguous, n)


def test_keys(spark):
    assert one(spark, T.fold, "ÀÉßØ éñ") == "aeßø en"
    assert one(spark, T.company_key, "Acme, S.r.l. & Co GmbH") == "acmesrl"
    assert [one(spark, T.phone_key, x) for x in ("+39 02 1234567", "0039021234567", "02/1234567", "+49 30 123")] == ["021234567", "021234567", "021234567", "4930123"]
    assert [one(spark, T.domain_key, x) for x in ("https://www.Acme.it:80/x?y", "info@acme.it", "acme", None)] == ["acme.it", "acme.it", "", ""]
    assert one(spark, T.document_number_key, " 12 / A ") == "12/a"
    assert one(spark, T.block_fingerprint, "b b\n\nA.a") == "aa|bb"
    assert one(spark, P.repair_digits, "CAP 2O1l9 Olio") == "CAP 20119 Olio"


def test_searches(spark):
    rows = spark.createDataFrame([("Café 12a",), ("tea",)], "x string")
    assert [rows.filter(L.matches(F.col("x"), q)).count() for q in ("cafe", "CAFÉ ", "zz", "2a", "a2")] == [1, 1, 2, 1, 0]


def test_reconciliation(spark):
    heads = spark.createDataFrame([(1, 30.0, 5.0, 5.0, 6.6, 36.6), (2, 35.0, None, None, 7.0, 43.0), (3, None, None, None, None, 5.0), (4, 99.0, None, None, 1.0, 100.0)], "doc_id int, subtotal double, discount_total double, shipping double, vat double, total double")
    lines = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 10.0), (2, 20.0), (4, None)], "doc_id int, line_total double")
    taxes = spark.createDataFrame([(1, 3.3), (1, 3.3), (2, 3.0), (2, 3.0)], "doc_id int, vat double")
    got = {r.doc_id: (r.conflicts, r.consistent) for r in O.reconcile(heads, lines, taxes).collect()}
    assert got == {1: ("", True), 2: ("line_sum_subtotal_mismatch,subtotal_vat_total_mismatch,tax_summary_vat_mismatch", False), 3: ("", True), 4: ("", True)}


def test_first_and_last(spark):
    pages = spark.createDataFrame([(1, 0, None, 5.0), (1, 1, "a", None), (1, 2, "b", 7.0), (2, 0, None, None)], "d int, p int, number string, total double")
    for frame in (pages, pages.repartition(3, "number")):
        assert sorted(map(tuple, G.first_last(frame, "d", F.col("p"), ["number"], ["total"]).collect())) == [(1, "a", 7.0), (2, None, None)]


def test_ordinals_and_batches(spark):
    frame = L.with_ordinal(spark.range(95).repartition(7), F.desc("id"))
    assert [(r.id, r.ordinal) for r in frame.orderBy("ordinal").collect()] == [(94 - i, i + 1) for i in range(95)]
    assert [(r.batch, r.first, r.last, r.n) for r in L.batches(frame).orderBy("batch").collect()] == [(1, 1, 30, 30), (2, 31, 60, 30), (3, 61, 90, 30), (4, 91, 95, 5)]
    assert L.with_ordinal(spark.range(0), F.desc("id")).count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ordinals_over_many_partitions(spark, adaptive):
    """The bounds between partitions are drawn from samples: every row must still have one ordinal."""
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(60_000).select((F.xxhash64("id") % 997).alias("k"), "id").repartition(120)
        r = L.with_ordinal(rows, F.asc("k"), F.asc("id"))
        assert r.agg(F.count("*"), F.countDistinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first() == (60_000, 60_000, 1, 60_000)
        assert [x.k for x in r.orderBy("ordinal").collect()] == sorted(x.k for x in rows.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_table(spark):
    cells = [(1, 0, 10.0, 5.0, "Description"), (1, 0, 100.0, 5.0, "Qty"), (1, 0, 200.0, 5.0, "Price"), (1, 0, 300.0, 5.0, "Amount"), (1, 0, 12.0, 60.0, "bolt"), (1, 0, 30.0, 61.0, "m4"), (1, 0, 110.0, 60.0, "3"), (1, 0, 305.0, 62.0, "7,50"), (1, 0, 900.0, 60.0, "99")]
    r = B.table_items(spark.createDataFrame(cells, "doc_id int, page int, x double, y double, text string")).collect()
    assert [(x.description, x.quantity, x.price, x.total) for x in r] == [("bolt m4", 3.0, 2.5, 7.5)]
