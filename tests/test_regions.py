"""Regions and zones of lines against plain state machines."""

import random

from pyspark.sql import functions as F

from foliant.functions.regions import region_of
from foliant.operators import regions as R

KINDS = {"": None, "oggetto": "subject", "cliente": "customer", "acme ltd": "issuer", "totale": "totals", "iva": "tax_summary", "numero": "metadata", "iban": "payment", "qty descrizione prezzo": "items_table", "remarques": "notes", "x": None}


def zone_loop(lines):
    """(kind, reason) of lines (text, header, body, center)."""
    table, context, out = False, 0, []
    for text, header, body, center in lines:
        found = "items_table" if header or body else KINDS[text]
        if found in R.ENDS_CUSTOMER:
            context = 0
        own = "customer" if context > 0 and found in (None, "issuer") else found
        if own == "items_table":
            table = True
        if own in R.ENDS_TABLE:
            table = False
        if own == "customer":
            context = 4
        place = "header" if center <= 0.16 else "footer" if center >= 0.84 else "unknown"
        out.append(own or ("items_table" if table else place))
        context = max(0, context - 1)
    return out


def test_zones(spark):
    r = random.Random(3)
    pages = {p: [(r.choice([*KINDS, "oggetto", "", "x", "acme ltd"]), r.random() < 0.04, r.random() < 0.04, r.random()) for _ in range(r.randint(1, 40))] for p in range(150)}
    rows = spark.createDataFrame([(p, k, *x) for p, xs in pages.items() for k, x in enumerate(xs)], "page long, at long, text string, h boolean, b boolean, c double")
    found = R.classify_lines(rows, ["page"], ["at"], "text", F.col("h"), F.col("b"), F.col("c"))
    got = {}
    for x in sorted(found.collect(), key=lambda x: (x.page, x["at"])):
        got.setdefault(x.page, []).append(x.kind)
    assert got == {p: zone_loop(xs) for p, xs in pages.items()}


def test_null_lines(spark):
    rows = spark.createDataFrame([(1, 1, "cliente", None), (1, 2, None, None), (None, 1, None, "header")], "doc long, at long, text string, zone string")
    kinds = {(x.doc, x["at"]): (x.kind, x.requires_review) for x in R.classify_lines(rows, ["doc"], ["at"]).collect()}
    assert kinds == {(1, 1): ("customer", False), (1, 2): ("customer", True), (None, 1): ("unknown", True)}
    assert {x.region for x in R.annotate_regions(rows, ["doc"], ["at"]).collect()} == {"customer_block", "unknown"}
    assert R.annotate_regions(rows.limit(0), ["doc"], ["at"]).count() == R.classify_lines(rows.limit(0), ["doc"], ["at"]).count() == 0


def test_a_recap_goes_on(spark):
    texts = [("Riepilogo IVA", None), ("22 %", None), ("Gesamtbetrag 5", None), ("rest", "footer"), ("Descrizione", None), ("rest", None), ("RÉSUMÉ", None), ("IBAN", None), ("wood", "items_table"), ("wood", None)]
    rows = spark.createDataFrame([(1, k, *x) for k, x in enumerate(texts)], "doc long, at long, text string, zone string")
    found = [x.region for x in R.annotate_regions(rows, ["doc"], ["at"]).orderBy("at").collect()]
    assert found == ["tax_recap", "tax_recap", "document_totals", "tax_recap", "commercial_table_header", "unknown", "historical_recap", "payment_terms", "commercial_table_body", "unknown"]


def test_words(spark):
    texts = ["DIRECCIÓN DE ENTREGA", "Facturé à", "DÉSIGNATION", "Désignation of a line that is far longer than a heading of columns", "a reporter", "    ", "Nothing"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [x.r for x in rows.select(region_of(F.col("t"), F.lit(None).cast("string"))["region"].alias("r")).collect()]
    assert found == ["ship_to_block", "customer_block", "commercial_table_header", "unknown", "table_subtotal", "unknown", "unknown"]
