"""Fields and ordered rows: odd rows, and the order-bound operators against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import documents as K
from foliant.functions import fields as C
from foliant.operators import ordered as O


def test_nulls_stay_nulls(spark):
    x = F.lit(None).cast("string")
    row = spark.range(1).select(
        C.strict_amount(x).alias("a"), C.quantity_cell(x).alias("q"), C.line_total(x, F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)).alias("t"), C.repaired_day(x).alias("r"), C.day_only(x).alias("d"), C.stored_day(x).alias("s"),
        C.clean_text(x).alias("c"), C.province(x).alias("p"), C.country_code(x).alias("k"), C.first_email(x).alias("e"), C.focused_email(x, x)["selected"].alias("f"),
    ).first()
    assert all(v is None for v in row)


@pytest.mark.parametrize("n, first, last", [(3, [1, 2, 3], 3), (30, [1, 2], 30), (50, [1, 2], 34), (200, [1, 2], 64)])
def test_scan_order(spark, n, first, last):
    rows = spark.range(1, n + 1).select(F.lit("d").alias("doc"), F.col("id").alias("line"))
    found = [r["line"] for r in O.scan_order(rows, "doc", "line").orderBy("scan").collect()]
    kept = list(range(1, min(n, 80) + 1))
    tail = kept[max(24, len(kept) - 16) :]
    assert found == kept[:24] + tail + [x for x in kept[24:] if x not in tail]
    assert found[: len(first)] == first and found[-1] == last


def shipping_loop(rows):
    out = []
    for n, description, total in rows:
        about = description in ("porto", "freight")
        if out and about and out[-1][1] in ("porto", "freight"):
            last = out[-1][2]
            if total is None or last is None or abs(total - last) <= 0.05:
                if last is None and total is not None:
                    out[-1] = (n, description, total)
                continue
        out.append((n, description, total))
    return out


def test_repeated_shipping(spark):
    r = random.Random(5)
    docs = {d: [(n, r.choice(["porto", "freight", "freight", "wood"]), r.choice([None, 1.0, 1.04, 1.08, 3.0])) for n in range(r.randint(1, 12))] for d in range(60)}
    rows = spark.createDataFrame([(d, *x) for d, xs in docs.items() for x in xs], "doc long, n long, description string, total double")
    found = sorted((x.doc, x.n, x.description, x.total) for x in O.drop_repeated_shipping(rows, ["doc"], "n").collect())
    assert found == sorted((d, *x) for d, xs in docs.items() for x in shipping_loop(xs))
    assert O.drop_repeated_shipping(rows.limit(0), ["doc"], "n").count() == 0


def continued_loop(rows):
    out, gone = [], set()
    for i, (n, text, unfit) in enumerate(rows):
        out.append([n, text.strip()])
        before = rows[i - 1] if i else None
        if before and text.strip().startswith("e ") and i - 1 not in gone and 1 <= len(before[1].split()) <= 6 and not before[2]:
            gone.add(i)
            out[i - 1][1] += " " + text.strip()
    return [(n, t) for i, (n, t) in enumerate(out) if i not in gone]


def test_continued_lines(spark):
    r = random.Random(6)
    texts = ["e figli", "Rossi", "e C.", "", "uno due tre quattro cinque sei sette"]
    docs = {d: [(n, r.choice(texts), r.random() < 0.2) for n in range(r.randint(1, 12))] for d in range(60)}
    rows = spark.createDataFrame([(d, *x) for d, xs in docs.items() for x in xs], "doc long, n long, text string, unfit boolean")
    found = sorted((x.doc, x.n, x.text) for x in O.join_continued(rows, ["doc"], "n", "text", F.col("unfit")).collect())
    assert found == sorted((d, *x) for d, xs in docs.items() for x in continued_loop(xs))


def test_leases_are_given_back_once(spark):
    leases = spark.createDataFrame([("a",), ("b",), (None,)], "lease string")
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c"), (4, None)], "at long, lease string")
    found = {x["at"]: x["released"] for x in O.give_back(leases, asked, "lease", "at").collect()}
    assert found == {1: True, 2: False, 3: False, 4: False}


def test_documents_without_values(spark):
    x, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    row = spark.range(1).select(
        K.strict_day(x, F.lit(None).cast("boolean"))["status"].alias("day"), K.may_apply(x, F.lit(None).cast("boolean")).alias("applies"), K.is_item(x, x, none, none, none).alias("item"), K.is_no_item(x).alias("no_item"),
        K.schema_score(F.array().cast("array<struct<kind:string,x:double>>"))["confidence"].alias("schema"), K.safe_emails(F.lit(None).cast("array<string>"), F.lit(None).cast("array<struct<value:string,status:string,review:boolean,confirmed:boolean,origin:string>>")).alias("emails"),
    ).first()
    assert tuple(row) == ("missing", False, False, True, "weak", [])


def test_accented_capitals(spark):
    texts = ["VALIDITÀ OFFERTA 30 GG", "validità offerta 30 gg", "TOTAL 3 AÑOS", "ÜBERTRAG", "Übertrag", "Q.TÀ", "q.tà"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    kept = [r.t for r in rows.filter(K.is_item(F.col("t"), F.lit(None).cast("string"), F.lit(1.0), F.lit(None).cast("double"), F.lit(None).cast("double")) & ~K.is_no_item(F.col("t"))).collect()]
    assert kept == []
    places = spark.createDataFrame([("Via Roma 1, ESPAÑA",), ("VIA ROMA, LOCALITÀ PIANO",), ("LOCALITÀ PIANO",), ("Taichung, via Roma",), ("Via Roma 1",)], "t string")
    assert [r.i for r in places.select(C.is_italian_address(F.col("t"), F.lit("")).alias("i")).collect()] == [False, True, True, False, True]
    names = ["India", "CHINA", "Côte d’Ivoire", "Bosnia-Herzegovina", "España", "Österreich", "Republic of Korea", "P.R. China", None]
    codes = [r.k for r in spark.createDataFrame([(n,) for n in names], "t string").select(C.country_code(F.col("t")).alias("k")).collect()]
    assert codes == ["IN", "CN", "CI", "BA", "ES", "AT", "KR", None, None]
