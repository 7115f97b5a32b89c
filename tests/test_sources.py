"""Readers of nested records."""

from foliant.sources import records as R
from pyspark.sql import functions as F


def test_records(spark, tmp_path):
    rows = [("a", "quote", '{"number": "1", "total": 2.5}'), ("b", "quote", "{broken"), ("c", "order", '{"number": "3"}'), ("d", "quote", None)]
    spark.createDataFrame(rows, "id string, type string, data string").write.parquet(str(tmp_path / "x"))
    got = R.read_records(spark, str(tmp_path / "x"), "number string, total double", kind="quote")
    assert [(r.id, r.record.number, r.record.total) for r in got.collect()] == [("a", "1", 2.5)]
    assert "EqualTo(type,quote)" in got._jdf.queryExecution().toString()


def test_json_in_text(spark):
    rows = spark.createDataFrame([('x {"a": 1} y',), ("none",), (None,)], "x string").select(R.json_in_text(F.col("x"), "a int").alias("j"))
    assert [r.j and r.j.a for r in rows.collect()] == [1, None, None]


def test_cards(spark):
    card = "BEGIN:VCARD\r\nFN:Anna\r\n  Rossi\r\nTEL;TYPE=CELL:1\r\nTEL:2\r\nORG:A\\, B\\;C\\\\D\r\nEND:VCARD\r\n"
    m = spark.createDataFrame([(card,)], "x string").select(R.vcard_fields(F.col("x")).alias("m")).first().m
    assert (m["FN"], m["TEL"], m["ORG"]) == (["Anna Rossi"], ["1", "2"], ["A, B;C\\D"])
    e = spark.createDataFrame([("MECARD:N:Rossi,Anna;TEL:1;;",)], "x string").select(R.mecard_fields(F.col("x")).alias("m")).first().m
    assert (e["N"], e["TEL"]) == ("Rossi,Anna", "1")
