"""Readers of nested records: JSON blobs, JSON within text, vCards, plain text as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_records(spark: SparkSession, path: str, schema: StructType | str, data: str = "data", kind: str | None = None) -> DataFrame:
    """Records of a table (id, type, updated_at, data JSON), unreadable ones left out; ``kind`` is pushed to the scan."""
    rows = spark.read.parquet(path)
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    parsed = rows.withColumn("record", F.from_json(F.col(data), schema, {"mode": "PERMISSIVE"}))
    some = F.exists(F.map_values(F.from_json(F.col(data), "map<string,string>")), lambda v: v.isNotNull())
    return parsed.filter(F.coalesce(some, F.lit(False))).drop(data)


def json_in_text(text: Column, schema: str) -> Column:
    """The outermost JSON object within a text, parsed; null if there is none or it is broken."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.from_json(body, schema))


def vcard_fields(payload: Column) -> Column:
    """map(property -> values) of a vCard: folded lines joined, parameters dropped, escapes undone."""
    text = F.regexp_replace(F.regexp_replace(payload, "\r\n|\r", "\n"), "\n[ \t]", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.instr(x, ":") > 0)
    undo = lambda v: F.replace(F.replace(F.replace(F.replace(F.replace(F.replace(v, F.lit("\\\\"), F.lit("\u0001")), F.lit("\\n"), F.lit("\n")), F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";")), F.lit("\\:"), F.lit(":")), F.lit("\u0001"), F.lit("\\"))
    pairs = F.transform(lines, lambda x: F.struct(F.upper(F.regexp_extract(x, r"^(?:[A-Za-z0-9]+\.)?([A-Za-z-]+)", 1)).alias("k"), undo(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]).alias("value"))))


def mecard_fields(payload: Column) -> Column:
    """map(property -> value) of a MECARD string."""
    body = F.regexp_extract(payload, r"(?iu)^MECARD:(.*?);?;?$", 1)
    return F.str_to_map(body, F.lit(";"), F.lit(":"))


def overlay(base: DataFrame, better: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``base`` with the values that ``better`` has for the fields."""
    b = better.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return base.join(b, key, "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*[f"__{f}" for f in fields])
