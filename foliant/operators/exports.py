"""Renderers of records: CSV cells, vCards, JSON, plain text; all are expressions over a row. Export rows of documents and their assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.documents import kind_label
from foliant.functions.fields import day_only

#: Byte-order mark and line end of CSV files for spreadsheets.
BOM, CRLF = "﻿", "\r\n"

# Fixed value: names of fields that are not for export.
INTERNAL_FIELD = r"(?iu)raw|confidence|evidence|debug|ocr|parser|review|coherence"


def csv_cell(value: Column) -> Column:
    """Always quoted, quotes doubled; null is an empty cell."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_row(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(v) for v in values])


def vcard_text(value: Column) -> Column:
    """Backslash, line breaks, semicolon and comma escaped."""
    v = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    v = F.regexp_replace(v, "\r\n|\n|\r", "\\\\n")
    return F.replace(F.replace(v, F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,"))


def vcard(first: Column, last: Column, company: Column, role: Column, emails: Column, phones: Column, website: Column, address: Column, notes: Column) -> Column:
    """vCard 3.0. emails: array of strings; phones: array of (number, type); blank fields give no line."""
    name = F.trim(F.concat_ws(" ", F.when(F.trim(first) != "", first), F.when(F.trim(last) != "", last)))
    e = lambda c: vcard_text(F.coalesce(c, F.lit("")))
    line = lambda head, c: F.when(F.trim(c) != "", F.concat(F.lit(head), vcard_text(F.trim(c))))

    def tel(p: Column) -> Column:
        kind = F.when(p["type"] == "mobile", ";TYPE=CELL").when(p["type"] == "work", ";TYPE=WORK").when(p["type"] == "fax", ";TYPE=FAX").otherwise("")
        return F.concat(F.lit("TEL"), kind, F.lit(":"), vcard_text(F.trim(p["number"])))

    lines = F.concat(
        F.array(F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.concat(F.lit("FN:"), e(name)), F.concat(F.lit("N:"), e(last), F.lit(";"), e(first), F.lit(";;;")), line("ORG:", company), line("TITLE:", role)),
        F.transform(F.coalesce(emails, F.array().cast("array<string>")), lambda m: F.concat(F.lit("EMAIL:"), vcard_text(m))),
        F.transform(F.filter(phones, lambda p: F.trim(p["number"]) != ""), tel),
        F.array(line("URL:", website), F.when(F.trim(address) != "", F.concat(F.lit("ADR:;;"), vcard_text(F.trim(address)), F.lit(";;;;"))), F.when(F.trim(notes) != "", F.concat(F.lit("NOTE:"), vcard_text(notes))), F.lit("END:VCARD")),
    )
    return F.concat(F.array_join(F.array_compact(lines), CRLF), F.lit(CRLF))


def file_token(value: Column) -> Column:
    """Safe in a file name, 48 characters at most."""
    v = F.regexp_replace(value, '[<>:"/\\\\|?*\\u0000-\\u001f.]+', "")
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\s+", "_"), "_+", "_"), "^_|_$", "")
    return F.left(v, F.lit(48))


def labelled(*pairs: tuple[str, Column]) -> Column:
    """'Label: value' lines of the values that are not blank."""
    return F.concat_ws("\n", *[F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{name}: "), v.cast("string"))) for name, v in pairs])


def decimal_text(value: Column, locale: str) -> Column:
    """Two decimals and grouped thousands: 1,234.50 (en) or 1.234,50 (it)."""
    text = F.format_number(value, 2)
    return text if locale == "en" else F.translate(text, ",.", ".,")


def day_text(day: Column, locale: str) -> Column:
    return F.date_format(day, "MM/dd/yyyy" if locale == "en" else "dd/MM/yyyy")


def time_text(at: Column, locale: str) -> Column:
    """Day and minute; an empty text for none."""
    return F.coalesce(F.concat(day_text(at, locale), F.lit(" "), F.date_format(at, "HH:mm")), F.lit(""))


def fingerprint(*columns: Column) -> Column:
    """sha-256 of a row's canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def document_rows(docs: DataFrame, locale: str = "it") -> DataFrame:
    """The twenty columns of a document's export row. A field that the document's kind has not is an empty text or no amount."""
    kind, blank = F.col("kind"), F.lit("")
    text = lambda c: F.coalesce(F.trim(c), blank)
    commercial = kind.isin("quote", "order", "invoice")
    only = lambda k, c: F.when(kind == k, text(F.col(c))).otherwise(blank)
    day = lambda k, c: F.when(kind == k, F.coalesce(day_text(F.col(c), locale), blank)).otherwise(blank)
    money = {c: F.when(commercial, F.col(c)).alias(c) for c in ("subtotal", "vat_amount", "total")}
    fields = F.filter(F.map_entries("fields"), lambda e: (F.trim(e["value"]) != "") & ~e["key"].rlike(INTERNAL_FIELD))
    summary = F.array_join(F.transform(fields, lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"]))), "; ")
    return docs.select(
        "doc_id", kind_label(kind, locale).alias("type"), text(F.col("title")).alias("title"), text(F.col("number")).alias("number"), F.coalesce(day_text(F.col("day"), locale), blank).alias("date"),
        day("quote", "valid_until").alias("valid_until"), day("order", "delivery_day").alias("delivery_date"), day("invoice", "due_day").alias("due_date"),
        F.when(commercial, text(F.col("customer"))).otherwise(blank).alias("customer_name"), F.when(commercial, text(F.col("customer_vat"))).otherwise(blank).alias("customer_vat"),
        only("free_document", "subject").alias("subject"), only("order", "shipping_address").alias("shipping_address"), money["subtotal"], blank.alias("vat_rate"), money["vat_amount"], money["total"],
        F.when(commercial, F.upper(text(F.col("currency")))).otherwise(blank).alias("currency"), text(F.col("notes")).alias("notes"), F.when(kind == "free_document", F.coalesce(summary, blank)).otherwise(blank).alias("extracted_summary"),
        time_text(F.col("created_at"), locale).alias("created_at"), time_text(F.col("updated_at"), locale).alias("updated_at"),
    )


def summary_rows(rows: DataFrame) -> DataFrame:
    """The eleven header columns of ``document_rows``."""
    return rows.select("doc_id", "type", "number", "title", "date", "customer_name", F.lit("").alias("supplier"), "subtotal", "vat_rate", "vat_amount", "total", "currency")


def detail_rows(rows: DataFrame) -> DataFrame:
    """The twelve detail columns of ``document_rows``, and whether one of them but the document's own says anything."""
    told = F.concat("valid_until", "delivery_date", "due_date", "customer_vat", "subject", "shipping_address", "notes", "extracted_summary") != ""
    return rows.select("doc_id", "type", "number", "valid_until", "delivery_date", "due_date", "customer_vat", "subject", "shipping_address", "notes", "extracted_summary", "created_at", "updated_at", told.alias("told"))


def with_days(df: DataFrame, *columns: str) -> DataFrame:
    """The columns as 'yyyy-MM-dd', whether they held days or instants."""
    return df.withColumns({c: day_only(F.col(c)) for c in columns})


def live_assets(tables: dict[str, DataFrame], key: str, images: str) -> DataFrame:
    """(owner, key, asset): a row for each image that a row of one of the tables holds."""
    parts = [t.select(F.lit(name).alias("owner"), F.col(key).alias(key), F.explode(images).alias("asset")) for name, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
