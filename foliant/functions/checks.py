"""Checks on fields that were read: totals that contradict each other, cells of rates, phone lists, labels, line geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.money import let
from foliant.functions.text import fold

# Cents within which amounts agree, VAT rates, country words by ISO code.
CENT = 0.05
VAT_RATES = [4, 5, 10, 19, 20, 21, 22, 23]
COUNTRY_WORDS = {
    "TW": r"\btaiwan\b",
    "PK": r"\bpakistan\b|\bsialkot\b",
    "BE": r"\bbelgium\b|\bbelgique\b",
    "DE": r"\bgermany\b|\bdeutschland\b",
    "FR": r"\bfrance\b",
    "IE": r"\bireland\b|\birlanda\b",
    "IT": r"\bitaly\b|\bitalia\b",
}


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= CENT


def checked_vat(vat: Column, subtotal: Column, total: Column) -> Column:
    """struct(vat, rejected): a VAT amount found later stands only if it fits the subtotal and total that are there."""
    both = subtotal.isNotNull() & total.isNotNull() & (F.abs(vat) > CENT)
    why = F.when(both & _near(subtotal, total), "vat_conflicts_with_zero_vat_totals").when(both & ~_near(subtotal + vat, total), "vat_breaks_existing_totals")
    return let(why, lambda r: F.struct(F.when(r.isNull(), vat).alias("vat"), r.alias("rejected")))


def vat_cannot_be_total(vat: Column, total: Column) -> Column:
    """One amount can't be both VAT and total, and VAT is no larger than a positive total; false where one is missing."""
    return F.coalesce(F.when(_near(vat, total), True).otherwise((vat >= total) & (total > 0)), F.lit(False))


def total_lacks_vat(subtotal: Column, vat: Column, total: Column) -> Column:
    """The total equals the subtotal although there is VAT."""
    return F.coalesce(_near(subtotal, total) & (vat > CENT) & ~_near(subtotal + vat, total), F.lit(False))


def total_above(amounts: Column, taxable: Column) -> Column:
    """The largest of an array of amounts that lies above the taxable one."""
    return F.when(taxable > CENT, F.array_max(F.filter(amounts, lambda a: a > taxable + CENT)))


def vat_rate(text: Column) -> Column:
    """A VAT rate of a cell, or null. Digits read as I or L count as 1. Decimals without a percent sign look like money,
    but for 19 to 23."""
    t = F.upper(F.trim(text))
    number = F.regexp_replace(F.regexp_extract(t, r"^([IL1]?[0-9]{1,2}(?:[.,]\d{1,2})?)\s*%?$", 1), "^[IL]", "1")
    value = F.translate(number, ",", ".").try_cast("double")
    rate = F.when(value == 122, 22.0).otherwise(value)
    money = number.rlike("[.,]") & ~t.endswith("%") & ~rate.between(19, 23)
    return F.when(rate.isin(VAT_RATES) & ~money, rate)


def discount_rate(text: Column) -> Column:
    """A discount of a cell in percent, 0 to 80, or null; more than two decimals are noise behind a whole number."""
    t = F.regexp_replace(text, r"\s", "")
    whole, part = F.regexp_extract(t, r"^(\d{1,2})(?:[.,](\d{1,3}))?%?$", 1), F.regexp_extract(t, r"^(\d{1,2})(?:[.,](\d{1,3}))?%?$", 2)
    value = F.when((whole != "") & (F.length(part) < 3), F.concat(whole, F.lit("."), part, F.lit("0"))).when(part.rlike(r"^(0+|00\d)$"), whole).try_cast("double")
    value = F.when(t.rlike(r"^\d{1,2}[oO]%?$"), F.regexp_extract(t, r"^(\d+)", 1).try_cast("double")).otherwise(value)
    bare = (part != "") & ~t.endswith("%")
    return F.when((t.rlike(r"^\d")) & value.between(0, 80) & ~bare, value)


def title_case(text: Column) -> Column:
    """Each word and each part of it between hyphens with one capital; single spaces."""
    def word(w: Column) -> Column:
        return F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "-")

    return F.array_join(F.transform(tokens(text), word), " ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_all_caps(text: Column) -> Column:
    """All letters are capitals, and there are some."""
    letters = F.regexp_replace(text, "[^A-Za-zÀ-Üà-ü]", "")
    return (letters != "") & (letters == F.upper(letters))


def label_key(text: Column) -> Column:
    """Folded letters, digits and percent signs with single spaces."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9%]+", " "))


def has_label(text: Column, label: Column) -> Column:
    """The label's words stand in the text as words; both as ``label_key`` gives them."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), label, F.lit(" ")))


def country_hints(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(c)) for c, p in COUNTRY_WORDS.items()]))


def checked_phone(number: Column) -> Column:
    """A leading plus and the digits of a number with 9 to 15 of them; any other text as it stands."""
    t = F.trim(F.coalesce(number, F.lit("")))
    digits = F.regexp_replace(t, r"\D", "")
    return F.when(F.length(digits).between(9, 15), F.concat(F.when(t.startswith("+"), "+").otherwise(""), digits)).otherwise(t)


def distinct_phones(numbers: Column) -> Column:
    """The first number of each sequence of digits, in order."""
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    return let(F.filter(F.transform(numbers, checked_phone), lambda x: digits(x) != ""), lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, digits), digits(x)) == i + 1))


def vertical_gap(top_a: Column, bottom_a: Column, top_b: Column, bottom_b: Column) -> Column:
    return F.greatest(top_b - bottom_a, top_a - bottom_b, F.lit(0))


def horizontal_overlap(left_a: Column, right_a: Column, left_b: Column, right_b: Column) -> Column:
    """The shared width as a share of the narrower line, which counts as one unit wide at least."""
    shared = F.greatest(F.lit(0), F.least(right_a, right_b) - F.greatest(left_a, left_b))
    return shared / F.greatest(F.lit(1), F.least(right_a - left_a, right_b - left_b))


def page_fields(fields: Column, page: Column) -> Column:
    """A map of fields without blanks, its keys trimmed and told apart by the page's number, from 1."""
    kept = F.filter(F.map_entries(fields), lambda e: (F.trim(e["key"]) != "") & (F.trim(e["value"]) != ""))
    key = lambda e: F.concat(F.lit("page_"), (page + 1).cast("string"), F.lit("_"), F.trim(e["key"]))
    return F.map_from_entries(F.transform(F.array_sort(kept), lambda e: F.struct(key(e), F.trim(e["value"]))))


def same_day(a: Column, b: Column) -> Column:
    return F.coalesce(F.to_date(a) == F.to_date(b), F.lit(False))
