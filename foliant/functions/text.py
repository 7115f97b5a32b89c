"""Text normalisation as Column expressions: folding, tokens, identifiers. Everything stays in generated code."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that results depend on.
LEGAL_SUFFIXES = ["ag", "co", "company", "corp", "corporation", "gmbh", "inc", "incorporated", "ltd", "limited", "llc", "plc", "sa", "sas", "scarl", "srl", "spa"]
GENERIC_MAILBOXES = ["admin", "amministrazione", "contact", "contatti", "hello", "info", "mail", "office", "sales", "segreteria", "support"]
GENERIC_MAIL_DOMAINS = [
    "aol.com", "fastwebnet.it", "gmail.com", "hotmail.com", "hotmail.it", "icloud.com", "libero.it", "live.com", "live.it",
    "mail.com", "msn.com", "outlook.com", "outlook.it", "proton.me", "protonmail.com", "virgilio.it", "yahoo.com", "yahoo.it",
]

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d ()./-]{6,}\d"
DOMAIN = r"^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$"
IBAN = r"^[a-z]{2}\d{2}[a-z0-9]{10,30}$"
VAT = r"^(it)?\d{11}$"
TAX_CODE = r"^[a-z]{6}\d{2}[a-z]\d{2}[a-z]\d{3}[a-z]$"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Composed letters and what is left of them without marks U+0300-U+036F, by the characters' own decompositions."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        bare = "".join(c for c in parts if not 0x300 <= ord(c) <= 0x36F)
        if len(parts) > 1 and len(bare) == 1:
            found[chr(code)] = bare
    return "".join(found), "".join(found.values())


def fold(text: Column) -> Column:
    """Lower case without accents: letters that only look alike (ß, ø) stay apart."""
    return F.regexp_replace(F.translate(F.lower(text), *_accents()), "[\\u0300-\\u036f]", "")


def token(text: Column) -> Column:
    """Folded letters and digits alone; '' for null."""
    return F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def words(text: Column) -> Column:
    """Folded words with one space between."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def company_key(text: Column) -> Column:
    """Words of a company name without its legal form, end to end."""
    return F.array_join(F.filter(F.split(words(text), " "), lambda w: (w != "") & ~w.isin(LEGAL_SUFFIXES)), "")


def block_fingerprint(text: Column) -> Column:
    """Tokens of the lines, sorted, so that the order of lines and pages does not matter."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), token), lambda x: x != "")
    return F.array_join(F.array_sort(lines), "|")


def email_key(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def is_generic_mailbox(email: Column) -> Column:
    stem = F.split(F.split(email, "@")[0], "[+._-]")[0]
    return stem.isin(GENERIC_MAILBOXES)


def phone_key(text: Column) -> Column:
    """Digits; '+' and '00' both mean an international number, of which the Italian code is dropped."""
    raw = F.coalesce(text, F.lit(""))
    digits = F.regexp_replace(raw, r"\D", "")
    zeros = digits.startswith("00")
    bare = F.when(zeros, F.substring(digits, 3, 64)).otherwise(digits)
    abroad = zeros | raw.rlike(r"^[^\d+]*\+")
    italian = abroad & bare.startswith("39") & F.length(bare).between(11, 13)
    return F.when(italian, F.substring(bare, 3, 64)).otherwise(bare)


def domain_key(text: Column) -> Column:
    """Host of a URL, address or mailbox; '' if it is no host name."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    host = F.element_at(F.split(low, "@"), -1)
    host = F.regexp_replace(host, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(host, "^//", ""), r"^www\.", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(host, r"^[^/?#\s]*", 0), r":\d+$", ""), r"[.,;:]+$", "")
    return F.when(host.rlike(DOMAIN), host).otherwise("")


def document_number_key(text: Column) -> Column:
    """Lower case, single spaces, none around / - and dots."""
    one = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    return F.regexp_replace(one, r"\s*([/.\-])\s*", "$1")


def is_rejected_number(text: Column, generic: list[str]) -> Column:
    """Labels, bank accounts and tax numbers are no document numbers."""
    compact = F.lower(F.regexp_replace(text, r"\s+", ""))
    key = document_number_key(text)
    return (key == "") | key.isin(generic) | (key == "122") | compact.rlike(IBAN) | compact.rlike(VAT) | compact.rlike(TAX_CODE)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if a side is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def alphanumeric_share(text: Column) -> Column:
    """Readable characters among those that are not white space."""
    compact = F.regexp_replace(text, r"\s", "")
    odd = F.regexp_replace(compact, r"[\p{L}\p{N}@.+\-_/():,;'’&]", "")
    return F.when(F.length(compact) == 0, F.lit(0.0)).otherwise((F.length(compact) - F.length(odd)) / F.length(compact))


def unusual_share(text: Column) -> Column:
    compact = F.regexp_replace(text, r"\s", "")
    odd = F.regexp_replace(compact, r"[\p{L}\p{N}@.+\-_/():,;'’&€$£%#]", "")
    return F.when(F.length(compact) == 0, F.lit(0.0)).otherwise(F.length(odd) / F.length(compact))


def unit_round(x: Column) -> Column:
    """Three decimals, halves up, within 0 and 1."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 1000 + 0.5) / 1000


def line_quality(text: Column, valid_box: Column | None = None) -> Column:
    """Estimated quality of a recognised line. valid_box: null where there is no box."""
    t = F.trim(text)
    geometry = F.lit(0.5) if valid_box is None else F.when(valid_box.isNull(), 0.5).when(valid_box, 1.0).otherwise(0.0)
    score = 0.2 + F.least(F.length(t) / 24, F.lit(1.0)) * 0.25 + alphanumeric_share(t) * 0.35 + geometry * 0.2 - F.least(unusual_share(t) * 2, F.lit(1.0)) * 0.35
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(unit_round(score))
