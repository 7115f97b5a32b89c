"""Kinds of documents, days and items that are strict about what they take, mail addresses with evidence, table headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.fields import MISSING, _strip, _table
from foliant.functions.money import let

# Names of kinds and categories.
KINDS = ["quote", "order", "invoice", "free_document"]
CATEGORY = {"quote": "quote", "order": "order", "invoice": "invoice", "free_document": "generic_document"}
PROCESSED_AS = {"quote": "quote", "order": "order", "invoice": "invoice", "delivery_document": "order", "proforma_invoice": "invoice", "generic_document": "free_document", "generic_image": "free_document"}
KIND_LABELS = {
    "it": {"quote": "Preventivo", "order": "Ordine", "invoice": "Fattura", "free_document": "Altro"},
    "en": {"quote": "Quote", "order": "Order", "invoice": "Invoice", "free_document": "Other"},
}
# The usual order of a table's columns, and scripts of China, Japan and Korea.
COLUMN_ORDER = ["code", "description", "unit", "quantity", "price", "discount", "vat", "total"]
CJK = r"㐀-䶿一-鿿豈-﫿぀-ヿㇰ-ㇿᄀ-ᇿ㄰-㆏가-힯"
# Texts of rows that are no items, ignoring case.
LEGAL = r"\b(?:inscrita\s+en\s+el\s+registro|registro\s+mercantil|condiciones\s+generales|condizioni\s+generali|privacy|iban|bic|swift|datos\s+bancarios|coordinate\s+bancarie|bankverbindung|osservazioni|observaciones|notes?\s+and\s+conditions|thank\s+you\s+for\s+your\s+business)\b"
FOOTER = r"\b(?:datos\s+bancarios|osservazioni|observaciones|condizioni\s+generali|condiciones\s+generales|vat\s+summary|riepilogo(?:\s+iva)?|note\s*\/\s*remarks|resumen\s+de\s+cantidades|total\s+3\s+a[nñ]os)\b"
CARRIED = r"\b(?:riporto(?:\s+(?:a|da)\s+pagina)?|a\s+riportare|carry(?:ed)?(?:\s+|-)forward|brought\s+forward|[uü]bertrag|a\s+reporter)\b"
SUMMED = r"\b(?:resumen(?:\s+de\s+cantidades)?|total\s+unidades\s+a[nñ]o|total\s+3\s+a[nñ]os|triennal[e]?|trienal|\d+\s+unidades)\b"
LONG_LEGAL = r"(?:registro|iban|foro|controversia|condizioni|condiciones)"
NOTES = r"\b(?:tempi\s+di\s+consegna|tasso\s+di\s+tolleranza|condizioni\s+generali|condiciones\s+generales|note\s+and\s+conditions|osservazioni|observaciones|delivery\s+terms|payment\s+terms|validit[aà]|tolleranza)\b"
TERMS = r"\b(?:delivery\s+terms|payment\s+terms|tolerance|validity|validit[aà]|conditions|condizioni|note(?:s)?\b|remarks|osservazioni|observaciones|iban|bic|swift|no\s+se\s+incluyen|does\s+not\s+include|non\s+sono\s+inclus|ne\s+sont\s+pas\s+inclus)\b"
ROW_HEADING = r"^(?:totale|total|grand total|subtotale|subtotal|imponibile|descrizione|description|q\.?t[aà]|qty|iva|vat|importo|amount)\s*$"
PRODUCT = r"\b(?:lavorazione|servizio|service|setup|logo|articolo|product|kit|filtro|manodopera|installazione|included|omaggio|complimentary|incluso|free\s+of\s+charge)\b"
INCLUDED = r"\b(?:included|omaggio|complimentary|incluso|free\s+of\s+charge)\b"
SETTLEMENT = r"\b(?:acconto|anticipo|caparra|deposito|deposit|advance\s+payment|amount\s+paid|pagato|paid|balance\s+due|saldo\s+(?:dovuto|da\s+pagare)|residuo\s+da\s+pagare|payment\s+instructions?|istruzioni\s+(?:di\s+)?pagamento|bank\s+transfer|bonifico\s+bancario|routing\s+aba)\b"


def _has(text: Column, *patterns: str) -> Column:
    return text.rlike("(?iu)" + "|".join(patterns))


def category_of(kind: Column) -> Column:
    return _table(CATEGORY)[kind]


def processed_as(category: Column) -> Column:
    return _table(PROCESSED_AS)[category]


def kind_label(kind: Column, locale: str) -> Column:
    return _table(KIND_LABELS[locale])[kind]


def by_kind(kind: Column, quote: Column, order: Column, invoice: Column, other: Column) -> Column:
    """The value that a document of the kind keeps, such as its number or its day."""
    return F.when(kind == "quote", quote).when(kind == "order", order).when(kind == "invoice", invoice).when(kind == "free_document", other)


def strict_day(text: Column, confirmed: Column) -> Column:
    """struct(value, status, reason) of a text that is y-m-d or d/m/y. Day and month that could change places stay open unless
    the user has confirmed them."""
    t = _strip(text)
    iso, local = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"
    part = lambda i, j: F.when(t.rlike(iso), F.regexp_extract(t, iso, i)).when(t.rlike(local), F.regexp_extract(t, local, j)).cast("int")
    day = F.concat_ws("-", F.lpad(part(1, 3).cast("string"), 4, "0"), F.lpad(part(2, 2).cast("string"), 2, "0"), F.lpad(part(3, 1).cast("string"), 2, "0"))

    def result(p: Column) -> Column:
        known = p["y"].isNotNull()
        sound = known & (p["y"] >= 1000) & F.try_to_date(p["day"], "yyyy-MM-dd").isNotNull()
        open_ = sound & t.rlike(local) & (p["d"] <= 12) & (p["m"] != p["d"])
        agreed = F.coalesce(confirmed, F.lit(False))
        missing = F.coalesce(F.lower(t), F.lit("")).isin(MISSING)
        status = F.when(missing, "missing").when(~sound, "invalid").when(open_ & ~agreed, "ambiguous").otherwise("valid")
        reason = F.when(missing, "missing_value").when(~known, "invalid_date_format").when(~sound, "invalid_calendar_date").when(open_, F.when(agreed, "user_confirmed_day_month").otherwise("ambiguous_day_month")).otherwise("valid_calendar_date")
        return F.struct(F.when(sound & ~missing, p["day"]).alias("value"), status.alias("status"), reason.alias("reason"))

    return let(F.struct(part(1, 3).alias("y"), part(2, 2).alias("m"), part(3, 1).alias("d"), day.alias("day")), result)


def may_apply(status: Column, conflict: Column) -> Column:
    """Whether a field's value may be taken over."""
    return F.coalesce(~F.coalesce(conflict, F.lit(False)) & status.isin("valid", "unverified"), F.lit(False))


def is_actionable(evidence: Column) -> Column:
    """Whether (value, status, review, confirmed, origin) lets a mail address be used."""
    return F.coalesce((evidence["status"] == "valid") & ~evidence["review"] & evidence["confirmed"] & evidence["origin"].isin("observed", "user"), F.lit(False))


def safe_emails(emails: Column, evidence: Column) -> Column:
    """The addresses with usable evidence, each once and in order; none where the evidence is unknown."""
    key = lambda e: F.lower(F.trim(e))
    own = F.array_distinct(F.filter(F.transform(emails, key), lambda e: e.rlike(r"^[^\s@]+@[^\s@]+\.[a-z]{2,}$")))
    allowed = F.transform(F.filter(evidence, is_actionable), lambda x: key(x["value"]))
    return F.coalesce(F.filter(own, lambda e: F.array_contains(allowed, e)), F.array().cast("array<string>"))


def is_cjk(text: Column) -> Column:
    """Two letters of these scripts, or one beside no more than one Latin letter or digit."""
    own, latin = F.length(F.regexp_replace(text, f"[^{CJK}]", "")), F.length(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    return (own >= 2) | ((own == 1) & (latin <= 1))


def schema_score(columns: Column) -> Column:
    """struct(confidence, violations) of a table's columns (kind, x): strong, medium or weak by their order."""
    order = F.array(*[F.lit(k) for k in COLUMN_ORDER])
    swapped = F.array(F.lit("quantity"), F.lit("unit"))

    def crossing(p: Column, c: Column) -> Column:
        pair = F.array_sort(F.array(p["kind"], c["kind"]))
        return F.when((F.array_position(order, c["kind"]) < F.array_position(order, p["kind"])) & (pair != swapped), F.concat(p["kind"], F.lit("_after_"), c["kind"]))

    def result(s: Column) -> Column:
        kinds = F.transform(s, lambda c: c["kind"])
        first = lambda k: F.get(F.filter(s, lambda c: c["kind"] == k), F.lit(0))["x"]
        has = lambda k: F.array_contains(kinds, k)
        n = F.greatest(F.size(s) - 1, F.lit(0))
        crossed = F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), crossing)
        beyond = [F.when(first(k) > first("total") + 8, f"{k}_right_of_total") for k in ("quantity", "price")]
        twice = F.when(F.size(F.array_distinct(kinds)) < F.size(kinds), "duplicate_column_role")
        core = has("description") & has("total") & (has("quantity") | has("price"))
        found = F.array_compact(F.concat(crossed, F.array(*beyond, twice, F.when(~core, "missing_core_columns"))))
        fatal = F.exists(found, lambda v: v.rlike("right_of_total|duplicate_column_role|missing_core|^(?:quantity|price|discount|vat|total)_after_(?:description|code)$"))
        whole = has("quantity") & has("price") & has("total")
        return F.struct(F.when(fatal, "weak").when((F.size(found) > 0) | ~whole, "medium").otherwise("strong").alias("confidence"), found.alias("violations"))

    return let(F.array_sort(F.transform(columns, lambda c: F.struct(c["x"].alias("x"), c["kind"].alias("kind")))), result)


def is_no_item(text: Column) -> Column:
    """Blank, legal and bank texts, sums carried over, and summaries."""
    t = F.coalesce(_strip(text), F.lit(""))
    return (t == "") | _has(t, LEGAL, CARRIED, SUMMED) | ((F.length(t) > 90) & _has(t, LONG_LEGAL))


def is_item(description: Column, code: Column, quantity: Column, price: Column, total: Column) -> Column:
    """Whether a row of a table is an item to keep: it has a text that is neither a heading, a payment nor a term, and an
    amount, an item code or the word that it is included."""
    t, c = F.coalesce(_strip(description), F.lit("")), F.coalesce(_strip(code), F.lit(""))
    free = ((price == 0) | (total == 0)) & F.coalesce(quantity > 0, F.lit(True))
    amounts = F.coalesce(quantity > 0, F.lit(False)) | F.coalesce(price > 0, F.lit(False)) | F.coalesce(total > 0, F.lit(False)) | F.coalesce(free, F.lit(False))
    coded = F.length(c).between(3, 24) & ~c.rlike(r"\s") & c.rlike("[A-Za-z]") & c.rlike("[0-9]")
    about = (t != "") & ~_has(t, ROW_HEADING) & ~_has(t, SETTLEMENT) & (~_has(t, NOTES, TERMS, LEGAL, FOOTER) | _has(t, PRODUCT))
    return about & (amounts | coded | (_has(t, INCLUDED) & ~is_no_item(t)))
