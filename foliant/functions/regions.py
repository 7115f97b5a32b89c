"""Regions of a document's lines: what a line announces by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.money import let

# What lines of regions look like, ignoring case, and the regions of zones.
IDENTITY = r"\b(?:fattura\s+n\.?|n\.\s*fattura|invoice\s+no\.?|quote\s+no\.?|quotation\s+no\.?|preventivo\s+n\.?|ordine\s+n\.?|devis\s+n[°º.]?|facture\s+n[°º.]?|auftragsnummer|angebotsnummer|rechnungsnummer|presupuesto|pedido|bestellung)\b"
CUSTOMER = r"\b(?:cliente|bill\s*to|customer|client|factur[eé]\s*[àa]|rechnungsadresse|rechnung\s+an|datos\s+del\s+cliente|spettabile|destinatario\s+fattura)\b"
SHIP_TO = r"\b(?:destinazione\s+merce|ship\s*to|delivery\s+address|lieferadresse|adresse\s+de\s+livraison|direcci[oó]n\s+de\s+entrega|consegna)\b"
ISSUER = r"\b(?:fornitore|supplier|vendor|vendeur|proveedor|lieferant|emittente)\b"
HEADER_WORD = r"\b(?:codice|descrizione|description|d[eé]signation|bezeichnung|cantidad|quantit|q\.?t[aàeé]|qty|prezzo|unit\s+price|sconto|discount|iva|vat|tva|mwst|importo|line\s+total|montant|gesamt)\b"
TOTALS = r"\b(?:imponibile|subtotal|subtotale|taxable|zwischensumme|base\s+imponib|totale\s+documento|grand\s+total|gesamtbetrag|total\s+ttc|totale\s+offerta|sconto\s+documento|spese?\s+trasporto)\b"
TAX_RECAP = r"\b(?:riepilogo(?:\s+iva)?|vat\s+recap|vat\s+summary|aliquota\s*\/\s*rate|tax\s+recap)\b"
EARLIER_ORDERS = r"\b(?:resumen(?:\s+de\s+cantidades)?|r[ée]sum[eé]|zusammenfassung|historical|previous\s+orders|triennal[e]?|trienal|totale?\s+anno|annual\s+total|total\s+unidades\s+a[nñ]o|total\s+3\s+a[nñ]os|statistics)\b"
CARRIED_FORWARD = r"\b(?:riporto(?:\s+(?:a|da)\s+pagina)?|a\s+riportare|carry(?:ed)?(?:\s+|-)forward|brought\s+forward|[uü]bertrag|subtotal\s+carried\s+forward|a\s+reporter)\b"
PAYMENT_OR_NOTES = r"\b(?:condizioni\s+di\s+pagamento|payment\s+terms|zahlungsbedingungen|observaciones|osservazioni|notes?:|iban|bic|swift)\b"
ZONE_REGION = {
    "header": "header",
    "issuer": "issuer_block",
    "customer": "customer_block",
    "metadata": "document_identity",
    "subject": "references",
    "items_table": "commercial_table_body",
    "tax_summary": "tax_recap",
    "totals": "document_totals",
    "payment": "payment_terms",
    "footer": "footer",
    "notes": "notes",
}
#: In the order in which they decide: pattern, region, confidence, reason.
RULES = [
    (CARRIED_FORWARD, "table_subtotal", 0.9, "carry_forward_label"),
    (EARLIER_ORDERS, "historical_recap", 0.88, "historical_or_statistical_recap"),
    (TAX_RECAP, "tax_recap", 0.9, "tax_recap_heading"),
    (IDENTITY, "document_identity", 0.86, "document_number_label"),
    (SHIP_TO, "ship_to_block", 0.85, "ship_to_anchor"),
    (CUSTOMER, "customer_block", 0.85, "customer_anchor"),
    (ISSUER, "issuer_block", 0.8, "issuer_anchor"),
    (TOTALS, "document_totals", 0.82, "totals_label"),
    (PAYMENT_OR_NOTES, "payment_terms", 0.75, "payment_or_notes"),
]
#: A line of column names is no longer than this.
HEADER_LENGTH = 48


def region_of(text: Column, zone: Column) -> Column:
    """struct(region, confidence, reason) of a line: its own words come before the zone that holds it."""
    row = lambda region, confidence, reason: F.struct(F.lit(region).alias("region") if isinstance(region, str) else region.alias("region"), F.lit(float(confidence)).alias("confidence"), F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"))

    def found(t: Column) -> Column:
        out = F.when(t == "", row("unknown", 0, "empty"))
        for pattern, region, confidence, reason in RULES:
            out = out.when(t.rlike(f"(?iu){pattern}"), row(region, confidence, reason))
        known = F.create_map(*[F.lit(x) for pair in ZONE_REGION.items() for x in pair])[zone]
        out = out.when(t.rlike(f"(?iu){HEADER_WORD}") & (F.length(t) <= HEADER_LENGTH), row("commercial_table_header", 0.7, "table_header_token"))
        return out.when(known.isNotNull(), row(known, 0.55, F.concat(F.lit("zone_"), zone))).otherwise(row("unknown", 0.2, "unclassified"))

    return let(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u00a0]+", " ")), found)
