"""Labels of commercial documents by concept and language: the table that matching reads; callers may bring one of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.checks import label_key

# Labels by concept and language, the most usual first.
LABELS = {
    "credit_note": {"it": ["nota di credito"], "en": ["credit note"], "fr": ["avoir"], "de": ["gutschrift"], "es": ["nota de crédito"]},
    "invoice": {"it": ["fattura"], "en": ["commercial invoice", "tax invoice", "invoice"], "fr": ["facture"], "de": ["rechnung", "faktura"], "es": ["factura"]},
    "order": {
        "it": ["ordine", "conferma ordine", "ordine cliente"],
        "en": ["purchase order", "sales order", "order confirmation", "customer order", "order"],
        "fr": ["confirmation de commande", "commande"],
        "de": ["auftragsbestätigung", "bestellung"],
        "es": ["confirmación de pedido", "pedido"],
    },
    "quotation": {"it": ["preventivo", "offerta", "quotazione"], "en": ["quotation", "quote", "estimate", "proposal"], "fr": ["devis", "offre de prix"], "de": ["angebot", "kostenvoranschlag"], "es": ["presupuesto", "cotización"]},
    "issuer": {"it": ["emittente", "fornitore", "venditore"], "en": ["supplier", "vendor", "seller", "issued by", "from"], "fr": ["fournisseur", "vendeur"], "de": ["lieferant", "verkäufer"], "es": ["proveedor", "vendedor"]},
    "customer": {
        "it": ["cliente", "committente", "spett.le", "spettabile", "addetto vendite"],
        "en": ["customer", "client", "bill to", "bill-to", "billed to", "sold to", "buyer", "sales representative"],
        "fr": ["facturé à", "client", "représentant commercial"],
        "de": ["rechnung an", "kunde", "vertreter"],
        "es": ["facturar a", "comprador", "cliente", "datos del cliente"],
    },
    "description": {"it": ["descrizione", "articolo", "prodotto"], "en": ["item description", "description", "article", "product"], "fr": ["désignation", "designation", "article"], "de": ["beschreibung", "bezeichnung", "artikel", "produkt"], "es": ["descripción", "concepto", "artículo"]},
    "quantity": {"it": ["quantità", "q.tà", "qta"], "en": ["quantity", "qty"], "fr": ["quantité", "qté", "qte"], "de": ["menge", "anzahl"], "es": ["cantidad", "cant."]},
    "unit_price": {
        "it": ["prezzo unitario", "prezzo", "prezzo unit.", "pu ht", "p.u."],
        "en": ["unit price", "price"],
        "fr": ["prix unitaire", "pu ht", "prix unitaire ht", "p.u."],
        "de": ["einzelpreis", "stückpreis", "preis"],
        "es": ["precio unitario", "precio unit.", "p. unitario"],
    },
    "total": {
        "it": ["totale documento", "totale complessivo", "totale"],
        "en": ["grand total", "total due", "amount due", "total"],
        "fr": ["total général", "total ttc", "total"],
        "de": ["gesamtbetrag", "rechnungsbetrag", "gesamt"],
        "es": ["importe total", "total presupuesto", "total"],
    },
}
#: Concepts that name a document's type, in the order in which they decide.
TYPES = ["credit_note", "invoice", "order", "quotation"]


def label_rows(labels: dict = LABELS) -> list[tuple]:
    """(place, concept, language, priority, label) of each label."""
    rows = [(c, lang, max(1, 100 - k), x) for c, by in labels.items() for lang, xs in by.items() for k, x in enumerate(xs)]
    return [(k, *r) for k, r in enumerate(rows)]


def label_table(spark: SparkSession, labels: dict = LABELS) -> DataFrame:
    """(place, concept, language, priority, label, key, words): ``key`` is the label as texts are folded."""
    rows = spark.createDataFrame(label_rows(labels), "place int, concept string, language string, priority int, label string")
    return rows.withColumn("key", label_key(F.col("label"))).withColumn("words", F.size(F.split("key", " ")))
