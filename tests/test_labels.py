"""Labels in lines against plain matching."""

import random
import re

from foliant.functions.labels import LABELS, TYPES, label_rows, label_table
from foliant.operators import labels as L


def lines(spark, texts):
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc long, line int, text string")


def test_the_best_label(spark):
    texts = ["Prezzo unitario: 5", "PREZZO UNIT. 5", "Totale complessivo", "Grand total / Totale", "Spett.le Ditta", "Facturé à", "totalement", "", None, "Gesamt 7 Menge 3", "N. 3"]
    found = {x.line: (x.concept, x.language, x.label) for x in L.find_labels(lines(spark, texts), label_table(spark), ["line"], ["total", "customer", "quantity", "unit_price"]).collect()}
    assert found == {
        0: ("unit_price", "it", "prezzo unitario"), 1: ("unit_price", "it", "prezzo"), 2: ("total", "it", "totale complessivo"), 3: ("total", "en", "grand total"), 4: ("customer", "it", "spett.le"),
        5: ("customer", "fr", "facturé à"), 9: ("quantity", "de", "menge"),
    }


def test_types(spark):
    texts = ["Order confirmation of quotation 5", "Nota di credito su fattura", "AUFTRAGSBESTÄTIGUNG", "tax invoice", "devis", "border", None]
    found = {x.line: x.type for x in L.document_types(lines(spark, texts), label_table(spark), ["line"]).collect()}
    assert found == {0: "order", 1: "credit_note", 2: "order", 3: "invoice", 4: "quotation"}


def plain_languages(texts, rows):
    from collections import Counter

    scores, first = Counter(), {}
    for k, folded in enumerate(texts):
        if scores and max(scores.values()) >= 6:
            break
        if not re.search("[a-z]{3}", folded):
            continue
        seen = set()
        for key, language in rows:
            if key not in seen and f" {key} " in f" {folded} ":
                seen.add(key)
                words = len(key.split())
                scores[language] += max(2, min(4, words)) if words > 1 or len(key) >= 12 else 1
                first.setdefault(language, k)
    ranked = sorted(scores, key=lambda x: (-scores[x], first[x], x))
    return (ranked[0], scores[ranked[0]]) if ranked else None


def test_languages(spark):
    r = random.Random(8)
    plain = [(x, lang) for _, _, lang, _, x in label_rows() if x.isascii() and x.replace(" ", "").isalpha()]
    docs = {d: [" ".join(r.choice(plain)[0] if r.random() < 0.5 else "7" for _ in range(r.randrange(0, 4))) for _ in range(r.randrange(1, 9))] for d in range(120)}
    frame = spark.createDataFrame([(d, k, t) for d, ts in docs.items() for k, t in enumerate(ts)], "doc long, line int, text string")
    found = {x.doc: (x.language, x.points) for x in L.document_languages(frame, label_table(spark), "doc", "line").collect()}
    rows = [(" ".join("".join(c if c.isalnum() or c == "%" else " " for c in x).split()), lang) for _, _, lang, _, x in label_rows()]
    assert found == {d: plain_languages(ts, rows) for d, ts in docs.items() if plain_languages(ts, rows)}


def test_other_tables(spark):
    own = label_table(spark, {"origin": {"pt": ["país de origem"], "en": ["country of origin"]}})
    found = L.find_labels(lines(spark, ["PAÍS DE ORIGEM: Brasil", "country origin"]), own, ["line"], ["origin"]).collect()
    assert [(x.line, x.language) for x in found] == [(0, "pt")]
    assert L.document_languages(lines(spark, ["x"]), own, "doc", "line").count() == 0
    assert set(TYPES) < set(LABELS) and len(label_rows()) < 200


def test_labels_of_all_lines(spark):
    """As the best label and the type are found one by one, whatever the size of the table; lines without either stay."""
    from unittest.mock import patch

    r = random.Random(4)
    labels = [x for *_, x in label_rows()]
    texts = [" ".join(r.choice([r.choice(labels), r.choice(labels).upper(), "7", "--", "total due total"]) for _ in range(r.randrange(0, 5))) for _ in range(150)] + [None, "", "!?"]
    frame, table, concepts = lines(spark, texts), label_table(spark).unionAll(label_table(spark, {"total": {"xx": ["!!"]}})), ["total", "customer", "quantity"]
    best = {x.line: (x.concept, x.language, x.label) for x in L.find_labels(frame, table, ["line"], concepts).collect()}
    types = {x.line: x.type for x in L.document_types(frame, table, ["line"]).collect()}
    want = {k: (*best.get(k, (None, None, None)), types.get(k)) for k in range(len(texts))}
    assert len(best) > 50 and len(types) > 20 and not {len(texts) - 1, len(texts) - 2, len(texts) - 3} & {*best, *types}
    for most in (10_000, 3):
        with patch.object(L, "BROADCAST", most):
            assert {x.line: (x.concept, x.language, x.label, x.type) for x in L.line_labels(frame.repartition(3), table, ["line"], concepts).collect()} == want
    assert L.line_labels(frame.limit(0), table, ["line"], concepts).count() == 0


def test_words_are_not_folded_within_lambdas(spark):
    """A line's text is folded once and not again for each run of its words."""
    from unittest.mock import patch

    for most in (10_000, 3):
        with patch.object(L, "BROADCAST", most):
            found = L.matches(lines(spark, ["Total due 5"]), label_table(spark))
        assert not re.search(r"lambdafunction[^\n]*translate", found._jdf.queryExecution().optimizedPlan().toString())
        assert {x.label for x in found.collect()} == {"total due", "total"}
