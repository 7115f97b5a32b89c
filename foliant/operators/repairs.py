"""Totals of documents put right by rules in order, with an account of each step; VAT columns found by what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.checks import CENT, vat_rate
from foliant.functions.fields import _strip
from foliant.functions.text import fold
from foliant.operators.state import walk

#: A whole number of 9 to 13 digits is an identifier and no amount.
IDENTIFIER = 10**8, 10**13 - 1


def _none() -> Column:
    return F.lit(None).cast("double")


def _identifier(x: Column) -> Column:
    whole = F.floor(x + 0.5)
    return (F.abs(x - whole) <= CENT) & whole.between(*IDENTIFIER)


def _rules(t: Column, s: Column, v: Column, items: Column) -> list[tuple]:
    """(reason, condition, new values of total, subtotal and vat by name), in order. A null condition does not hold."""
    both = F.floor((s + v) * 100 + 0.5) / 100
    more = items > t * 1.02
    fits = F.coalesce(F.abs(s + v - t) <= CENT, F.lit(False))
    discounted = F.coalesce((s >= items * 0.98) & (s > t + CENT), F.lit(False))
    gone = {"total": _none(), "subtotal": _none(), "vat": _none()}
    only = lambda *names: {n: gone[n] for n in names}
    return [
        ("subtotal_non_positive", s <= 0, only("subtotal")),
        ("total_non_positive", t <= 0, only("total")),
        ("vat_negative", v < 0, only("vat")),
        ("vat_amount_looks_like_fiscal_id", _identifier(v), only("vat")),
        ("vat_amount_looks_like_rate", (v > 0) & (v <= 23) & (v == F.floor(v)) & (s.isNull() | (s > 200)), only("vat")),
        ("subtotal_looks_like_fiscal_id", _identifier(s), only("subtotal")),
        ("total_looks_like_fiscal_id", _identifier(t), only("total")),
        ("grand_total_absurd_vs_commercial_values", (s > 0) & (v >= 0) & (t > F.greatest(both, s, F.coalesce(items, F.lit(0.0)), F.lit(1.0)) * 100), {"total": both}),
        ("total_equals_vat_amount", (F.abs(t - v) <= CENT) & (s > v + CENT), {"total": both}),
        ("subtotal_exceeds_total", (s > t + CENT) & (s > t * 1.15), only("subtotal", "vat")),
        ("subtotal_before_discount", (s > t + CENT) & (s <= t * 1.15), {}),
        ("grand_total_equals_subtotal_with_vat", (F.abs(s - t) <= CENT) & (v > CENT) & (F.abs(both - t) > CENT), {"total": both}),
        ("vat_exceeds_total", s.isNull() & (v > t + CENT), only("vat")),
        ("vat_equals_grand_total", s.isNull() & (F.abs(v - t) <= CENT), only("vat")),
        ("line_items_exceed_total_ignored_coherent_triplet", more & fits, {}),
        ("line_items_exceed_total", more & ~fits & ~discounted, {}),
        ("discount_before_total", more & ~fits & discounted, {}),
        ("total_too_small_vs_items", (t < 100) & (items > 200) & (items > t * 4), only("total")),
        ("total_too_small_vs_subtotal", (t < 100) & (s > 500), only("total", "subtotal", "vat")),
    ]


def repair_totals(docs: DataFrame, items: str = "items") -> DataFrame:
    """``docs`` (total, subtotal, vat and the sum of the lines) with the three put right, ``steps``, which lists the reason of each
    rule that held and the three amounts behind it, and ``requires_review``. Nothing is invented but a total that is the sum of
    subtotal and VAT; what contradicts itself goes. Amounts that are no numbers count as missing. It all stays one projection."""
    names, step = ["total", "subtotal", "vat"], "struct<reason:string,total:double,subtotal:double,vat:double>"
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double"))
    out = docs.withColumns({**{c: finite(c) for c in names}, "__items": finite(items), "steps": F.array().cast(f"array<{step}>")})
    for k in range(len(_rules(*[F.lit(0.0)] * 4))):
        reason, holds, new = _rules(F.col("total"), F.col("subtotal"), F.col("vat"), F.col("__items"))[k]
        out = out.withColumn("__holds", F.coalesce(holds, F.lit(False)))
        out = out.withColumns({c: F.when(F.col("__holds"), x).otherwise(F.col(c)) for c, x in new.items()})
        row = F.struct(F.lit(reason).alias("reason"), *names)
        out = out.withColumn("steps", F.when(F.col("__holds"), F.array_append("steps", row)).otherwise(F.col("steps")))
    return out.withColumn("requires_review", F.size("steps") > 0).drop("__items", "__holds")


# Headers of VAT columns, ignoring case, and words that are close to one but are none.
VAT_HEADER = r"^(?:i?va|va|vat|tva|mwst\.?|ust\.?|aliq(?:uota)?\.?|aliquota|impuesto|tipo\s*iva|tax)(?:\s*%|\s+rate|\s+\(\s*%\s*\))?$"
VAT_WORDS = ["iva", "vat", "tva", "mwst", "ust", "aliq", "aliquota"]
DISCOUNT_HEADER = r"^(?:sconto|scanto|discount|disc\.?|sc\.?|remise|rem\.?|rabatt|descuento|desc\.?|dto\.?)(?:\s*%|\s+listino|\s+\(\s*%\s*\))?$"
DISCOUNT_WORDS = ["sconto", "discount", "remise", "rabatt", "descuento"]
NO_VAT_WORDS = [
    "ht", "ttc", "qta", "qty", "qte", "um", "udm", "sas", "srl", "gmbh", "ltd", "spa",
    "des", "de", "du", "del", "die", "der", "den", "das", "the", "and", "und", "et",
    "la", "le", "el", "di", "da", "of", "to", "sa", "inc", "bv", "oy", "ab", "pu",
    "sconto", "sc", "remise", "rabatt", "prezzo", "price", "importo", "amount",
]


def _close(word: Column, targets: list[str], gap: int) -> Column:
    """Whether a word is within two edits of a target and of nearly its length; short targets keep their length."""
    n = F.length(word)
    tests = [(F.abs(n - len(t)) <= (0 if gap == 1 and len(t) <= 3 else gap)) & (F.levenshtein(word, F.lit(t), 2) >= 0) for t in targets]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def vat_header(text: Column) -> Column:
    """'explicit_vat_header', 'fuzzy_vat_header' for a misread one of at most three words, or null."""
    t = _strip(F.coalesce(text, F.lit("")))
    bare = lambda x: F.regexp_replace(fold(x), "[^a-z0-9]", "")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    discount = t.rlike(f"(?iu){DISCOUNT_HEADER}") | ((F.size(words) <= 2) & F.length(bare(t)).between(4, 12) & _close(bare(t), DISCOUNT_WORDS, 2))
    candidates = F.concat(F.array(bare(t)), F.when(F.size(words) <= 2, F.transform(words, bare)).otherwise(F.array().cast("array<string>")))
    near = F.exists(candidates, lambda w: ~w.isin(NO_VAT_WORDS) & F.length(w).between(3, 10) & ~w.rlike(r"^\d+$") & _close(w, VAT_WORDS, 1))
    fuzzy = ~discount & (t.rlike(r"(?i)^v\.?a\.?$") | ((F.size(words) <= 3) & near))
    return F.when(t.rlike(f"(?iu){VAT_HEADER}"), "explicit_vat_header").when(fuzzy, "fuzzy_vat_header")


class Clusters:
    """Numbers a page's cells from left to right; a cell within ``reach`` of the mean of those so far is with them."""

    def __init__(self) -> None:
        self.number, self.sum, self.n = -1, 0.0, 0

    def step(self, row: tuple) -> tuple:
        x, reach = row
        if self.n and abs(self.sum / self.n - x) <= reach:
            self.sum, self.n = self.sum + x, self.n + 1
        else:
            self.number, self.sum, self.n = self.number + 1, x, 1
        return (self.number,)


def vat_columns(pages: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """(page, x, confidence): the VAT column of each page (page, width) that has one.

    ``columns`` (page, kind, x) are those that headers name, ``cells`` (page, x, text, is_header) all cells. A named VAT column counts as
    it is. Else cells with plausible rates make clusters by x; one that stands on another column, left of the price or far from
    the total is out; the header above it, the number of its rates and its place decide. A cluster that only says
    10 % may be a discount ('ambiguous_rate_column'). Cells without x or text don't count."""
    width = F.coalesce(F.col("width"), F.lit(1200.0))
    reach = F.greatest(F.lit(35.0), width * 0.02)
    of = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("x")))
    known = columns.groupBy("page").agg(of("vat").alias("vat_x"), of("discount").alias("discount_x"), of("quantity").alias("quantity_x"), of("price").alias("price_x"), of("total").alias("total_x"))
    heads = cells.filter("is_header").withColumn("named", vat_header(F.col("text"))).filter("named IS NOT NULL AND x IS NOT NULL").select("page", F.col("x").alias("hx"), "named")
    fuzzy = heads.filter("named = 'fuzzy_vat_header'").groupBy("page").agg(F.min("hx").alias("fuzzy_x"))
    p = pages.select("page", width.alias("width"), reach.alias("reach")).join(known, "page", "left").join(fuzzy, "page", "left")
    rates = cells.filter("NOT is_header AND x IS NOT NULL").withColumn("rate", vat_rate(F.col("text"))).filter("rate IS NOT NULL").select("page", "x", "rate")
    numbered = walk(rates.join(p.filter("vat_x IS NULL").select("page", "reach"), "page"), "page", ["x", "rate"], Clusters, Clusters.step, ["x", "reach"], "cluster long")
    found = numbered.groupBy("page", "cluster").agg(F.avg("x").alias("x"), F.count("*").alias("n"), F.count_distinct("rate").alias("kinds"), F.max("rate").alias("most")).join(p, "page")
    # a page whose header is misread may have one rate alone
    found = found.filter((F.col("n") >= 2) | F.col("fuzzy_x").isNotNull())
    clash = lambda c: F.coalesce(F.abs(F.col("x") - F.col(c)) <= F.col("reach"), F.lit(False))
    right = F.coalesce(F.col("x") > F.col("price_x") + F.col("reach") * 0.4, F.lit(True))
    near = F.coalesce((F.abs(F.col("x") - F.col("total_x")) <= F.greatest(F.lit(180.0), F.col("width") * 0.22)) | (F.col("x") > F.col("total_x") - F.col("reach")), F.lit(True))
    usable = found.filter(~clash("discount_x") & ~clash("quantity_x") & ~clash("price_x") & right & near)
    above = usable.join(heads, "page").filter(F.abs(F.col("hx") - F.col("x")) <= F.col("reach") * 1.5).select("page", "cluster").distinct().withColumn("above", F.lit(True))
    ranked = usable.join(above, ["page", "cluster"], "left").withColumn("above", F.coalesce("above", F.lit(False)))
    best = ranked.groupBy("page").agg(F.max(F.struct("above", "n", "x", "kinds", "most", F.col("discount_x").isNull().alias("no_discount"))).alias("b"))
    ten = (F.col("b.kinds") == 1) & (F.col("b.most") == 10) & F.col("b.no_discount") & ~F.col("b.above")
    sure = F.when(ten, "ambiguous_rate_column").when(F.col("b.above"), "fuzzy_vat_header").when(F.col("b.n") >= 2, "repeated_rate_column").otherwise("ambiguous_rate_column")
    held = found.select("page").distinct().withColumn("held", F.lit(True))
    out = p.join(best.select("page", F.col("b.x").alias("x"), sure.alias("sure")), "page", "left").join(held, "page", "left")
    # without a cluster of rates, a misread header names the column alone
    alone = F.col("held").isNull() & F.col("fuzzy_x").isNotNull()
    x = F.coalesce("vat_x", F.when(alone, F.col("fuzzy_x")), "x")
    confidence = F.when(F.col("vat_x").isNotNull(), "explicit_vat_header").when(alone, "fuzzy_vat_header").otherwise(F.col("sure"))
    return out.select("page", x.alias("x"), confidence.alias("confidence")).filter("x IS NOT NULL")
