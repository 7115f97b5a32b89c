"""Cells and rows of numbers that lost their row: one-to-one assignment to rows of a page.

Candidates come from a join on bands of y, so a cell meets the rows within its reach and not all of its page. Their scores are
columns. What is left is greedy: in order of y each request takes its best free row if that leads the next one clearly. This
runs batch by batch with the taken rows of the page as the state; ``FORGET`` rows behind, they are forgotten.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.money import parse_amount
from foliant.operators.shared import stored
from foliant.operators.state import walk

NUMERIC = ["quantity", "price", "discount", "vat", "total"]
#: By how much the best row must lead the next.
MARGIN = 8
#: Taken rows of a page that are remembered; reach is a few rows.
FORGET = 4096
SUMMARY = r"(?iu)\b(?:base imponible|subtotal|subtotale|imponibile|totale|total(?:e)?(?:\s+documento|\s+ttc|\s+offerta)?|taxable|grand total|gesamtbetrag|resumen|neta|riepilogo|carry(?:ed)?(?:\s|-)forward)\b"
WORDS = "[A-Za-zÀ-ÿ]{4,}"


class Claims:
    """Rows (or slots of rows) that are taken."""

    def __init__(self) -> None:
        self.taken: OrderedDict = OrderedDict()

    def step(self, row: tuple) -> tuple:
        slots, scores = row
        free = sorted((-score, k, slot) for k, (slot, score) in enumerate(zip(slots.tolist(), scores.tolist())) if slot not in self.taken)
        if not free or free[0][0] >= 0:
            return None, "taken" if len(free) < len(slots) else "none"
        if len(free) > 1 and free[0][0] > free[1][0] - MARGIN:
            return None, "ambiguous"
        slot = free[0][2]
        self.taken[slot] = True
        if len(self.taken) > FORGET:
            self.taken.popitem(last=False)
        return slot, "attached"


def greedy(requests: DataFrame, page: str, order: list[str]) -> DataFrame:
    """``requests`` (candidates: array of (slot, score), the first of equal ones wins) with slot and status in place of the
    candidates: attached, ambiguous (the next one is within MARGIN), taken or none. A score of 0 or less never wins."""
    given = requests.withColumns({"__slots": F.col("candidates.slot"), "__scores": F.col("candidates.score")}).drop("candidates")
    return walk(given, page, order, Claims, Claims.step, ["__slots", "__scores"], "slot string, status string", spent=True)


def is_amount(text: Column) -> Column:
    """The value of an amount, null for other texts. Texts without digits and plain numbers need no look at locales."""
    plain = text.rlike(r"^\d{1,15}([.,]\d{2})?$")
    return F.when(~text.rlike(r"\d"), F.lit(None).cast("double")).when(plain, F.translate(text, ",", ".").try_cast("double")).otherwise(parse_amount(text)["value"])


def _banded(rows: DataFrame, low: str, high: str, width: str) -> DataFrame:
    """``rows`` once for each band of ``width`` between low and high."""
    at = lambda c: F.floor(F.col(c) / F.col(width)).cast("long")
    return rows.withColumn("__band", F.explode(F.sequence(at(low), at(high))))


def row_bands(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of cells (page, row, y, kind, text, value): page, row, y, anchor_y, x, summary, code, words, the first value of each kind, and
    ``full``, the kinds that the row has a cell of which counts.

    A row is anchored by a description, an item code or words. Cells without a row are not looked at."""
    text = F.coalesce("text", F.lit(""))
    anchor = F.col("kind").isin("description", "code") | (F.col("value").isNull() & text.rlike(WORDS))
    coded = (F.col("kind") == "code") | (F.length(F.trim(text)).between(3, 18) & ~F.trim(text).rlike(r"\s") & text.rlike("[A-Za-z]") & text.rlike("[0-9]"))
    wordy = ~F.col("kind").isin("code", *NUMERIC) & text.rlike(WORDS) & ~coded
    summary = F.col("kind").isin("description", "code") & text.rlike(SUMMARY)
    no = F.lit(False)
    first = lambda k: F.min_by(F.when((F.col("kind") == k), F.col("value")), F.when((F.col("kind") == k) & F.col("value").isNotNull(), F.struct("x", "id"))).alias(k)
    kinds = F.coalesce("kind", F.lit(""))
    # stray whole numbers where a price or total belongs, and zeros, don't count
    whole = (F.col("value") == F.floor("value")) & F.col("value").between(1, 100) & ~F.trim(F.col("text")).rlike(r"[.,]|\s\d{3}")
    weak = F.col("kind").isin("price", "total") & F.coalesce(F.col("value").isNull() | whole | (F.col("value") == 0), F.lit(True))
    full = F.array_compact(F.array(*[F.when(~F.min(F.when(F.col("kind") == k, weak)), F.lit(k)) for k in NUMERIC])).alias("full")
    return (
        cells.filter("row IS NOT NULL")
        .withColumn("kind", kinds)
        .groupBy("page", "row")
        .agg(
            F.min("row_y").alias("y"), F.avg(F.when(anchor, F.col("y"))).alias("anchor_y"), F.min_by("x", F.struct("x", "id")).alias("x"), F.max(F.coalesce(summary, no)).alias("summary"), F.max(F.coalesce(coded, no)).alias("code"),
            F.max(F.coalesce(wordy, no)).alias("words"), *[first(k) for k in NUMERIC], full,
        )
        .join(pages, "page")
    )


def reattach_cells(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """The orphan cells of pages with slot ('row/kind', null where none is clear) and status.

    ``cells``: page, id, row (null: of no row), row_y, x, y, kind (null: no column), text. ``pages``: page, height (median height of
    a line), spacing (median distance of rows). Orphans are cells with an amount and a numeric kind that are in no row or in a row without
    an anchor. The reach of a kind is scaled by the page's height and spacing, and by how far cells of the kind are off
    their rows elsewhere on the page. A slot is free if the row has no cell of the kind, only stray whole numbers where a price
    or total belongs, or zeros. Totals come last and gain where quantity times price fits. Cells without a page, y or
    amount are no orphans."""
    # each of these is used several times; amounts are read once
    c = stored(cells.select("page", "id", "row", "row_y", "x", "y", "kind", "text", is_amount(F.col("text")).alias("value")), "cells")
    base = F.greatest(F.col("height") * 1.8, F.least(F.col("spacing") * 0.55, F.col("height") * 4))
    anchored = stored(row_bands(c, pages).filter("anchor_y IS NOT NULL").withColumn("base", base), "rows")
    numeric = F.col("kind").isin(NUMERIC) & F.col("value").isNotNull() & F.col("y").isNotNull()
    wanted = c.filter(numeric).select("page", "id", "row", "kind", "x", "y", "value")
    orphans = wanted.filter("row IS NULL OR page IS NULL").unionAll(wanted.filter("row IS NOT NULL AND page IS NOT NULL").join(anchored.select("page", "row"), ["page", "row"], "left_anti").select(wanted.columns)).drop("row")
    # how far the cells of a kind are off their rows: the upper median
    off = c.filter("row IS NOT NULL AND kind IS NOT NULL").withColumn("off", F.abs(F.col("y") - F.col("row_y"))).filter(F.col("kind").isin(NUMERIC) & (F.col("off") > 0)).join(anchored.select("page", "row"), ["page", "row"], "left_semi")
    w = Window.partitionBy("page", "kind")
    typical = off.select("page", "kind", "off", "id").withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy("off", "id"))}).filter("k = n div 2 + 1").select("page", "kind", F.col("off").alias("typical"))

    def candidates(wanted: DataFrame, owners: DataFrame) -> DataFrame:
        # rows meet the kinds that their page has orphans of
        kinds = wanted.select("page", "kind").distinct().join(typical, ["page", "kind"], "left")
        o = owners.join(kinds, "page")
        # quantities belong to rows of goods, if the page has any
        goods = F.max((~F.col("summary")).cast("int")).over(Window.partitionBy("page", "kind"))
        o = o.withColumn("goods", goods).filter((F.col("kind") != "quantity") | ~F.col("summary") | (F.col("goods") == 0))
        by = Window.partitionBy("page", "kind").orderBy("y", "row")
        drift = F.greatest("base", F.coalesce(F.col("typical") * 1.35 + F.col("base") * 0.25, "base")) * F.when(F.col("kind") == "total", 1.25).otherwise(1.0)
        o = o.withColumns({"drift": drift, "before": F.lag("y").over(by), "after": F.lead("y").over(by)})
        # a band is as wide as a row's usual reach, so that a row is in few of them
        o = o.withColumns({"low": F.coalesce((F.col("before") + F.col("y")) / 2, F.col("y") - F.col("spacing")) - F.col("drift"), "high": F.coalesce((F.col("after") + F.col("y")) / 2, F.col("y") + F.col("spacing")) + F.col("drift"), "width": F.greatest(F.col("spacing") + F.col("base") * 2, F.lit(8.0))})
        o = o.filter(~F.array_contains("full", F.col("kind")) & ((F.col("kind") != "quantity") | ~F.col("summary")))
        near = _banded(o, "low", "high", "width").select("page", "kind", "__band", "low", "high", "drift", F.col("y").alias("oy"), "anchor_y", "quantity", "price", F.col("row").alias("owner"))
        at = wanted.join(pages, "page", "left").withColumn("__band", F.floor(F.col("y") / F.greatest(F.col("spacing") + base * 2, F.lit(8.0))).cast("long")).select("page", "id", "kind", "x", "y", "value", "__band")
        met = at.alias("a").join(near.alias("o"), (F.col("a.page") == F.col("o.page")) & (F.col("a.kind") == F.col("o.kind")) & (F.col("a.__band") == F.col("o.__band")) & (F.col("y") >= F.col("low")) & (F.col("y") < F.col("high")), "left")
        kind = F.col("a.kind")
        dy = F.abs(F.col("y") - F.when(kind == "quantity", F.col("anchor_y")).otherwise(F.col("oy"))) / F.greatest(F.lit(8.0), F.col("drift"))
        fits = (kind == "total") & (F.abs(F.col("quantity") * F.col("price") - F.col("value")) <= F.greatest(F.lit(0.05), F.abs("value") * 0.01))
        score = 48 - dy * 28 + F.when(kind == "quantity", F.greatest(F.lit(0.0), 12 - dy * 12)).when(fits, 8.0).otherwise(0.0)
        found = met.select("a.page", "id", "a.kind", "x", "y", "value", F.when(F.col("owner").isNotNull(), F.struct("oy", "owner", score.alias("score"))).alias("c"))
        listed = found.groupBy("page", "id", "kind", "x", "y", "value").agg(F.sort_array(F.collect_list("c")).alias("c"))
        slots = F.transform("c", lambda s: F.struct(F.concat_ws("/", s["owner"].cast("string"), F.col("kind")).alias("slot"), s["score"].alias("score")))
        return listed.select("page", "id", "kind", "x", "y", "value", slots.alias("candidates"))

    order = ["y", "x", "id"]
    first = stored(greedy(candidates(orphans.filter("kind <> 'total'"), anchored), "page", order), "claims")
    # what came in counts when the totals are weighed
    came = first.filter("status = 'attached' AND kind IN ('quantity', 'price')").select("page", F.split_part("slot", F.lit("/"), F.lit(1)).alias("__row"), "kind", "value")
    came = came.groupBy("page", "__row").agg(F.max(F.when(F.col("kind") == "quantity", F.col("value"))).alias("__q"), F.max(F.when(F.col("kind") == "price", F.col("value"))).alias("__p"))
    later = anchored.withColumn("__row", F.col("row").cast("string")).join(came, ["page", "__row"], "left").withColumns({"quantity": F.coalesce("quantity", "__q"), "price": F.coalesce("__p", "price")}).drop("__row", "__q", "__p")
    totals = greedy(candidates(orphans.filter("kind = 'total'"), later), "page", order)
    return first.unionAll(totals).select("page", "id", "kind", "slot", "status")


def assign_clusters(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, row, owner, status): rows that hold numbers alone, each given to the row with words and without numbers that it belongs to.

    Donors have two of quantity, price and total, and no words; owners have words, neither quantity nor price, and no two of
    them. Distance counts against the page's spacing (between 1.8 and 5 heights); beyond 1.35 of it no owner comes in. An
    owner with another total is out; one to the left, fitting arithmetic and item codes on one side alone count for it."""
    rows = row_bands(cells.withColumn("value", is_amount(F.col("text"))), pages).withColumn("space", F.greatest(F.col("height") * 1.8, F.least(F.col("spacing"), F.col("height") * 5)))
    several = (F.col("quantity").isNotNull().cast("int") + F.col("price").isNotNull().cast("int") + F.col("total").isNotNull().cast("int")) >= 2
    donors = rows.filter(several & ~F.col("words"))
    owners = rows.filter(F.col("words") & F.col("quantity").isNull() & F.col("price").isNull())
    own = owners.withColumns({"low": F.col("y") - F.col("space") * 1.35, "high": F.col("y") + F.col("space") * 1.35})
    near = _banded(own, "low", "high", "space").select("page", "__band", F.col("row").alias("owner"), F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("total").alias("ototal"), F.col("code").alias("ocode"))
    code_y = cells.filter("row IS NOT NULL AND kind = 'code'").groupBy("page", "row").agg(F.min("y").alias("code_y"))
    d = donors.join(code_y, ["page", "row"], "left").withColumn("__band", F.floor(F.col("y") / F.col("space")).cast("long"))
    dy = F.abs(F.col("oy") - F.col("y"))
    unit = F.greatest(F.lit(8.0), F.col("space"))
    total = F.coalesce("ototal", "total")
    rate = F.when((F.col("discount") > 0) & (F.col("discount") < 80), 1 - F.col("discount") / 100).otherwise(1.0)
    fits = F.abs(F.col("quantity") * F.col("price") * rate - total) <= F.greatest(F.lit(0.06), F.abs(total) * 0.01)
    gains = [(F.col("ox") < F.col("x"), 6), (F.col("code"), 10), (F.col("code") & F.col("ocode"), -80), (F.abs(F.col("ototal") - F.col("total")) > 0.05, -400), (fits, 12)]
    score = 48 - dy / unit * 28 + 24 + 8 + 6 + F.coalesce(F.greatest(F.lit(0.0), 8 - F.abs(F.col("code_y") - F.col("oy")) / unit * 8), F.lit(0.0))
    for holds, gain in gains:
        score = score + F.when(holds, float(gain)).otherwise(0.0)
    met = d.join(near, ["page", "__band"]).filter(dy <= F.col("space") * 1.35)
    c = met.groupBy("page", "row").agg(F.sort_array(F.collect_list(F.struct(dy.alias("dy"), "oy", "ox", "owner", score.alias("score")))).alias("c"))
    slots = F.transform("c", lambda s: F.struct(s["owner"].cast("string").alias("slot"), s["score"].alias("score")))
    none = F.array().cast("array<struct<slot:string,score:double>>")
    wanted = donors.select("page", "row", "y", "x").join(c.select("page", "row", slots.alias("candidates")), ["page", "row"], "left").withColumn("candidates", F.coalesce("candidates", none))
    kind = cells.schema["row"].dataType
    return greedy(wanted, "page", ["y", "x", "row"]).select("page", "row", F.col("slot").cast(kind).alias("owner"), "status")
