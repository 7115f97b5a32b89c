"""Operators on rows in order: reading limits, scan order, repeated and continued rows, roles of dates, leases given back.

Windows go over the lines of one page or document; Spark sorts and spills them, and no line is gathered into a list but
the shipping rows of one page that follow each other (``drop_repeated_shipping``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.money import parse_date
from foliant.functions.parsing import _DATE, date_role, date_role_confidence

# Limits of reading, the rows that speak of shipping, and the amounts that count as one.
MOST_LINES, MOST_CHARS = 120, 180
SCAN_LINES, HEAD, TAIL = 80, 24, 16
SHIPPING = r"(?iu)\b(?:trasporto|transport|shipping|spedizione|porto|freight|log[ií]stica)\b"
SAME = 0.05
ISSUE_ORDER = {"order": ["order", "issue", "document"], "invoice": ["issue", "document", "order"], "quote": ["issue", "document", "order"], "quotation": ["issue", "document", "order"]}


def scan_order(lines: DataFrame, key: str, *order: str) -> DataFrame:
    """The first SCAN_LINES lines of each key with ``scan``, from 1: the head, then the tail, then what lies between."""
    own = Window.partitionBy(key)
    placed = lines.withColumns({"__n": F.row_number().over(own.orderBy(*order)) - 1, "__all": F.least(F.count("*").over(own), F.lit(SCAN_LINES))}).filter(F.col("__n") < SCAN_LINES)
    part = F.when(F.col("__n") < HEAD, 0).when(F.col("__n") >= F.col("__all") - TAIL, 1).otherwise(2)
    return placed.withColumn("scan", F.row_number().over(own.orderBy(part, "__n"))).drop("__n", "__all")


def clamp_lines(lines: DataFrame, key: str, text: str, *order: str) -> DataFrame:
    """The first MOST_LINES lines of each key, each with its first MOST_CHARS characters."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return lines.withColumn("__at", at).filter(F.col("__at") <= MOST_LINES).drop("__at").withColumn(text, F.left(text, F.lit(MOST_CHARS)))


def page_order(pages: DataFrame, doc: str, *order: str) -> DataFrame:
    """``place`` of each page of a document, from 1, by the given columns in turn."""
    return pages.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def block_order(blocks: DataFrame, doc: str, band: float = 6.0) -> DataFrame:
    """``place`` of each block (page, x, y, id), from 1: by page, bands of ``band`` from the top, and from the left."""
    return page_order(blocks.withColumn("__band", F.floor(F.col("y") / band)), doc, "page", "__band", "x", "y", "id").drop("__band")


def drop_repeated_shipping(items: DataFrame, page: list[str], order: str) -> DataFrame:
    """Of shipping rows (description, total) that follow each other on a page, those that repeat the last kept one go: an
    equal or a missing total. If the first has no total, the first one with a total stands for it."""
    w = Window.partitionBy(*page).orderBy(order)
    about = F.coalesce(F.col("description").rlike(SHIPPING), F.lit(False))
    runs = items.withColumn("__about", about).withColumn("__run", F.sum((~about).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = runs.filter("__about").groupBy(*page, "__run").agg(F.array_sort(F.collect_list(F.struct(order, "total"))).alias("rows"))

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)["total"]
        return F.when(x["total"].isNull() | (F.abs(x["total"] - last) <= SAME), kept).otherwise(F.concat(kept, F.array(x)))

    priced = F.filter("rows", lambda x: x["total"].isNotNull())
    start = F.slice(F.when(F.size(priced) > 0, priced).otherwise(F.col("rows")), 1, 1)
    kept = rows.select(*page, F.explode(F.aggregate("rows", start, step)).alias("__kept")).select(*page, F.col(f"__kept.{order}").alias(order))
    columns = items.columns
    return runs.filter("NOT __about").select(*columns).unionAll(runs.filter("__about").join(kept, [*page, order], "left_semi").select(*columns))


def join_continued(lines: DataFrame, page: list[str], order: str, text: str, unfit: Column) -> DataFrame:
    """Lines that start with 'e ' are joined to the line before them on the page, unless that one is ``unfit``, has no words or
    more than six, or was itself joined; so of candidates in a row every second one is."""
    w = Window.partitionBy(*page).orderBy(order)
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    fit = lines.withColumn("__fit", words.between(1, 6) & ~F.coalesce(unfit, F.lit(False)))
    able = fit.withColumn("__able", F.coalesce(F.trim(text).rlike(r"(?iu)^e\s+") & F.lag("__fit").over(w), F.lit(False)))
    islands = able.withColumn("__island", F.sum((~F.col("__able")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the line that opens an island stands at 1, its candidates at 2, 3, ...
    at = F.row_number().over(Window.partitionBy(*page, "__island").orderBy(order)) - F.when(F.col("__island") > 0, 1).otherwise(0)
    gone = islands.withColumn("__gone", F.col("__able") & (at % 2 == 1))
    following = F.when(F.lead("__gone").over(w), F.concat(F.lit(" "), F.trim(F.lead(text).over(w)))).otherwise("")
    joined = gone.withColumn("__text", F.regexp_replace(F.concat(F.col(text), following), r"\s+", " "))
    return joined.filter("NOT __gone").withColumn(text, F.trim("__text")).select(*lines.columns)


def date_roles(lines: DataFrame, doc: str, text: str, kind: str) -> DataFrame:
    """(doc, issue, validity, due): of the lines (page, y, x, id) that hold a day and the label of a role, the best one for each.
    A day of issue may be that of an order or document; which comes first, the document's kind says. Then the label's
    confidence counts, and the place."""
    found = lines.select(doc, "page", "y", "x", "id", F.col(kind).alias("__kind"), date_role(F.col(text)).alias("role"), date_role_confidence(F.col(text)).alias("sure"), parse_date(F.regexp_extract(text, _DATE, 0), F.lit("it"))["value"].alias("day"))
    order = F.lit(0)
    for name, roles in ISSUE_ORDER.items():
        order = F.when(F.col("__kind") == name, F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role"))).otherwise(order)
    rank = F.struct(order.cast("long").alias("order"), (-F.col("sure")).alias("sure"), "page", "y", "x", "id")
    some = found.filter("day IS NOT NULL AND role IS NOT NULL AND sure >= 70 AND role <> 'delivery'").withColumn("rank", rank)
    best = lambda name, *roles: F.min_by(F.when(F.col("role").isin(*roles), F.col("day")), F.when(F.col("role").isin(*roles), F.col("rank"))).alias(name)
    return some.groupBy(doc).agg(best("issue", "issue", "document", "order"), best("validity", "validity"), best("due", "due"))


def give_back(leases: DataFrame, requests: DataFrame, lease: str, *order: str) -> DataFrame:
    """The requests with ``released``: whether the lease was there, which holds for the first request alone. A null lease is
    never there; such requests stay out of the window. ``leases`` has a row for each lease; those left are ``leases`` without the ones released."""
    named = F.col(lease).isNotNull()
    first = F.row_number().over(Window.partitionBy(lease).orderBy(*order)) == 1
    held = leases.select(F.col(lease).alias("__held")).distinct()
    known = requests.filter(named).withColumn("__first", first).join(held, F.col(lease) == F.col("__held"), "left").withColumn("released", F.col("__first") & F.col("__held").isNotNull()).drop("__first", "__held")
    return known.unionByName(requests.filter(~named).withColumn("released", F.lit(False)))
