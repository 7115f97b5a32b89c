"""Regions of documents and zones of pages as scans over lines in order.

Both are state machines over a page or document. Here each state is a window over events: what a recap holds until a table opens,
whether a table is open, and whether a customer's block still goes on. So lines stay rows, Spark sorts them once for each
partition of the windows, and no page is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.parsing import zone_kind
from foliant.functions.regions import region_of

#: Kinds of lines that end a customer's block, that end a table, and that a customer's block takes over.
ENDS_CUSTOMER = ["metadata", "items_table", "tax_summary", "totals", "payment", "notes"]
ENDS_TABLE = ["totals", "tax_summary", "payment", "notes"]
#: A customer's block outlives so many lines of another kind, less one.
REACH = 4
#: Above and below these shares of the page a line without a kind belongs to its header and footer.
TOP, BOTTOM = 0.16, 0.84


def annotate_regions(lines: DataFrame, doc: list[str], order: list[str], text: str = "text", zone: str = "zone") -> DataFrame:
    """``lines`` with region, confidence and reason. A recap of taxes or earlier orders goes on over lines of little
    confidence (below 0.75) and over pages until a table's header or body; totals within it stay totals. Null texts are empty
    lines, which a recap takes over, too; lines that are alike in ``order`` keep no defined order."""
    w = Window.partitionBy(*doc).orderBy(*order)
    known = lines.withColumn("__r", region_of(F.col(text), F.col(zone)))
    region = F.col("__r.region")
    recap, table = region.isin("historical_recap", "tax_recap"), region.isin("commercial_table_header", "commercial_table_body")
    event = F.when(recap, region).when(table, F.lit("")).otherwise(None)
    # an event holds from the line behind it on
    held = known.withColumn("__event", event).withColumn("__latch", F.last("__event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    latched = (F.coalesce("__latch", F.lit("")) != "") & ~recap & ~table & (region != "document_totals") & (F.col("__r.confidence") < 0.75)
    return held.select(
        *lines.columns,
        F.when(latched, F.col("__latch")).otherwise(region).alias("region"),
        F.col("__r.confidence").alias("confidence"),
        F.when(latched, F.concat(F.col("__r.reason"), F.lit("+latched_recap"))).otherwise(F.col("__r.reason")).alias("reason"),
    )


def classify_lines(lines: DataFrame, page: list[str], order: list[str], text: str = "text", in_header: Column | None = None, in_body: Column | None = None, center: Column | None = None) -> DataFrame:
    """``lines`` with kind, reason and requires_review. A line is what the table's geometry or its words say. A customer's block takes
    over the lines behind it that say nothing or name an issuer, until a line that ends it or three subjects in a row;
    an open table takes over what is left; then the place on the page decides (``center``, from 0 to 1)."""
    no = F.lit(False)
    header, body = F.coalesce(no if in_header is None else in_header, no), F.coalesce(no if in_body is None else in_body, no)
    kind = F.when(header | body, "items_table").otherwise(zone_kind(F.coalesce(F.col(text), F.lit(""))))
    w = Window.partitionBy(*page).orderBy(*order)
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = lines.withColumns({"__kind": kind, "__header": header, "__body": body, "__at": F.row_number().over(w)})
    # a block ends at a line of ENDS_CUSTOMER, and at the last of REACH - 1 subjects in a row
    d = d.withColumn("__run", F.col("__at") - F.coalesce(F.last(F.when(~F.coalesce(F.col("__kind") == "subject", no), F.col("__at")), True).over(so_far), F.lit(0)))
    d = d.withColumn("__block", F.sum((F.coalesce(F.col("__kind").isin(ENDS_CUSTOMER), no) | (F.col("__run") == REACH - 1)).cast("int")).over(so_far))
    in_block = Window.partitionBy(*page, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.max(F.coalesce(F.col("__kind") == "customer", no)).over(in_block), no)
    near = opened & (F.col("__kind").isNull() | (F.col("__kind") == "issuer"))
    d = d.withColumn("__near", near).withColumn("__own", F.when(F.col("__near"), "customer").otherwise(F.col("__kind")))
    state = F.when(F.col("__own") == "items_table", True).when(F.col("__own").isin(ENDS_TABLE), False)
    d = d.withColumn("__table", F.coalesce(F.last(state, True).over(before), no))
    at = F.lit(None).cast("double") if center is None else center
    place = F.when(at <= TOP, "header").when(at >= BOTTOM, "footer")
    found = F.when(F.col("__own").isNotNull(), F.col("__own")).when(F.col("__table"), "items_table").otherwise(F.coalesce(place, F.lit("unknown")))
    reason = (
        F.when(F.col("__near"), "party_field_near_customer_anchor")
        .when(F.col("__header"), "geometric_table_header")
        .when(F.col("__body"), "within_geometric_table_bounds")
        .when(F.col("__own").isNotNull(), F.concat(F.col("__own"), F.lit("_words")))
        .when(F.col("__table"), "within_table_bounds")
        .when(place == "header", "upper_page_geometry")
        .when(place == "footer", "lower_page_geometry")
        .otherwise("no_universal_zone_signal")
    )
    review = F.col("__near") | (~F.col("__header") & (F.col("__body") | F.col("__own").isNull() | (F.col("__own") == "issuer")))
    return d.select(*lines.columns, found.alias("kind"), reason.alias("reason"), F.coalesce(review, F.lit(True)).alias("requires_review"))
