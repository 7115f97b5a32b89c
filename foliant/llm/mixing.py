"""Operator 4, mixing sources to target weights by Pfair scheduling.

Every source is a task whose weight is share / period, with whole shares that add up to the period. Its texts,
in an order given by a hash of their ids, are cut into blocks of ``BLOCK_CHARS`` characters. Block b is
released at slot floor(b * period / share) and due before slot ceil((b + 1) * period / share); each slot goes
to the released block with the earliest deadline. On one sequence this meets every deadline, so at any slot
t each source is within one block of its weight times t.

All lags are zero after a period, so the schedule repeats: one period is worked out by a fold over its slots
(``PERIOD`` slots, or as many as there are sources; one row of small integers), and the slot of any block
follows from it by arithmetic. No text is looked at for that and nothing is done in sequence over the data.
Running sums within a source are taken in two levels, over buckets of the id's hash and within a bucket, so
that a source with a third of all rows is not one task.

A source that has run out leaves its slots empty; the others keep to theirs, so their proportions stay.
``in_mix`` is true before the first slot that a source cannot fill: up to there all weights hold.

The target weights are the caller's, or by default in proportion to the square root of a source's rows.

Results for odd rows: a null source is the source ''. A null or empty text takes no room; a text longer than
a block takes up several, and stands at the first. Rows that share a doc_id follow each other by their text;
wholly equal rows are interchangeable. An empty table gives no rows. Columns of the input with the names of
results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm._tables import documents, stored

PERIOD = 1000
BLOCK_CHARS = 1 << 16
#: Rows that a bucket of one source should hold at most, on average.
BUCKET_ROWS = 20_000
RESULTS = ["block", "release", "deadline", "slot", "ordinal", "in_mix"]


def target_shares(docs: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD) -> DataFrame:
    """(source, share, period) of each source of ``docs``; sources that ``weights`` lacks weigh as its least."""
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in sorted(weights.items())], "source string, w double")
        sizes = sizes.join(given, "source", "left").withColumn("w", F.coalesce("w", F.lit(float(min(weights.values())))))
    else:
        sizes = sizes.withColumn("w", F.sqrt("n"))
    total = F.sum("w").over(Window.partitionBy())
    shares = sizes.withColumn("share", F.greatest(F.lit(1), F.round(F.col("w") / total * period)).cast("long"))
    return shares.select("source", "share", F.sum("share").over(Window.partitionBy()).alias("period"))


def schedule(shares: DataFrame) -> DataFrame:
    """(source, share, period, j, slot): the slot of each source's block j within one period."""
    row = shares.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "share"))).alias("s"), F.max("period").alias("period")).filter("period IS NOT NULL")
    # blocks that each source has had, and the sources picked so far
    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("had"), F.array().cast("array<int>").alias("picked"))

    def step(state: Column, slot: Column) -> Column:
        def offer(x: Column, j: Column) -> Column:
            had = F.get(state["had"], j)
            released = F.call_function("div", had * F.col("period"), x["share"]) <= slot
            due = F.call_function("div", (had + 1) * F.col("period") + x["share"] - 1, x["share"])
            return F.when((had < x["share"]) & released, F.struct(due.alias("due"), j.alias("j")))

        best = F.array_min(F.transform("s", offer))["j"]
        had = F.transform(state["had"], lambda x, j: x + F.when(j == best, 1).otherwise(0))
        return F.struct(had.alias("had"), F.concat(state["picked"], F.array(best)).alias("picked"))

    run = row.withColumn("picked", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, step, lambda s: s["picked"]))
    slots = run.select("s", "period", F.posexplode("picked").alias("slot", "pick"))
    named = slots.select(F.get("s", F.col("pick")).alias("x"), "period", F.col("slot").cast("long").alias("slot"))
    j = F.row_number().over(Window.partitionBy("x.source").orderBy("slot")) - 1
    return named.select(F.col("x.source").alias("source"), F.col("x.share").alias("share"), "period", j.cast("long").alias("j"), "slot")


def _hex_digits(docs: DataFrame) -> int:
    """Leading digits of the hash that make buckets of BUCKET_ROWS rows or fewer."""
    rows, digits = docs.count(), 1
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    return digits


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """All rows and columns of ``docs`` with block, release, deadline, slot, ordinal and in_mix. Ordered by slot and
    ordinal they are the mixture."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keyed = docs.drop(*RESULTS).withColumns({"__source": F.coalesce("source", F.lit("")), "__digest": digest, "__bucket": F.left(digest, F.lit(_hex_digits(docs))), "__chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")})
    sums = keyed.groupBy("__source", "__bucket").agg(F.sum("__chars").alias("__chars"))
    earlier = F.sum("__chars").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__chars")
    before = sums.select("__source", "__bucket", earlier.alias("__before"))
    within = Window.partitionBy("__source", "__bucket").orderBy("__digest", "doc_id", "text")
    ran = keyed.withColumn("__own", F.sum("__chars").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__chars"))
    placed = ran.join(before, ["__source", "__bucket"]).withColumn("ordinal", F.col("__before") + F.col("__own"))
    plan = stored(schedule(target_shares(docs, weights, period)), "schedule").select(F.col("source").alias("__source"), "share", "period", F.col("j").alias("__j"), F.col("slot").alias("__slot"))
    # a source of c characters cannot fill the slot of block ceil(c / block)
    needed = sums.groupBy("__source").agg(F.call_function("div", F.sum("__chars") + block - 1, F.lit(block)).alias("block"))
    short = _with_slot(needed, plan).agg(F.min("slot").alias("__end"))
    whole = _with_slot(placed.withColumn("block", F.call_function("div", F.col("ordinal"), F.lit(block))), plan)
    release = F.call_function("div", F.col("block") * F.col("period"), F.col("share"))
    deadline = F.call_function("div", (F.col("block") + 1) * F.col("period") + F.col("share") - 1, F.col("share"))
    end = short.first()
    final = whole.withColumns({"release": release, "deadline": deadline, "in_mix": F.col("slot") < F.lit((end and end[0]) or 0)})
    return final.select(*[c for c in docs.columns if c not in RESULTS], *RESULTS)


def _with_slot(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """Of rows (__source, block): their slot, share and period. The plan has a row for each slot of a period."""
    shares = plan.select("__source", "share", "period").distinct()
    rows = blocks.join(shares, "__source")
    rows = rows.withColumn("__j", F.pmod("block", "share"))
    return rows.join(plan.select("__source", "__j", "__slot"), ["__source", "__j"]).withColumn("slot", F.call_function("div", F.col("block"), F.col("share")) * F.col("period") + F.col("__slot"))


def in_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The columns and rows of ``docs``, range-partitioned and sorted into the mixture, so that files written
    from it hold the texts in training order."""
    place = {c: f"__kept_{c}" for c in RESULTS if c in docs.columns}
    mixed = mix(docs.withColumnsRenamed(place), weights)
    ordered = mixed.repartitionByRange("slot", "ordinal", "doc_id").sortWithinPartitions("slot", "ordinal", "doc_id")
    return ordered.drop(*RESULTS).withColumnsRenamed({v: k for k, v in place.items()}).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "block", "release", "deadline", "slot", "ordinal", "in_mix")


_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source AS raw, coalesce(source, '') AS source, coalesce(length(text), 0)::BIGINT AS c, md5(coalesce(doc_id::VARCHAR, '')) AS h, text FROM documents),
 w AS (SELECT source, sqrt(count(*)) AS w FROM d GROUP BY source),
 s AS (SELECT source, greatest(1, round(w / sum(w) OVER () * {PERIOD}))::BIGINT AS share FROM w),
 p AS (SELECT sum(share)::BIGINT AS period, list(share ORDER BY source) AS shares, list(source ORDER BY source) AS names FROM s),
 e(t, had, pick) AS (
   SELECT 0::BIGINT, list_transform(shares, lambda x: 0::BIGINT), 0::BIGINT FROM p
   UNION ALL
   SELECT t + 1, list_transform(had, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), best
   FROM (SELECT t, had, list_min(list_filter(list_transform(had, lambda x, i: CASE WHEN x < shares[i] AND x * period // shares[i] <= t THEN (((x + 1) * period + shares[i] - 1) // shares[i]) * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS best FROM e, p WHERE t < period)),
 plan AS (SELECT names[pick] AS source, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM e, p WHERE t > 0),
 o AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY source ORDER BY h, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ordinal FROM d),
 b AS (SELECT doc_id, raw, source, ordinal, ordinal // {BLOCK_CHARS} AS block FROM o),
 n AS (SELECT source, (sum(c) + {BLOCK_CHARS - 1})::BIGINT // {BLOCK_CHARS} AS block FROM d GROUP BY source),
 h AS (SELECT min(n.block // s.share * period + plan.slot) AS finish FROM n JOIN s USING (source) JOIN plan ON plan.source = n.source AND plan.j = n.block % s.share, p)
SELECT b.doc_id, b.raw AS source, b.block::BIGINT AS block, (b.block * period // s.share)::BIGINT AS release, (((b.block + 1) * period + s.share - 1) // s.share)::BIGINT AS deadline,
 (b.block // s.share * period + plan.slot)::BIGINT AS slot, b.ordinal, b.block // s.share * period + plan.slot < finish AS in_mix
FROM b JOIN s ON s.source = b.source JOIN plan ON plan.source = b.source AND plan.j = b.block % s.share, p, h
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": _SQL}
