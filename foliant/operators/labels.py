"""Labels in lines, types and languages of documents by them.

A line's words are joined with the first words of the labels by equality, and what meets is a match if the label stands in the line as
a whole; so the work follows the words of the lines and not lines times labels. This table is broadcast. Beyond ``BROADCAST`` labels
the line's runs of one to ``MOST_WORDS`` words are joined with the labels instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.checks import has_label, label_key
from foliant.functions.labels import TYPES

MOST_WORDS = 6
BROADCAST = 10_000
#: A document's languages are settled once one has so many points.
SETTLED = 6


def matches(lines: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``lines`` once for each label that stands in them as whole words, with the columns of ``labels``. Labels of more than
    MOST_WORDS words or of none, null and wordless texts match nothing."""
    table = labels.filter((F.col("words") <= MOST_WORDS) & (F.col("key") != ""))
    folded = lines.withColumn("__folded", label_key(F.col(text)))
    if table.count() <= BROADCAST:
        cut = folded.withColumn("__word", F.explode(F.array_distinct(F.split("__folded", " "))))
        return cut.join(F.broadcast(_by_first_word(table)), "__word").filter(has_label(F.col("__folded"), F.col("key"))).drop("__word", "__folded")
    cut = folded.withColumn("__words", F.split("__folded", " ")).withColumn("__n", F.size("__words"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(MOST_WORDS)), lambda k: F.when(F.col("__n") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.col("__n") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("__words", i, k), " "))).otherwise(F.array().cast("array<string>"))))
    return cut.withColumn("key", F.explode(F.array_distinct(runs))).drop("__folded", "__words", "__n").join(table, "key")


def _by_first_word(table: DataFrame) -> DataFrame:
    return table.withColumn("__word", F.split("key", " ")[0])


def line_labels(lines: DataFrame, labels: DataFrame, line: list[str], concepts: list[str], text: str = "text") -> DataFrame:
    """(*line, concept, language, label, type) of all lines: what ``find_labels`` and ``document_types`` say of them, null where they
    say nothing. A line with a null in ``line`` has no labels, as in a join with theirs.

    Up to BROADCAST labels, the lines meet the labels once. The labels are ranked beforehand, so that the least rank of a line decides."""
    known = F.lit(True)
    for c in line:
        known = known & F.col(c).isNotNull()
    wanted = labels.filter(F.col("concept").isin(*concepts, *TYPES) & (F.col("words") <= MOST_WORDS) & (F.col("key") != ""))
    if wanted.count() > BROADCAST:
        found = find_labels(lines, labels, line, concepts, text)
        return lines.select(*line).join(found, line, "left").join(document_types(lines, labels, line, text), line, "left").select(*line, "concept", "language", "label", "type")
    ranked = wanted.withColumn("__rank", F.when(F.col("concept").isin(concepts), F.row_number().over(Window.partitionBy(F.col("concept").isin(concepts)).orderBy(_order(concepts)))))
    table = _by_first_word(ranked).select("__word", "key", "__rank", F.when(F.col("concept").isin(TYPES), _place(TYPES)).alias("__type"))
    # every line meets this one, so that those without a label stay
    table = table.unionAll(table.sparkSession.createDataFrame([("", "", None, None)], table.schema))
    cut = lines.select(*line, F.when(known, label_key(F.col(text))).alias("__folded"))
    words = F.array_union(F.array(F.lit("")), F.coalesce(F.split("__folded", " "), F.array().cast("array<string>")))
    met = cut.withColumn("__word", F.explode(words)).join(F.broadcast(table), "__word").filter((F.col("__word") == "") | has_label(F.col("__folded"), F.col("key")))
    least = met.groupBy(*line).agg(F.min("__rank").alias("__rank"), F.min("__type").alias("__type"))
    named = ranked.filter("__rank IS NOT NULL").select("__rank", "concept", "language", "label")
    return least.join(F.broadcast(named), "__rank", "left").select(*line, "concept", "language", "label", F.get(F.array(*[F.lit(c) for c in TYPES]), F.col("__type") - 1).alias("type"))


def _place(concepts: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in concepts]), F.col("concept")).cast("int")


def _order(concepts: list[str]) -> Column:
    return F.struct((-F.col("priority")).alias("a"), (-F.length("label")).alias("b"), _place(concepts).alias("c"), F.col("place").alias("d"))


def find_labels(lines: DataFrame, labels: DataFrame, line: list[str], concepts: list[str], text: str = "text") -> DataFrame:
    """(*line, concept, language, label): the best label of a line among the concepts: the highest priority, the longest, the first in
    the order of the concepts and of the table."""
    found = matches(lines.select(*line, text), labels.filter(F.col("concept").isin(concepts)), text)
    best = found.groupBy(*line).agg(F.min_by(F.struct("concept", "language", "label"), _order(concepts)).alias("m"))
    return best.select(*line, "m.*")


def document_types(lines: DataFrame, labels: DataFrame, line: list[str], text: str = "text") -> DataFrame:
    """(*line, type): the first of the types that a line has a label of."""
    found = matches(lines.select(*line, text), labels.filter(F.col("concept").isin(TYPES)), text)
    return found.groupBy(*line).agg(F.min_by("concept", _place(TYPES)).alias("type"))


def document_languages(lines: DataFrame, labels: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """(doc, language, others, points, percent, mixed) of the documents with a label in their lines, which count in ``order`` until a
    language has SETTLED points.

    A label counts once in a line, for the first language that the table has it for: several words or twelve letters 2
    to 4, else 1. Mixed: the second language has 2 points and 0.35 of the first one's. Equal points go to the language first
    met."""
    one = labels.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("place"))).filter("k = 1").drop("k")
    found = matches(lines.select(doc, order, text).filter(label_key(F.col(text)).rlike("[a-z]{3}")), one, text)
    weight = F.when((F.col("words") > 1) | (F.length("key") >= 12), F.greatest(F.lit(2), F.least(F.lit(4), F.col("words")))).otherwise(1)
    scored = found.groupBy(doc, order, "language").agg(F.sum(weight).alias("w"))
    so_far = Window.partitionBy(doc, "language").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(doc).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    run = scored.withColumn("sum", F.sum("w").over(so_far)).withColumn("lead", F.max("sum").over(before))
    points = run.filter(F.coalesce(F.col("lead") < SETTLED, F.lit(True))).groupBy(doc, "language").agg(F.sum("w").alias("points"), F.min(order).alias("first"))
    ranked = points.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("p"), "first", "language"))).alias("r"), F.sum("points").alias("all"))
    first, second = -F.get("r", F.lit(0))["p"], F.coalesce(-F.get("r", F.lit(1))["p"], F.lit(0))
    percent = F.floor(F.least(F.lit(1.0), first / F.greatest(F.lit(4), F.col("all"))) * 100 + 0.5)
    mixed = (F.size("r") > 1) & (second >= F.greatest(F.lit(2.0), first * 0.35))
    others = F.array_join(F.transform(F.slice("r", 2, 5), lambda x: x["language"]), ",")
    return ranked.select(doc, F.get("r", F.lit(0))["language"].alias("language"), others.alias("others"), first.alias("points"), percent.alias("percent"), mixed.alias("mixed"))
