"""Merging of pages, fields and sources: first and last values, ranked evidence with conflicts, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_last(pages: DataFrame, key: str, order: Column, first: list[str], last: list[str]) -> DataFrame:
    """Per document over its pages in order: the first non-null value of some columns and the last of others. Each is a
    min or max over (order, value), so it combines map-side and needs no sort."""
    def pick(c: str, f) -> Column:
        return f(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"].alias(c)

    return pages.groupBy(key).agg(*[pick(c, F.min) for c in first], *[pick(c, F.max) for c in last])


def best_candidate(candidates: DataFrame, keys: list[str], tolerance: float = 0.005) -> DataFrame:
    """Of candidates (keys, value double, validation int, confidence, method, page): the best of each field with its
    number of candidates, whether all agree, and the reason. A missing confidence ranks below all others."""
    # one sort by key, then sums alone: no list of a key's candidates is held
    w = Window.partitionBy(*keys).orderBy(F.desc("validation"), F.desc_nulls_last("confidence"), F.asc("value"), F.asc("page"))
    ranked = candidates.withColumn("first", F.row_number().over(w) == 1)
    own, rest = lambda c: F.max(F.when(F.col("first"), F.col(c))).alias(c), lambda c: F.max(F.when(~F.col("first"), F.col(c)))
    g = ranked.groupBy(*keys).agg(
        own("value"), own("validation"), own("confidence"), own("page"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        rest("validation").alias("next_validation"), rest("confidence").alias("next_confidence"), F.count("confidence").alias("n_confident"),
    )
    agree = (F.col("high") - F.col("value") < tolerance) & (F.col("value") - F.col("low") < tolerance)
    reason = (
        F.when(F.col("n") == 1, "single_candidate")
        .when(agree, "same_value_repeated")
        .when(F.col("validation") > F.col("next_validation"), "stronger_validation")
        .when((F.col("n_confident") == F.col("n")) & (F.col("confidence") > F.col("next_confidence")), "higher_reported_confidence")
        .otherwise("deterministic_conflict_tiebreak")
    )
    return g.select(*keys, "value", "page", "n", (~agree).alias("conflict"), reason.alias("reason"))


def reconcile_sources(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Two sources of (keys, value): the value, its origin, and whether they disagree."""
    l, r = local.withColumnRenamed("value", "local"), remote.withColumnRenamed("value", "remote")  # noqa: E741
    j = l.join(r, keys, "full_outer")
    status = F.when(F.col("remote").isNull(), "local_only").when(F.col("local").isNull(), "remote_only").when(F.col("local") == F.col("remote"), "agreed").otherwise("conflict")
    return j.select(*keys, F.coalesce("local", "remote").alias("value"), status.alias("status"))


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after, change) of every field of records in both tables."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("x")).select(key, "x.*")

    j = long(old, "before").join(long(new, "after"), [key, "field"])
    change = F.when(F.col("before").eqNullSafe(F.col("after")), "unchanged").when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "protected").otherwise("selectable")
    return j.select(key, "field", "before", "after", change.alias("change"))


def vote(readings: DataFrame, key: str, observed: str, value: str, quorum: int = 2) -> DataFrame:
    """Of repeated readings: the observed value stays if it has the quorum; it changes only where exactly one other has."""
    n = readings.groupBy(key, observed, value).agg(F.count("*").alias("n"))
    g = n.groupBy(key, observed).agg(F.max(F.when(F.col(value) == F.col(observed), F.col("n"))).alias("own"), F.count_if((F.col("n") >= quorum) & (F.col(value) != F.col(observed))).alias("rivals"), F.min(F.when((F.col("n") >= quorum) & (F.col(value) != F.col(observed)), F.col(value))).alias("rival"))
    changed = (F.coalesce("own", F.lit(0)) < quorum) & (F.col("rivals") == 1)
    return g.select(key, F.when(changed, F.col("rival")).otherwise(F.col(observed)).alias("selected"), changed.alias("changed"))


def repeated_elsewhere(lines: DataFrame, doc: str, page: str, hit: Column) -> DataFrame:
    """For each line that ``hit`` marks: how many marked lines its document has on other pages."""
    rows = lines.filter(hit)
    return rows.withColumn("elsewhere", F.count("*").over(Window.partitionBy(doc)) - F.count("*").over(Window.partitionBy(doc, page)))


def fold_agreement(candidates: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """Equal values of a field in one: the best score, raised by 0.05 for each further candidate, 1 at most."""
    return candidates.groupBy(*keys, value).agg(F.count("*").alias("n"), F.max(score).alias("top")).select(*keys, value, "n", F.least(F.lit(1.0), F.col("top") + 0.05 * (F.col("n") - 1)).alias("score"))


def best_attempt(attempts: DataFrame, key: str, index: str, score: str) -> DataFrame:
    """The attempt with the highest score; the earliest of equal ones."""
    return attempts.groupBy(key).agg(F.max_by(index, F.struct(F.col(score), -F.col(index))).alias(index), F.max(score).alias(score))


def decision_counts(rows: DataFrame, key: str, decision: str) -> DataFrame:
    """How many decisions of each kind a key has; other values don't count."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(decision) == x).alias(x) for x in ("pending", "accepted", "rejected", "manual")])
