"""List operations: search, filters, sorts with a stable ordinal, export batches, upserts and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import fold
from foliant.operators.shared import stored

BATCH = 30
LEAST_QUERY = 3


def matches(blob: Column, query: str, short_ids: bool = True) -> Column:
    """Accent- and case-insensitive containment. Queries under three letters match everything, but for
    identifiers of two characters with a letter and a digit."""
    q = query.strip()
    is_id = short_ids and len(q) >= 2 and any(c.isdigit() for c in q) and any("a" <= c.lower() <= "z" for c in q)
    if len(q) < LEAST_QUERY and not is_id:
        return F.lit(True)
    return F.contains(fold(blob), fold(F.lit(q)))


def search_blob(*columns: str) -> Column:
    """All columns that are not null, with spaces between."""
    return F.concat_ws(" ", *[F.col(c) for c in columns])


def display_name(first: Column, last: Column, company: Column, title: Column, fallback: str = "") -> Column:
    name = F.trim(F.concat_ws(" ", F.when(first != "", first), F.when(last != "", last)))
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(filled(name), filled(company), filled(title), F.lit(fallback))


def with_ordinal(df: DataFrame, *order: Column, name: str = "ordinal") -> DataFrame:
    """Adds 1, 2, 3 ... along ``order`` without sorting everything in one task: the rows are range-partitioned and
    sorted, and each partition numbers its own. They are written once; the partitions' sizes (one row each) come from
    that table, as another run of the same plan could draw other bounds between the partitions."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = {"__part": F.spark_partition_id(), "__own": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1}
    own = stored(ranged.withColumns(place), "ranged")
    sizes = own.groupBy("__part").agg(F.max("__own").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return own.join(F.broadcast(before), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def batches(df: DataFrame, ordinal: str = "ordinal", size: int = BATCH) -> DataFrame:
    """(batch, first, last, n): ordinal batches of ``size`` rows."""
    k = F.floor((F.col(ordinal) - 1) / size).cast("bigint") + 1
    return df.groupBy(k.alias("batch")).agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.count("*").alias("n"))


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Last writer wins: the row of the highest version of each key; a change beats a stored row of equal version."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    top = Window.partitionBy(key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__rank", F.row_number().over(top)).filter("__rank = 1").drop("__rank", "__new")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def live(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key still exists."""
    return table.join(keys.select(key), key, "left_semi")


def union_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables: a count each, no row of theirs is moved."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def register_once(table: DataFrame, requests: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Requests with ``created``: true for the first of each key that the table does not have yet."""
    known = table.select(*keys).distinct().withColumn("__known", F.lit(True))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    joined = requests.withColumn("__first", first).join(known, keys, "left")
    return joined.withColumn("created", F.col("__first") & F.col("__known").isNull()).drop("__first", "__known")


def bounded_int(value: Column, low: int, high: int) -> Column:
    """A setting's text as a whole number within bounds; null for anything else."""
    n = F.trim(value).try_cast("int")
    return F.when(F.trim(value).rlike(r"^-?\d+$") & n.between(low, high), n)
