"""Shared-folder tables and input-size helpers of the corpus operators."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.shared import new_path, shared_dir, stored  # noqa: F401


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Write ``df`` once to a table in the shared folder with n buckets by ``key`` and read it back: grouping and
    cogrouping by the key then move the other side alone. ``df`` should be dealt out by the key already. The catalog
    forgets the table at once; its files stay, like all tables there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one scan of one column, one number to the driver."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def partitions_for(docs: DataFrame, bytes_each: int) -> int:
    """How many chunks of ``bytes_each`` text the table makes, and as many as shuffle partitions at least."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-text_bytes(docs) // bytes_each))


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fold_of_value(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n
