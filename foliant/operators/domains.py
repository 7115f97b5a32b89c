"""Mail domains cut short or misread, completed from the domains of the other rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import GENERIC_MAIL_DOMAINS

# Ends of domains that are completed, letters of a domain that others are completed to.
ENDS = ["it", "com", "net", "org", "eu", "io"]
LEAST = 3
#: Letters that a misread domain may be off, and by how much its length may differ.
OFF = 2
#: A domain is completed to one so many times as frequent, and only if no other candidate is near that in frequency.
RATIO = 3


def _shorter(word: Column) -> Column:
    """The word with up to OFF letters left out, each once: two words within OFF edits share one of these."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.substring(w, 1, k - 1), F.substr(w, k + 1)))
    once = cut(word)
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, cut))))


def complete_domains(rows: DataFrame, id_: str = "id", email: str = "email") -> DataFrame:
    """``rows`` with completed (the address with its domain completed, or as it is) and status: kept, completed, ambiguous or none.

    Domains (a root and one of ENDS) are counted over all rows. One that begins a longer root, or is within OFF edits of a root of LEAST
    letters or more, with the same end, is completed to it if that is RATIO times as frequent. If another candidate has more than a
    RATIO-th of its rows, it stays open. Addresses at generic hosts, of other shapes and null ones have status none."""
    address = F.lower(F.trim(F.col(email)))
    shape = r"^[^@\s]+@([a-z0-9][a-z0-9-]*)\.(" + "|".join(ENDS) + ")$"
    host = F.regexp_extract(address, shape, 1)
    known = (host != "") & ~F.substring_index(address, "@", -1).isin(GENERIC_MAIL_DOMAINS)
    r = rows.withColumns({"__root": F.when(known, host), "__end": F.when(known, F.regexp_extract(address, shape, 2))})
    n = r.filter("__root IS NOT NULL").groupBy("__root", "__end").agg(F.count("*").alias("n"))
    roots = n.filter(F.length("__root") >= LEAST)
    own, full = n.select(F.col("__root").alias("short"), "__end", F.col("n").alias("few")), roots.select(F.col("__root").alias("long"), "__end", F.col("n").alias("many"))
    # a beginning is met by the beginnings of the root, a misread one by what both are with letters left out
    begins = full.withColumn("short", F.explode(F.transform(F.sequence(F.lit(2), F.length("long")), lambda k: F.substring(F.col("long"), 1, k)))).join(own, ["short", "__end"])
    variants = full.withColumn("v", F.explode(_shorter(F.col("long")))).join(own.withColumn("v", F.explode(_shorter(F.col("short")))), ["v", "__end"])
    misread = variants.filter((F.abs(F.length("long") - F.length("short")) <= OFF) & (F.levenshtein("long", "short", OFF) >= 0))
    columns = ["short", "__end", "long", "few", "many"]
    pairs = begins.select(*columns).unionAll(misread.select(*columns)).filter((F.col("short") != F.col("long")) & (F.col("many") >= RATIO * F.col("few"))).distinct()
    w = Window.partitionBy("short", "__end").orderBy(F.desc("many"), "long")
    ranked = pairs.withColumns({"next": F.lead("many").over(w), "k": F.row_number().over(w)}).filter("k = 1")
    best = ranked.select(F.col("short").alias("__root"), "__end", "long", (F.col("many") < RATIO * F.coalesce("next", F.lit(0))).alias("open"))
    joined = r.join(best, ["__root", "__end"], "left")
    status = F.when(F.col("__root").isNull(), "none").when(F.col("long").isNull(), "kept").when(F.col("open"), "ambiguous").otherwise("completed")
    completed = F.when(status == "completed", F.concat(F.substring_index(address, "@", 1), F.lit("@"), F.col("long"), F.lit("."), F.col("__end"))).otherwise(F.col(email))
    return joined.select(*rows.columns, completed.alias("completed"), status.alias("status"))
