"""Completed mail domains; ambiguous ones stay open."""

import random

from pyspark.sql import functions as F

from foliant.operators import domains as D


def statuses(spark, domains):
    rows = spark.createDataFrame([(k, f"u{k}@{x}" if x else x) for k, x in enumerate(x for x, n in domains for _ in range(n))], "id long, email string")
    found = {}
    for r in D.complete_domains(rows).collect():
        found[r.email and r.email.split("@")[-1]] = (r.completed and r.completed.split("@")[-1], r.status)
    return found


def test_completions(spark):
    found = statuses(spark, [("givi.it", 9), ("giv.it", 1), ("g1vi.it", 2), ("givi.com", 1), ("gi.eu", 1), ("gmail.com", 3), ("gmai.com", 1), ("acme.example", 1), (None, 1), ("", 1)])
    assert found["giv.it"] == found["g1vi.it"] == ("givi.it", "completed")
    assert found["givi.it"] == ("givi.it", "kept") and found["givi.com"] == ("givi.com", "kept") and found["gi.eu"][1] == "kept"
    assert found["gmail.com"][1] == "none" and found["gmai.com"][1] == "kept" and found["acme.example"][1] == found[None][1] == "none"


def test_two_candidates_stay_open(spark):
    found = statuses(spark, [("northwind.com", 9), ("northern.com", 6), ("north.com", 1), ("northe.com", 1)])
    assert found["north.com"] == ("north.com", "ambiguous")
    found = statuses(spark, [("northwind.com", 30), ("northern.com", 6), ("north.com", 1)])
    assert found["north.com"] == ("northwind.com", "completed")


def test_words_with_letters_left_out_meet(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(3, 8))) for _ in range(120)})
    rows = spark.createDataFrame([(w,) for w in words], "w string").withColumn("v", F.explode(D._shorter(F.col("w"))))
    met = {(x.w, x.o) for x in rows.join(rows.withColumnRenamed("w", "o"), "v").select("w", "o").distinct().collect()}
    far = spark.createDataFrame([(a, b) for a in words for b in words if a != b], "a string, b string").filter(F.levenshtein("a", "b") <= 2).collect()
    assert all((x.a, x.b) in met for x in far)


def test_no_rows(spark):
    assert D.complete_domains(spark.createDataFrame([], "id long, email string")).count() == 0
