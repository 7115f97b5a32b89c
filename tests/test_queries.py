"""Every query with an oracle against DuckDB on the smallest tables; all of them keep their result when the input is dealt out anew."""

import math
import os

import duckdb
import pytest
from foliant import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else repr(x)
    return x if x is None else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, duck, name):
    found, want = registry.queries()[name](spark, D), duck.sql(registry.oracles()[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(cell(r[c]) for c in columns) for r in found.collect()), key=repr)
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(cell(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_queries_without_oracle_run(spark):
    for name in registry.queries().keys() - registry.oracles().keys():
        assert registry.queries()[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
