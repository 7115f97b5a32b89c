"""table_items where a line of an order is there more than once."""

import duckdb
from foliant import registry

LINES = "SELECT l_orderkey::BIGINT AS l_orderkey, 1::INT AS l_linenumber, {}::BIGINT AS l_partkey, {}::DOUBLE AS l_quantity FROM range({}) r(l_orderkey)"


def test_the_first_of_repeated_lines(spark, tmp_path):
    """Spark opens the larger file first; the line of the first file counts, as in the SQL over one thread."""
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for k, one in enumerate((LINES.format("l_orderkey + 1", "CASE WHEN l_orderkey > 0 THEN 2 END", 3), LINES.format("l_orderkey * 7 + 50", "l_orderkey % 9 + 10", 5000))):
        con.execute(f"COPY ({one}) TO '{folder}/part-{k}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    columns = "doc_id, description, quantity, price, total, consistent"
    want = con.sql(f"SELECT {columns} FROM ({registry.oracles()['table_items']}) ORDER BY doc_id").fetchall()
    found = registry.queries()["table_items"](spark, str(tmp_path)).select(*columns.split(", ")).orderBy("doc_id").collect()
    assert want[:2] == [(0, "part 1", 1000, 1100, 11000, True), (1, "part 2", 200, 1200, 2400, True)]
    assert [tuple(x) for x in found] == want
