"""Greedy assignment against a plain loop; odd cells."""

import random

from foliant.operators import cells as C


def loop(requests):
    """(id, slot, status) of a page's requests (id, candidates) in order."""
    taken, out = set(), []
    for i, candidates in requests:
        free = [c for c in candidates if c[0] not in taken]
        best = sorted(range(len(free)), key=lambda k: (-free[k][1], k))
        if not free or free[best[0]][1] <= 0:
            out.append((i, None, "taken" if len(free) < len(candidates) else "none"))
        elif len(free) > 1 and free[best[0]][1] < free[best[1]][1] + 8:
            out.append((i, None, "ambiguous"))
        else:
            taken.add(free[best[0]][0])
            out.append((i, free[best[0]][0], "attached"))
    return out


def test_greedy(spark):
    r = random.Random(2)
    pages = {p: [(i, [(str(s), float(r.randrange(-20, 60))) for s in r.sample(range(8), r.randrange(0, 4))]) for i in range(r.randrange(1, 25))] for p in range(80)}
    rows = spark.createDataFrame([(p, i, c) for p, xs in pages.items() for i, c in xs], "page long, id long, candidates array<struct<slot:string,score:double>>").repartition(5)
    found = {}
    for x in sorted(C.greedy(rows, "page", ["id"]).collect(), key=lambda x: (x.page, x.id)):
        found.setdefault(x.page, []).append((x.id, x.slot, x.status))
    assert found == {p: loop(xs) for p, xs in pages.items()}
    assert C.greedy(rows.limit(0), "page", ["id"]).count() == 0


CELLS = "page long, id long, row long, row_y double, x double, y double, kind string, text string"


def page(*cells):
    return [(1, k, *c) for k, c in enumerate(cells)]


def reattached(spark, cells):
    pages = spark.createDataFrame([(1, 12.0, 100.0)], "page long, height double, spacing double")
    return {x.id: (x.slot, x.status) for x in C.reattach_cells(spark.createDataFrame(cells, CELLS), pages).collect()}


def test_cells_of_rows(spark):
    cells = page(
        (1, 100.0, 10.0, 100.0, "description", "wooden"), (2, 200.0, 10.0, 200.0, "description", "steely"), (3, 300.0, 10.0, 300.0, None, "Totale imponibile"),
        (None, None, 50.0, 108.0, "quantity", "3"),  # 3: beside row 1
        (None, None, 50.0, 150.0, "quantity", "4"),  # 4: between two rows, of which one is taken
        (None, None, 50.0, 260.0, "quantity", "x"),  # 5: no amount
        (None, None, 90.0, 101.0, "total", "12,00"), (None, None, 90.0, 102.0, "total", "9,00"),  # 6, 7: contested
        (None, None, 90.0, None, "total", "1,00"), (None, None, 90.0, 201.0, "notes", "1,00"), (None, None, 90.0, 201.0, None, None),
        (9, 205.0, 90.0, 205.0, "price", "5,00"),  # 11: a row of its own without an anchor
        (2, 200.0, 90.0, 200.0, "total", "7"),  # 12: a stray whole number where a total belongs
        (None, None, 90.0, 203.0, "total", "20,00"),  # 13
    )
    found = reattached(spark, cells)
    assert found[3] == ("1/quantity", "attached") and found[4][0] in ("2/quantity", None)
    # the second of two totals beside row 1 is still within reach of row 2, and so pushes the next one on
    assert found[6] == ("1/total", "attached") and found[7] == ("2/total", "attached") and found[13] == ("3/total", "attached")
    assert found[11] == ("2/price", "attached")
    assert set(found) == {3, 4, 6, 7, 11, 13}
    assert reattached(spark, []) == {}


def test_an_ambiguous_cell_stays_open(spark):
    cells = page((1, 100.0, 10.0, 100.0, "description", "wooden"), (2, 200.0, 10.0, 200.0, "description", "steely"), (None, None, 50.0, 150.0, "price", "3,50"))
    assert reattached(spark, cells) == {2: (None, "ambiguous")}


def test_rows_of_numbers(spark):
    pages = spark.createDataFrame([(1, 12.0, 40.0)], "page long, height double, spacing double")
    cells = page(
        (1, 100.0, 10.0, 100.0, "description", "wooden"), (2, 120.0, 400.0, 120.0, "quantity", "2"), (2, 120.0, 500.0, 120.0, "price", "5,00"), (2, 120.0, 600.0, 120.0, "total", "10,00"),
        (3, 400.0, 400.0, 400.0, "quantity", "2"), (3, 400.0, 500.0, 400.0, "price", "5,00"), (4, 800.0, 500.0, 800.0, "price", "5,00"),
    )
    found = sorted((x.row, x.owner, x.status) for x in C.assign_clusters(spark.createDataFrame(cells, CELLS), pages).collect())
    assert found == [(2, 1, "attached"), (3, None, "none")]


def test_scan_has_no_page_in_memory(spark):
    rows = spark.createDataFrame([], "page long, id long, candidates array<struct<slot:string,score:double>>")
    plan = C.greedy(rows, "page", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan


def test_headers_go_on_over_pages(spark):
    from foliant.operators.tables import table_items

    head = [(10.0, 0.0, "Descrizione"), (200.0, 0.0, "Qta"), (300.0, 0.0, "Prezzo")]
    row = [(10.0, 60.0, "wood"), (200.0, 60.0, "2"), (300.0, 60.0, "5,00")]
    other = [(10.0, 0.0, "Qta"), (200.0, 0.0, "Descrizione")]
    pages = [("a", 1, 0.0, row), ("a", 2, 0.0, head + row), ("a", 3, 50.0, row), ("a", 4, -5.0, [*row, (700.0, 60.0, "far")]), ("a", 6, 0.0, other + row), ("a", 7, 0.0, row), ("b", 9, 0.0, row)]
    cells = [(d, p, x + dx, y, t) for d, p, dx, xs in pages for x, y, t in xs]
    frame = spark.createDataFrame(cells, "doc_id string, page int, x double, y double, text string")
    found = {(x.doc_id, x.page): (x.description, x.quantity, x.price) for x in table_items(frame, reach=30.0, inherit=True).collect()}
    full = ("wood", 2.0, 5.0)
    assert found == {("a", 2): full, ("a", 3): full, ("a", 4): full, ("a", 6): ("2", None, None), ("a", 7): ("2", None, None)}
    assert {(x.doc_id, x.page) for x in table_items(frame, reach=30.0).collect()} == {("a", 2), ("a", 6)}
    assert table_items(frame.limit(0), inherit=True).count() == 0


def test_levels(spark):
    from foliant.operators.levels import select_level

    none = None
    docs = {
        1: (["a", "SUMMARY"], [(0, "wooden table", 2.0, 5.0, 10.0), (0, "steel frame", 1.0, 5.0, 5.0), (1, "wooden table steel frame", none, none, 15.0)], 15.0),
        2: (["a", "Total quantity"], [(0, "wooden table", none, none, 1.0), (1, "wooden table", 2.0, 5.0, 10.0), (1, "wooden table", 1.0, 5.0, 5.0)], 15.0),
        3: (["a", "RECAP"], [(0, "wooden table", 2.0, 5.0, 10.0), (1, "glass door", 1.0, 5.0, 5.0)], 15.0),
        4: (["a", "Riepilogo IVA"], [(0, "wooden table", 2.0, 5.0, 10.0), (1, "Riepilogo IVA 22", none, none, 5.0)], none),
        5: (["a"], [(0, "wooden table", 2.0, 5.0, 10.0), (0, "wooden table 10.000 pz", none, none, 9.0)], none),
        6: (["a"], [(0, "wooden table", 2.0, 5.0, 10.0), (0, "glass door 10.000 pz", none, none, 9.0)], none),
        7: (["SUMMARY"], [(0, None, none, none, none)], none),
    }
    lines = spark.createDataFrame([(d, k, t) for d, (ts, _, _) in docs.items() for k, t in enumerate(ts)], "doc long, line int, text string")
    items = spark.createDataFrame([(d, *x) for d, (_, xs, _) in docs.items() for x in xs], "doc long, line int, description string, quantity double, price double, total double")
    totals = spark.createDataFrame([(d, t) for d, (_, _, t) in docs.items()], "doc long, document_total double")
    found = {}
    for x in select_level(items, lines, totals).collect():
        found.setdefault(x.doc, [x.reason]).append(x.level)
    assert {d: (x[0], sorted(x[1:])) for d, x in found.items()} == {
        1: ("details_kept", ["detail", "detail"]), 2: ("summary_reconciles", ["summary", "summary"]), 3: ("additive_tables", ["detail", "summary"]), 4: ("totals_heading", ["detail"]),
        5: ("details_kept", ["detail"]), 6: ("no_repeated_words", ["detail", "summary"]), 7: ("single_item", ["only"]),
    }


def test_amounts_as_they_are_parsed(spark):
    from foliant.functions.money import parse_amount

    texts = ["7", "12,50", "12.50", "1.234", "1.234,50", "1 234,50", "-3", "−3,00", "€ 5,00", "5,00 EUR", "12.05.2024", "1.2.20", "wooden", "", " ", None, "0", "007", "1,5", "12,500", "123456789012345", "1234567890123456789", "123456789012345,67", "3%", "3 pz", "٣", "1,00\n", "5,00 6,00"]
    frame = spark.createDataFrame([(x,) for x in texts], "text string")
    found = frame.select("text", C.is_amount(frame.text).alias("a"), parse_amount(frame.text)["value"].alias("b")).collect()
    assert [(x.text, x.a) for x in found] == [(x.text, x.b) for x in found] and sum(x.a is None for x in found) < 15


def test_amounts_are_read_once(spark):
    """What claims are made of is a table, so texts are not parsed again for each use of a cell."""
    pages = spark.createDataFrame([(1, 12.0, 100.0)], "page long, height double, spacing double")
    cells = page((1, 100.0, 10.0, 100.0, "description", "wooden"), (None, None, 50.0, 108.0, "quantity", "3"), (None, None, 50.0, 108.0, "total", "3,00"))
    found = C.reattach_cells(spark.createDataFrame([*cells, (None, 9, None, None, 1.0, 100.0, "price", "5,00"), (2, 10, None, None, 1.0, 100.0, "price", "5,00")], CELLS), pages)
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(x.page, x.id): (x.slot, x.status) for x in found.collect()} == {(1, 1): ("1/quantity", "attached"), (1, 2): ("1/total", "attached"), (None, 9): (None, "none"), (2, 10): (None, "none")}
