"""From pages to products: sections, marks, tables without a header, review rows and totals."""

from pathlib import Path

import pytest

from quaytally.operators import rules
from quaytally.sources import grids as G
from quaytally.sources import pages as P

HEAD = ("MARKS", "SHOP", "ITEM NO", "DESCRIPTION", "PACKING", "T.CTN", "T.QTY", "U.PRICE (RMB)", "T.AMOUNT", "T.CBM", "T.WEIGHT")


def tr(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def alone(text):
    return tr(text, *[""] * (len(HEAD) - 1))


def table(*rows, head=HEAD):
    return "<table>" + (tr(*head) if head else "") + "".join(rows) + "</table>"


def product(marks, code, cartons, price=2, pieces=40):
    n = cartons * pieces
    return tr(marks, "s1", code, f"thing {code}", f"{pieces}pcs/ctn", f"{cartons} CTNS", n, price, n * price, cartons / 10, cartons * 2)


def chunks(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "document_id long, chunk int, html string")


def found(df, *columns):
    return [tuple(r) for r in df.orderBy("line_no").select(*columns).collect()]


def test_marks_go_down_inside_a_block_and_over_tables(spark):
    bar = tr("", "", "", "5 CTNS 0.5 CBM 10 KGS ¥ 400", *[""] * 7)
    parts = tr("", "", "", "FOOD WARMER PARTS", "", "1 CTN", 1, 2, 2, "", "")
    page = chunks(spark, table(product("A-1", "a", 1), product("", "b", 1), parts, bar, product("", "c", 1)) + table(product("", "d", 1)), "a text", table(product("", "e", 1), product("B-2", "f", 1)), table(product("", "g", 1)))
    assert found(P.products(P.walked(page)), "item_code", "marks") == [("a", "A-1"), ("b", "A-1"), (None, None), ("c", None), ("d", None), ("e", None), ("f", "B-2"), ("g", "B-2")]


def test_sections_carry_over_tables_and_chunks(spark):
    page = chunks(spark, "GOODS LEFT IN SANCARGO", table(product("A-1", "a", 1)), "NEW ORDER", table(product("A-1", "b", 1), alone("BEFORE GOODS MAG-4"), product("A-2", "c", 1)) + table(product("A-2", "d", 1), alone("Odds &amp; ends"), product("A-3", "e", 1)), table(product("A-3", "f", 1)))
    rows = found(P.products(P.walked(page)), "item_code", "section", "remarks")
    label = lambda x: f"section_label:{x}"
    gone = "carryover:before_goods;repair:before_goods_amount_carryover_ignored;"
    assert rows == [
        ("a", "left_in_warehouse", None), ("b", "shipped", None), ("c", "left_in_warehouse", gone + label("BEFORE%20GOODS%20MAG-4")),
        ("d", "left_in_warehouse", None), ("e", "odds_ends", label("Odds%20%26%20ends")), ("f", "odds_ends", None),
    ]


def test_a_table_without_header_goes_on_with_the_one_before(spark):
    more = tr("MS-301-2", "s2", "z", "lid", "40pcs/ctn", "2 CTNS", 80, 2, 160, 0.2, 4)
    page = chunks(spark, table(product("A-1", "a", 1)) + table(more, head=None), table(more, head=None))
    assert found(P.products(P.walked(page)), "marks", "item_code", "total_cartons", "total_amount_rmb") == [("A-1", "a", 1.0, 80.0), ("MS-301-2", "z", 2.0, 160.0)]


def test_review_rows(spark):
    page = chunks(spark, "CLIENT DETAILS: x", table(alone("NEW ORDER"), product("A-1", "a", 1), alone("TOTAL:"), alone("TOTAL WEIGHT 9 KGS"), tr("", *["NEW ORDER"] * 4, *[""] * 6)), table(tr("some", "text"), tr("12", "x"), head=None))
    rows = found(P.products(P.walked(page), full=True), "line_no", "item_code", "description", "remarks")
    assert rows == [
        (1, P.EXTRACT_CODE, "CLIENT DETAILS: x", "full_extract:text_block"), (2, P.EXTRACT_CODE, "NEW ORDER", "full_extract:new_order"), (3, "a", "thing a", "section_label:NEW%20ORDERS"),
        (4, P.EXTRACT_CODE, "TOTAL:", "full_extract:total_label"), (5, P.FOOTER_CODE, None, None), (6, P.EXTRACT_CODE, "NEW ORDER NEW ORDER NEW ORDER NEW ORDER", "full_extract:new_order"),
        (7, P.EXTRACT_CODE, "some text", "full_extract:unmapped_table_row"), (8, P.EXTRACT_CODE, "12 x", "full_extract:unmapped_table_row"),
    ]


def test_sales_table_in_one_call(spark):
    page = table(tr("1", "26C707-6083", "WIDGET-001", "Test widget desc", "48", "12.5", "600"), tr("2", "26C707-6083", "WIDGET-002", "cup", "10", "0", "25"), head=("序号", "DEL NO", "ITEM NO", "描述", "T.QTY", "U/P", "金额"))
    rows = found(P.parsed_products(chunks(spark, page), sales=True), "source_item_no", "item_code", "delivery_no", "total_quantity", "unit_price_rmb", "total_amount_rmb")
    assert rows == [("WIDGET-001", "WIDGET-001", "26C707-6083", 48.0, 12.5, 600.0), ("WIDGET-002", "WIDGET-002", "26C707-6083", 10.0, 2.5, 25.0)]


def test_totals_of_a_whole_manifest(spark):
    """The manifest of tests/fixtures: shipped rows add up to its printed totals, goods left and from before don't count."""
    page = (Path(__file__).parent / "fixtures/manifest.html").read_text()
    rows = P.parsed_products(chunks(spark, *page.split("<!-- next -->")))
    walked = P.walked(chunks(spark, *page.split("<!-- next -->")))
    sums = {r.section: r for r in rows.groupBy("section").agg({c: "sum" for c in ("total_cartons", "total_cbm", "total_weight_kg", "total_amount_rmb")}).collect()}
    shipped = sums["shipped"]
    printed = (1042, 70.125, 23183.0, 327239.30)
    assert [round(shipped[f"sum({c})"], 6) for c in ("total_cartons", "total_cbm", "total_weight_kg", "total_amount_rmb")] == list(printed)
    bars = P.section_subtotals(walked).where("section = 'shipped'").groupBy().sum("total_cartons", "total_amount_rmb").first()
    assert tuple(bars) == (1042.0, 327239.30)
    assert sums["left_in_warehouse"]["sum(total_cartons)"] == 20.0 and rules.sections_continued(rows).count() == rows.count()


@pytest.mark.parametrize("sales", [False, True])
def test_empty_and_broken_pages(spark, sales):
    page = chunks(spark, None, "", "<table>", "<table></table>", "<table><tr></tr></table>", "<table><tr><td>x", "<p>only text</p>", table())
    assert P.parsed_products(page, sales).collect() == []
    assert P.parsed_products(page.limit(0), sales, full=True).collect() == []


def test_rows_that_are_longer_than_the_header(spark):
    rows = spark.createDataFrame([(1, ["1", "x", "cup", "5", "浦江仓", "PCS"]), (2, ["1", "x", "cup", "red", "5"]), (3, ["1", "x", "cup", "5", "杯", ""])], "i int, cells array<string>")
    columns = ["line_no", "item_code", "description", "total_quantity"]
    sales = {r.i: r.cells for r in G.aligned_rows(rows, columns, sales=True).collect()}
    assert sales == {1: ["1", "x", "cup", "5", "浦江仓", "PCS"], 2: ["1", "x", "cup red", "5"], 3: ["1", "x", "cup", "5", "杯", ""]}
    assert {r.i: r.cells for r in G.aligned_rows(rows, columns).collect()}[1] == ["1", "x", "cup 5 浦江仓", "PCS"]
    assert [r.cells for r in G.aligned_rows(rows, ["line_no", "item_code", None, "total_quantity"]).orderBy("i").collect()] == [r.cells for r in rows.orderBy("i").collect()]
    short = spark.createDataFrame([(1, ["1", "cup", "5"])], "i int, cells array<string>")
    assert G.aligned_rows(short, ["line_no", "description", "description", "total_quantity"]).first().cells == ["1", "cup", "", "5"]


def test_rows_of_a_table_are_equally_long(spark):
    assert G.grid_of("<table><tr><td>a</td><td>b</td><td>c</td></tr><tr><td>d</td></tr></table>") == [["a", "b", "c"], ["d", "", ""]]
    assert G.grid_of('<table><tr><td rowspan="9">a</td></tr><tr><td colspan="2">b</td></tr></table>') == [["a", "", ""], ["a", "b", "b"]]
