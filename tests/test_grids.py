"""CSV files and HTML pages as grids."""

import pytest

from quaytally.functions.headers import field_of_label
from quaytally.sources import grids as G


@pytest.mark.parametrize(("lines", "cells"), [(["CODE,QTY", "a,1", "b,2"], [{"CODE": "a", "QTY": "1"}, {"CODE": "b", "QTY": "2"}]), (["top,line", "SKU,QTY", "a,1"], [{"SKU": "a", "QTY": "1"}]), (["A,A,", "1,2,3", "4"], [{"A": "2", "__col2": "3"}, {"A": "", "__col2": ""}])])
def test_first_record_is_the_header_of_a_file_without_a_known_one(spark, tmp_path, lines, cells):
    (tmp_path / "a.csv").write_text("\n".join(lines))
    found = G.headed_rows(G.delivery_notes(spark, str(tmp_path))).orderBy("record").collect()
    assert [r.cells for r in found] == cells


def test_records_of_any_width(spark, tmp_path):
    text = '﻿a,"b ""q"", c","two\nlines"\r\n' + ",".join(str(i) for i in range(40)) + '\n"",x"y"z\n'
    (tmp_path / "a.csv").write_bytes(text.encode())
    found = [r.cells for r in G.delivery_notes(spark, str(tmp_path)).orderBy("record").collect()]
    assert found == [["a", 'b "q", c', "two\nlines"], [str(i) for i in range(40)], ["", "xyz"], [""]]


def grid(spark, html):
    return [list(map(list, r.grid)) for r in G.html_grids(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("table").collect()]


def test_spans_and_entities_are_alike_in_all_tables(spark):
    text = "&amp;lt;b&amp;gt; caf&#233; &#x20AC; &quot;q&quot;&nbsp;&apos;&#zz;"
    shown = "<b> café € \"q\" '&#zz;"
    assert grid(spark, f"<table><tr><td colspan=2>{text}</td></tr></table>") == [[[shown, shown]]]
    assert grid(spark, f"<table><tr><td rowspan=3>{text}</td><td>1</td></tr><tr><td>2</td></tr></table>") == [[[shown, "1"], [shown, "2"]]]


def test_layout_of_spans(spark):
    page = "<table><tr><td rowspan=2 colspan=2>A</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td><td rowspan='2'>e</td><td>f</td></tr><tr><td>g</td><td>h</td></tr></table>"
    assert grid(spark, page) == [[["A", "A", "b"], ["A", "A", "c"], ["d", "e", "f"], ["g", "e", "h"]]]


@pytest.mark.parametrize(("html", "text"), [("Bakewar<br/>e", "Bakeware"), ("displ<BR>ay", "display"), ("pan<br>lid", "pan lid"), ("a<br>rs x", "a rs x"), ("12<br>e", "12 e"), (" <br>x<br><br>Y<b>z</b>", "x Yz")])
def test_line_breaks(spark, html, text):
    assert grid(spark, f"<table><tr><td>{html}</td></tr></table>") == [[[text]]]


LABELS = [
    ("U.PRICE(RMB)", "unit_price_rmb", None), ("U.PRICE (RMB)", "unit_price_rmb", None), ("T. AMOUNT", "total_amount_rmb", "total_amount_rmb"), ("t.amount（¥）", None, "total_amount_rmb"), ("Unit  Price(¥)", None, "unit_price_rmb"),
    ("BOX .NO", "box_no_start", None), ("shop#", "shop", None), ("序号：", "line_no", "line_no"), ("NO. 序号", None, "line_no"), ("ITEM NO. 产品货号", None, "item_code"), ("ITEMNO.", "item_code", "item_code"), ("DEL NO.送货单号", None, "delivery_no"),
    ("QTY (pcs)", None, "packaging"), ("T.QTY (pcs)", None, "total_quantity"), ("T.T.CBM 总体积", None, "total_cbm"), ("毛重量", None, "unit_weight_kg"), ("G.W.", None, "unit_weight_kg"), ("W.H.", None, "warehouse"), ("CUS CODE", None, None),
    ("客户货号", None, "customer_item_ref"), ("L (cm)", None, "dim_l_cm"), ("ITEM/品名", None, "product_name_local"), ("PHOTO 3", None, "skip"), ("IMAGE", "skip", None), ("colour", None, None), ("MATERIAL 材质", None, "material"), ("Unit 单位", None, "unit"),
]


def test_labels(spark):
    rows = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LABELS)], "i int, label string")
    found = {r.i: (r.container, r.sales) for r in rows.select("i", field_of_label(rows["label"], False).alias("container"), field_of_label(rows["label"], True).alias("sales")).collect()}
    wrong = [(label, found[i]) for i, (label, container, sales) in enumerate(LABELS) if found[i][1] != sales or (container and found[i][0] != container)]
    assert not wrong


def test_sales_table(spark):
    head = "".join(f"<td>{c}</td>" for c in ("序号", "DEL NO", "ITEM NO", "描述", "T.QTY", "U/P", "金额"))
    row = "".join(f"<td>{c}</td>" for c in ("1", "26C707-6083", "WIDGET-001", "Test widget desc", "48", "12.5", "600"))
    pages = spark.createDataFrame([(1, f"<table><tbody>\n<tr>{head}</tr>\n<tr>{row}</tr></tbody></table>")], "page_id long, html string")
    found = G.field_rows(pages, ("item_code", "total_quantity", "unit_price_rmb", "total_amount_rmb", "delivery_no", "remarks")).drop("page_id", "table", "row").collect()
    assert [tuple(r) for r in found] == [("WIDGET-001", "48", "12.5", "600", "26C707-6083", None)]


def test_two_header_rows(spark):
    page = "<table><tr><td>NO.</td><td colspan=2>GOODS</td><td>TOTAL</td><td>REMARKS</td><td>CODE</td></tr><tr><td></td><td>ITEM NO</td><td>DES.</td><td>WEIGHT</td><td></td><td>CODE</td></tr><tr><td>1</td><td>a</td><td>b</td><td>3</td><td>c</td><td>9</td></tr></table>"
    headed = G.with_columns(G.html_grids(spark.createDataFrame([(1, page)], "page_id long, html string")), True).first()
    assert (headed.header_row, headed.data_row) == (0, 2)
    assert headed.columns == ["line_no", "item_code", "description", "total_weight_kg", "remarks", "barcode"]


def machine(text):
    """Records of a CSV text, one sign after another."""
    rows, row, field, quoted, i = [], [], "", False, 0
    text = text.removeprefix("\ufeff")
    while i < len(text):
        c = text[i]
        if quoted and c == '"' and text[i + 1 : i + 2] == '"':
            field, i = field + c, i + 1
        elif c == '"':
            quoted = not quoted
        elif quoted or c not in ",\r\n":
            field += c
        elif c == ",":
            row, field = [*row, field], ""
        elif c == "\n":
            rows, row, field = [*rows, [*row, field]], [], ""
        i += 1
    return [*rows, [*row, field]]


def test_csv_in_blocks_of_any_size_equals_a_plain_machine(spark, tmp_path):
    import random

    rng, texts = random.Random(5), {}
    for i in range(4):
        pieces = ["a", "bc", ",", ",", "\n", "\n", "\r\n", '"', '""', "é", "\x1f", '"x,\ny"', '"q""r\n"']
        texts[f"{i}.csv"] = "\ufeff" * (i == 3) + "x" + "".join(rng.choice(pieces) for _ in range(60)) + "\n" * (i % 2)
        (tmp_path / f"{i}.csv").write_bytes(texts[f"{i}.csv"].encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (30, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = {}
            for r in G.delivery_notes(spark, str(tmp_path)).orderBy("record").collect():
                found.setdefault(r.file.rsplit("/", 1)[1], []).append(r.cells)
            assert found == {name: machine(text) for name, text in texts.items()}, size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
