"""Imported rows: layouts by import, keys in order, markers and boundaries."""

import pytest
from pyspark.sql import functions as F

from quaytally.operators import rules
from quaytally.sources import grids as G
from quaytally.sources import imports as I


def found(spark, rows, *columns, sales=False):
    frame = spark.createDataFrame([("f", i, c) for i, c in enumerate(rows)], "file string, record int, cells map<string,string>")
    return [tuple(r) for r in I.imported_rows(frame, F.lit(sales)).orderBy("record").select(*columns).collect()]


def test_the_first_key_that_reads_as_a_number_counts(spark):
    rows = [{"U/P": "", "PRICE": "n/a", "cost_price": "2.5", "sku": "a", "T.QTY": "4 pcs", "__col14": "9"}, {"__col15": "x", "__col14": "12", "sku": "b", "T.QTY": "3"}, {"name": "pan 20 pcs / box", "sku": "c"}]
    got = found(spark, rows, "sku", "cost_price", "quantity", "total_amount_rmb", "packing", "unit", sales=True)
    assert got == [("a", 2.5, 4.0, 9.0, None, "pcs"), ("b", 12.0, 3.0, 12.0, None, "pcs"), ("c", 0.0, 0.0, None, "20 pcs / box", "pcs")]


def test_markers_and_boundaries_of_a_packing_list(spark):
    rows = [
        {"MARKS": "__SECTION_STAGE__:A GOODS STUFFED INTO THIS CONTAINER", "T.QTY": "5"}, {"MARKS": "__SECTION_STAGE__:short", "T.QTY": "5"}, {"MARKS": "__SECTION_STAGE_TOTAL__:7", "T.QTY": "5"}, {"MARKS": "GOODS LEFT IN SANCARGO"},
        {"MARKS": "MS-1\nmore", "__col6": "cup", "T.QTY": "10", "T.AMOUNT": "25"}, {"MARKS": "STUFFED INTO THIS CONTAINER (REPACKED GOODS)"}, {"MARKS": "MS-2"},
    ]
    got = found(spark, rows, "sku", "name", "quantity", "cost_price")
    assert got == [
        ("__SECTION_STAGE__:A GOODS STUFFED INTO THIS CONTAINER", "A GOODS STUFFED INTO THIS CONTAINER", 0.0, 0.0), ("__SECTION_STAGE__:short", None, 5.0, 0.0), ("__SECTION_STAGE_TOTAL__:7", "7", 0.0, 0.0), ("MS-1", "cup", 10.0, 2.5),
    ]


def test_a_file_of_notes_becomes_typed_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MARKS,DESCRIPTION OF GOODS,PACKING,T.CTN,T.QTY,U.PRICE (RMB),T.AMOUNT\nMS-1,cup,40pcs/ctn,3CTNS,120pcs,5,600\n")
    (tmp_path / "b.csv").write_text("SKU,Name,Quantity,Cost Price\nx,pan,7,1.5\n,,9,9\n")
    rows = I.imported_rows(G.headed_rows(G.delivery_notes(spark, str(tmp_path))), F.lit(False))
    assert sorted(tuple(r) for r in rows.select("sku", "name", "packing", "cartons", "quantity", "cost_price").collect()) == [("MS-1", "cup", "40pcs/ctn", 3.0, 120.0, 5.0), ("x", "pan", None, None, 7.0, 1.5)]


@pytest.mark.parametrize("sales", [False, True])
def test_empty_imports(spark, sales):
    assert found(spark, [], "sku", sales=sales) == []
    assert found(spark, [{}], "sku", sales=sales) == ([(None,)] if sales else [])


def test_prices_beyond_the_cap_of_the_tables(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 60_000.0, 5.0, 1.0, None), (1.0, 2.0, 600_000.0, 5.0, 1.0, None)], "total_quantity double, qty_per_carton double, unit_price_rmb double, total_amount_rmb double, total_cartons double, remarks string")
    kept = lambda most: [r.unit_price_rmb for r in rules.capped(rows, most).collect()]
    assert kept(rules.MAX_PRICE) == [None, None] and kept(rules.SQL_MAX_PRICE) == [60_000.0, None]
