"""Steps that are worked out once, inside of tasks, where they were repeated or shuffled."""

import pytest
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.functions.numbers import digits, loose_or_null, prefix_number
from quaytally.operators import rules, shifts
from quaytally.operators import snapshots as S
from quaytally.plans.catalog import QUERIES
from quaytally.sources import grids as G
from quaytally.sources import lines as L
from quaytally.sources import pages as P

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_a_file_in_one_block_are_not_written_on_the_way(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('SKU,QTY\n"a\nb",1\nc,2\n')
    kept = []
    own = G.written
    monkeypatch.setattr(G, "written", lambda rows, what: kept.append(own(rows, what)) or kept[-1])
    assert [r.cells for r in G.delivery_notes(spark, str(tmp_path)).orderBy("record").collect()] == [["SKU", "QTY"], ["a\nb", "1"], ["c", "2"], [""]]
    assert [k.count() for k in kept] == [0]


def test_numbers_need_no_lambda(spark):
    rows = spark.createDataFrame([("12.5kg",), ("x",), (".",), ("-3e2 ",), (None,), ("",)], "t string").select(prefix_number(F.col("t")).alias("n"))
    assert "lambda" not in plan(rows)
    assert [r.n for r in rows.collect()] == [12.5, None, None, -300.0, None, None]


def test_spaces_are_squeezed(spark):
    texts = {"a b": "a b", " a  b ": "a b", "a\t b": "a b", "a \n": "a", "　a  b": "a b", "a   b\rc": "a b c", "": ""}
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.squeezed(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in found} == texts


# query, a part of its plan, how often it may stand there
@pytest.mark.parametrize(("name", "part", "most"), [("sales_lines", "{12}", 1), ("line_blocks", "(?:SANCARGO", 1), ("merged_cells", "9fff}].*", 3), ("csv_headed_rows", "map_from_entries", 0), ("part_facts", "<[^>]+>", 1)])
def test_steps_stand_once_in_a_plan(spark, name, part, most):
    assert plan(QUERIES[name](spark, SMALL)).count(part) <= most


# query, a part of its plan, how often it may stand there: a row's kind and label are told once, and review rows come from one walk
@pytest.mark.parametrize(("name", "part", "most"), [("page_products", "Window [", 5), ("page_products", "RLIKE", 30), ("page_products", "NEW ORDERS", 1), ("page_review_rows", "Union", 0), ("page_review_rows", "Window [", 5), ("page_subtotals", "Generate ", 1)])
def test_pages_are_walked_once(spark, name, part, most):
    assert plan(QUERIES[name](spark, SMALL)).count(part) <= most


def test_methods_of_pages_are_of_a_size_that_is_compiled(spark):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        P.walked(spark.createDataFrame([], "document_id long, chunk int, html string"))
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def test_rows_that_no_rule_holds_for_go_through_none(spark):
    row = dict.fromkeys(shifts.ROW_FIELDS) | {"marks": "A", "description": "cup 12pcs/ctn", "packaging": "3 CTNS", "total_cartons": 36.0, "total_quantity": 36.0}
    types = ", ".join(f"{f} {'string' if f in shifts.TEXT_FIELDS else 'double'}" for f in shifts.ROW_FIELDS)
    rows = spark.createDataFrame([(True, *row.values()), (False, *row.values())], f"own boolean, {types}")
    found = shifts.parsed_rows_repaired(rows, only=F.col("own"))
    assert {r.own: (r.total_cartons, r.remarks) for r in found.collect()} == {True: (3.0, "repair:cartons_from_pack_when_qty_correct"), False: (36.0, None)}


def test_rows_of_imports_go_through_rules_only_if_one_holds(spark):
    row = dict.fromkeys(rules.MANIFEST_FIELDS) | {"description": "pan", "cartons": 2.0, "quantity": 48.0}
    types = ", ".join(f"{f} {'string' if f in rules.TEXT_FIELDS else 'double'}" for f in rules.MANIFEST_FIELDS)
    found = rules.manifest_repaired(spark.createDataFrame([tuple(row.values())], types))
    assert "CASE WHEN" in plan(found).split("transform(")[0]  # the chain stands inside of the test of all rules
    assert found.first().asDict() == row


def test_cells_without_a_text_are_no_text_to_search(spark):
    rows = spark.createDataFrame([(None,), ("",), ("¥ 1,2",), ("-",)], "t string").select(loose_or_null(F.col("t")).alias("n"), digits(F.col("t")).alias("d"))
    assert "coalesce" not in plan(rows)
    assert [tuple(r) for r in rows.collect()] == [(None, None), (None, None), (12.0, 12), (None, None)]


@pytest.mark.parametrize(("text", "kind"), [("G OODS LE FT IN SANCARGO", "goods_left"), ("M.M.B G-O-O-D-S load", "stuffed"), ("goods left", "unknown"), ("NEW ORDERS .", "new_order"), ("5 CTNS NEW", None), ("", None)])
def test_headers_without_their_plain_words_are_found(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(T.header_kind(F.col("t"))).first()[0] == kind


def test_fragments_are_dealt_by_document(spark):
    assert "RepartitionByExpression [document_id" in plan(QUERIES["fragment_lines"](spark, SMALL))


def test_new_rows_of_a_table_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def number(n):
        seen.add(1)
        return n

    counted = F.udf(number, "long").asNondeterministic()
    rows = spark.range(10).select(counted("id").alias("document_id"), F.col("id").alias("v"))
    S.replace_rows(f"{tmp_path}/t", spark.range(10).select(F.col("id").alias("document_id"), (-F.col("id")).alias("v")), spark.range(12).select(F.col("id").alias("document_id")))
    S.replace_rows(f"{tmp_path}/t", rows, spark.range(5).select(F.col("id").alias("document_id")))
    assert seen.value == 10
    assert sorted((r.document_id, r.v) for r in S.stored_table(spark, f"{tmp_path}/t").collect()) == [(i, i) for i in range(10)]


def test_forms_of_cells_are_told_once(spark):
    found = plan(QUERIES["cell_pattern_rows"](spark, SMALL))
    assert found.count("filter(") == 0 and found.count("CBM$") <= 2


FIELDS = ("packaging", "total_cartons", "total_quantity", "total_cbm", "total_weight_kg", "unit_price_rmb", "total_amount_rmb")


# cells of a row, its fields in the order above
@pytest.mark.parametrize(
    ("cells", "fields"),
    [
        ([], (None,) * 7),
        (None, (None,) * 7),
        ([None, "", "MS-1-2", "5 goods", "CTN", "1.5pcs", "1.5CBM/ctn", "5KGN", "-5CTNS", "\t5CTN", "5CTN \n", "1/ctn", "KGS", "5\xa5"], (None,) * 7),
        ([" 12 PCS / CTN ", "7cTn", "9CTNS", "8 Pcs\n", "1.2.3cbm", "..CBM", "4KG", "￥ -1,234.5e1", " ¥ x"], (" 12 PCS / CTN ", 7.0, 8.0, None, 4.0, -12345.0, None)),
        (["¥1", None, "¥2", "¥3", "1CBM", "2CBM", "3CBM", "1.KGS", ".5kgs\r\n", "6kg/ctn", "5ctns\u2028"], ("6kg/ctn", 5.0, None, 2.0, 0.5, 1.0, 2.0)),
    ],
)
def test_fields_are_found_by_the_form_of_cells(spark, cells, fields):
    rows = L.pattern_rows(spark.createDataFrame([(1, cells)], "id int, cells array<string>"))
    assert rows.columns == ["id", *FIELDS]
    assert tuple(rows.first()) == (1, *fields)
