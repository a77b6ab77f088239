"""Plans of queries whose steps were repeated, or cost a shuffle, for every use of their result."""

import pytest
from pyspark.sql import functions as F

from quaytally.functions.headers import CONTAINER_LABELS, SALES_LABELS, field_named, field_of_label
from quaytally.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


# query, a part of its plan, how often it may stand there
@pytest.mark.parametrize(
    ("name", "part", "most"),
    [("stage_lines", "regexp_replace", 40), ("flattened_sales_rows", "slice(", 8), ("metrics_in_description", "slice(", 8), ("row_chunks", "FlatMapGroupsInPandas", 0), ("html_field_rows", "RLIKE", 10), ("html_two_header_rows", "RLIKE", 10), ("shown_labels", "regexp_replace", 12)],
)
def test_steps_stand_once_in_a_plan(spark, name, part, most):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(part) <= most


def test_facts_of_a_file_of_one_block_are_found_by_all_tasks(spark):
    assert "RepartitionByExpression" in QUERIES["doc_facts"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_read_in_one_pass(spark):
    assert QUERIES["page_subtotals"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("sales", [False, True])
def test_labels_name_the_same_fields_inside_tasks(spark, sales):
    own = [*CONTAINER_LABELS, *(label for labels in SALES_LABELS.values() for label in labels)]
    odd = ["", " ", "qty pcs", "T. AMOUNT", "ORDNO.", "item no：", "（L）", "U.PRICE(rmb)", "W.H.1", "g.w.", "NO. 5", "x DES　y", "1.5", "colour", "ITEM 品名 z", "BARCODE no"]
    labels = [f(label) for label in own for f in (str, str.lower, lambda x: f" {x} : ")] + odd
    found = spark.createDataFrame([(x,) for x in labels], "label string").select("label", field_of_label(F.col("label"), sales).alias("field")).collect()
    assert {r.label: r.field for r in found} == {x: field_named(x, sales) for x in labels}
