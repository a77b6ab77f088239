"""Column functions on literal rows and against plain statements of the rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaytally.functions import numbers as N
from quaytally.functions import text as T


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.r for r in df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]

    return run


PREFIX = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", re.ASCII)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.text("0123456789.,-+ ekgKGS¥", max_size=9), min_size=20, max_size=60))
def test_number_rules(apply, values):
    def prefix(s):
        m = PREFIX.match(s)
        return float(m[0]) if m else None

    assert apply(N.finite, values) == [prefix(v.strip(" ").replace(",", "")) for v in values]
    assert apply(N.loose_or_null, values) == [prefix(re.sub(r"[^\d.-]", "", v, flags=re.ASCII)) for v in values]
    assert apply(N.digits, values) == [int(d) if (d := re.sub(r"\D", "", v)) else None for v in values]


def test_number_traps(apply):
    assert apply(N.finite, ["1.5", "-3", "12 34kg", ".", "null", None, "1,200"]) == [1.5, -3.0, 12.0, None, None, None, 1200.0]
    assert apply(N.digits, ["1.5", "-3", "", None]) == [15, 3, None, None]
    assert apply(N.strict, ["12x", "12"]) == [None, 12.0]
    assert apply(N.integer, ["-2.5", "2.5"]) == [-2, 3]
    assert apply(N.weight, ["12.5KGS", None, "x"]) == [12.5, 0.0, 0.0]
    assert apply(N.iso_date, ["2026-01-31", "31/01/2026", "31-01-2026", "31.01.2026", None, ""]) == ["2026-01-31"] * 3 + [None] * 3


def test_names_and_sections(apply):
    assert apply(T.base_name, ["Vacuum Flask TE-R100FG-1", "Cup Stand KD63-218A", "Ceramic Canister Set SCT-", "KD63 x", "Flask 保温壶", "保温壶 x"]) == ["Vacuum Flask", "Cup Stand", "Ceramic Canister Set", "KD63", "Flask", "保温壶 x"]
    assert apply(T.header_kind, ["NEW ORDER NEW ORDER", "BEFORE GOODS MAG-4", "GOODS LEFT IN SANCARGO", "37-T-1 18 CTN GOODS STUFFED INTO THIS CONTAINER(REPACKED GOODS)", "x STUFFED INTO THIS CO", "12 CTN 4 CBM", "KITCHEN WARES", None]) == ["new_order", "before_goods", "goods_left", "repacked", "stuffed", None, "unknown", None]
    assert apply(T.canonical_section, [None, "repacked", "what", "other"]) == ["shipped", "repacked", "shipped", "other"]
    assert apply(T.valid_marks, ["MS-1", "ab", "a b", "¥1x", "TOTAL 3", "12CTN", "MS-1\nSANCARGO", None]) == [True, False, False, False, False, False, True, False]
    assert apply(lambda c: T.section_label(T.section_label_tag(c)), ["a b+c%", "新 order"]) == ["a b+c%", "新 order"]


@pytest.mark.parametrize(
    ("body", "name", "kind"),
    [
        ("", "销售单.pdf", "sales_order"),
        ("<table>", "送货单1.xlsx", "sales_order"),
        ("CONTAINER NO 1 CLIENT DETAILS SANCARGO", "销售单.pdf", "container_manifest"),
        ("DEL NO ORD NO ITEM NO", "销售单.pdf", "sales_order"),
        ("送货单", "scan.pdf", "sales_order"),
    ],
)
def test_document_kind(spark, body, name, kind):
    assert spark.range(1).select(T.resolved_kind(F.lit(body), F.lit(name)).alias("k")).first().k == kind
