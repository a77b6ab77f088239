"""The pipeline's stages over rows with null and repeated ids."""

import pytest

from quaytally.llm import decontaminate, exact_dedup, near_dedup

LONG = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu one two three four five six seven eight nine ten"
NEAR = LONG + " eleven"
OTHER = " ".join(f"other{i}" for i in range(40))


def got(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_exact_dedup_keeps_one_row_of_a_text(docs_frame):
    rows = [(None, "a  b"), (None, "a b"), (None, "c"), (3, "c"), (3, "c"), (4, "d"), (4, "e"), (4, "d")]
    found = got(exact_dedup.exact_dedup(docs_frame(rows)))
    assert len(found) == 4 and set(found) >= {(3, "c"), (4, "d"), (4, "e")}


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([(None, LONG), (None, NEAR), (None, LONG), (None, OTHER)], [(None, None), (None, OTHER)]),
        ([(None, LONG), (7, NEAR)], [(7, NEAR)]),
        ([(5, LONG), (5, LONG)], [(5, LONG)]),
        ([(1, LONG), (2, NEAR), (2, OTHER)], [(1, LONG), (2, OTHER)]),
        ([(9, NEAR), (9, LONG), (9, OTHER)], [(9, None), (9, OTHER)]),
        ([(None, ""), (1, "")], [(1, ""), (None, "")]),
    ],
)
def test_near_dedup_keeps_one_row_of_a_group(docs_frame, rows, kept):
    found = got(near_dedup.near_dedup(docs_frame(rows)))
    either = [(i, None if (i, None) in kept and t in (LONG, NEAR) else t) for i, t in found]  # None: any of the two
    assert sorted(either, key=str) == sorted(kept, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_clean_drops_contaminated_rows_alone(docs_frame, spark, block_bytes):
    benchmark = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    rows = [(None, NEAR), (None, OTHER), (2, "so " + LONG), (2, OTHER), (None, None)]
    docs = docs_frame(rows)
    found = decontaminate.clean(docs, benchmark, block_bytes=block_bytes)
    assert found.columns == docs.columns and got(found) == sorted([(None, OTHER), (2, OTHER), (None, None)], key=str)


@pytest.mark.parametrize("stage", [exact_dedup.exact_dedup, near_dedup.near_dedup, lambda d: decontaminate.clean(d, d.sparkSession.createDataFrame([(1, OTHER)], "item_id long, text string"), block_bytes=1)])
def test_stages_keep_a_clashing_column_and_take_hard_rows(spark, hard_rows, stage):
    schema = "doc_id long, text string, __row string, __ROW_ int, __place int, row int, id int, component int, code int"
    docs = spark.createDataFrame([(i, t, f"r{n}", n, n, n, n, n, n) for n, (i, t) in enumerate(hard_rows)], schema)
    found = stage(docs)
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and all(r["__row"] == f"r{r['id']}" and (r.doc_id, r.text) == hard_rows[r["id"]] for r in rows)
    empty = stage(docs.limit(0))
    assert empty.columns == docs.columns and empty.collect() == []


def test_what_was_written_can_be_cleared(docs_frame, spark):
    from quaytally.llm import common

    common.clear(spark)
    near_dedup.near_dedup(docs_frame([(1, LONG), (2, NEAR)])).collect()
    assert common.clear(spark) > 3 and common.clear(spark) == 0
