"""Exact deduplication with DataFrame functions only.

Texts are equal when identical after each run of white space became one space. Rows are grouped by
the 128-bit hash of that text and, inside a hash, by its bytes: the aggregation itself compares
bytes, so texts that collide stay apart, and copies are combined before the shuffle. Rows then find
their class by (hash, SHA-256), which the class table proves to name one text each.

Nulls: a null text counts as empty; a null id never wins over another id, and a class with null ids
only has a null keep_id. Empty and very long texts are like any other. Repeated rows (same id, same
text) are counted each and marked alike; exact_dedup keeps one row of a class. An empty table gives an empty result. Other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaytally.llm.common import few, unused, written

#: Pairs of hashes that go to every task (some 50 MB as a hash table).
FEW_HASHES = 300_000

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", hash128: Callable[[Column], Column] = lambda c: F.unhex(F.md5(c))) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A hot class costs one row per map task in the aggregation; in the join back, whose rows are
    narrow, Spark splits its partition (adaptive skew join)."""
    rows = docs.select(F.col(id).alias("doc_id"), normalised(F.col(text)).alias("body"))
    classes = (
        rows.withColumn("content", hash128(F.col("body")))
        .groupBy("content", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.col("content").alias("class_content"), F.sha2("body", 256).alias("class_sha256"), "keep_id", "group_size")
    )
    members = rows.select("doc_id", hash128(F.col("body")).alias("content"), F.sha2("body", 256).alias("text_sha256"))
    return members.join(classes, (F.col("content") == F.col("class_content")) & (F.col("text_sha256") == F.col("class_sha256"))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each text, whatever the ids.

    Hashes are counted first; rows whose text stands alone stay where they are. Of the others each task drops
    all but its own best row of a text before they move, so a hot text sends one row a task."""
    md5, sha256, place, several = (unused(name, docs.columns) for name in ("__md5", "__sha256", "__place", "__several"))
    body = normalised(F.col(text))
    rows = docs.withColumns({md5: F.unhex(F.md5(body)), sha256: F.unhex(F.sha2(body, 256))})
    repeated = rows.groupBy(md5, sha256).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(md5, sha256, F.lit(True).alias(several))
    marked = rows.join(few(written(repeated, "repeated"), FEW_HASHES), [md5, sha256], "left")
    best = Window.partitionBy(md5, sha256).orderBy(F.col(id).isNull(), id)
    first = marked.where(F.col(several)).withColumn(place, F.row_number().over(best)).where(F.col(place) <= 1)
    return marked.where(F.col(several).isNull()).select(docs.columns).unionByName(first.select(docs.columns))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW same AS (PARTITION BY body)
"""
