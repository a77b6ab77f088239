"""Snapshots, deletions, corrections and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.operators import rules as U
from quaytally.operators import snapshots as S
from quaytally.plans.registry import query
from quaytally.plans.rule_queries import FLAGGED_B, rough
from quaytally.sources import canonical as C
from quaytally.sources.shared import shared_folder


@query("""SELECT document_id, count(*) AS n_items, sum(total_amount_rmb)::DOUBLE AS amount FROM items WHERE document_id NOT IN (SELECT document_id FROM docs WHERE status = 'P') GROUP BY 1""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = C.documents(spark, d)
    left = S.cascaded(docs, {"items": C.items(spark, d)}, docs.where("status = 'P'"))["items"]
    return left.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("total_amount_rmb").alias("amount"))


@query("""
, e AS (SELECT item_id, CASE WHEN line_no % 2 = 0 THEN 'other' END AS s, CASE WHEN line_no % 3 = 0 THEN 1 END AS c, line_no % 4 = 0 AS del FROM items WHERE product_id % 3 = 0)
SELECT item_id, coalesce(s, section) AS section, coalesce(c, total_cartons)::DOUBLE AS total_cartons, coalesce(del, deleted) AS deleted FROM items LEFT JOIN e USING (item_id)""")
def apply_edits(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d)
    line = F.col("line_no")
    last = items.where("product_id % 3 = 0").select(
        "item_id", F.lit(2).alias("edit_id"), F.when(line % 2 == 0, "other").alias("section"), F.when(line % 3 == 0, F.lit(1)).cast("decimal(18,3)").alias("total_cartons"), F.lit(None).cast("decimal(18,3)").alias("total_quantity"), (line % 4 == 0).alias("deleted")
    )
    earlier = last.withColumns({"edit_id": F.lit(1), "section": F.lit("repacked"), "deleted": F.lit(True)})
    return S.edits_applied(items, earlier.unionByName(last)).select("item_id", "section", "total_cartons", "deleted")


@query("""SELECT section, count(*) AS n_items FROM items WHERE section <> 'repacked' AND NOT (description LIKE '%ring%' AND document_id = 1) GROUP BY 1""")
def bulk_delete(spark: SparkSession, d: str) -> DataFrame:
    rest = S.bulk_deleted(C.items(spark, d), F.col("section") == "repacked")
    return S.bulk_deleted(rest, F.col("description").contains("ring"), 1).groupBy("section").agg(F.count(F.lit(1)).alias("n_items"))


@query("""
, kept AS (SELECT document_id FROM docs WHERE created_at >= TIMESTAMP '1998-01-01')
SELECT document_id, count(*) AS n_items FROM items WHERE document_id IN (SELECT document_id FROM kept) GROUP BY 1""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    kept = S.retained(C.documents(spark, d), F.lit("1998-01-02 15:00:00").cast("timestamp"))
    return S.children_of(C.items(spark, d), kept).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_items"))


@query("""
, n AS (SELECT item_id, CASE line_no % 4 WHEN 0 THEN packaging WHEN 1 THEN '9pcs/ctn' END AS p, CASE line_no % 4 WHEN 2 THEN 7 ELSE 0 END AS q FROM items WHERE product_id % 2 = 0),
j AS (SELECT i.*, p, q, coalesce((p IS NOT NULL AND p <> packaging) OR (q > 0 AND q <> total_quantity), false) AS better FROM items i LEFT JOIN n USING (item_id))
SELECT item_id, better AS corrected, CASE WHEN better THEN coalesce(p, packaging) ELSE packaging END AS packaging, CASE WHEN better THEN coalesce(q, total_quantity) ELSE total_quantity END::DOUBLE AS total_quantity FROM j""")
def corrections(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d)
    kind = F.col("line_no") % 4
    proposed = items.where("product_id % 2 = 0").select(
        "item_id", F.when(kind == 0, F.col("packaging")).when(kind == 1, "9pcs/ctn").alias("packaging"), F.when(kind == 2, F.lit(7)).otherwise(F.lit(0)).cast("decimal(18,3)").alias("total_quantity"), F.lit(None).cast("decimal(14,2)").alias("unit_price_rmb"), F.lit(None).cast("string").alias("description")
    )
    return S.corrections_merged(items, proposed).select("item_id", "corrected", "packaging", "total_quantity")


ROUGH_REVIEW = FLAGGED_B + " SELECT item_id FROM rough WHERE NOT regexp_matches(coalesce(packaging, ''), '(?i)\\d+\\s*[a-z]+\\s*/\\s*ctn') OR (coalesce(total_quantity, 0) <= 0 AND coalesce(total_cartons, 0) > 0) OR (coalesce(unit_price_rmb, 0) <= 0 AND coalesce(total_amount_rmb, 0) > 0 AND coalesce(total_quantity, 0) > 0)"


@query(ROUGH_REVIEW)
def review_routing(spark: SparkSession, d: str) -> DataFrame:
    return S.review_candidates(rough(spark, d)).select("item_id")


@query(f"""{FLAGGED_B}
, c AS (SELECT document_id, flag, count(*) AS n FROM (SELECT document_id, unnest(string_split(flags, ';')) AS flag FROM flagged WHERE flags <> '') GROUP BY 1, 2)
SELECT document_id, string_agg(flag || '=' || n, ';' ORDER BY flag) AS flag_counts FROM c GROUP BY 1""")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat_ws(";", F.transform(F.map_entries("flag_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return S.flag_metrics(U.import_flags(rough(spark, d))).select("document_id", shown.alias("flag_counts"))


@query("""SELECT document_id, sha256(client_id || '|' || priority) AS sha256 FROM (SELECT *, document_id % 2 = 0 AS stored FROM docs) d
WHERE NOT stored OR NOT EXISTS (SELECT 1 FROM docs n WHERE n.document_id % 2 = 1 AND n.client_id = d.client_id AND n.priority = d.priority)""")
def content_replace(spark: SparkSession, d: str) -> DataFrame:
    docs = C.documents(spark, d).withColumn("body", F.concat_ws("|", "client_id", "priority"))
    return S.replaced_by_hash(docs.where("document_id % 2 = 0"), docs.where("document_id % 2 = 1")).select("document_id", "sha256")


@query("""SELECT item_id FROM items WHERE coalesce(description, '') <> '' AND NOT (product_id % 5 = 0) AND product_id % 7 <> 0""")
def synthetic_rows_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Sentinel rows and anonymous total rows go."""
    k5, k7 = F.col("product_id") % 5 == 0, F.col("product_id") % 7 == 0
    rows = C.items(spark, d).withColumns({"item_code": F.when(k5, "__SECTION_SUBTOTAL__").when(k7, F.lit(None)).otherwise(F.col("item_code")), "description": F.when(~k7, F.col("description")), "marks": F.when(~k7, F.col("marks"))})
    anonymous = (F.trim(T.text("description")) == "") & (F.trim(T.text("item_code")) == "") & (F.trim(T.text("marks")) == "") & (F.col("total_cartons") > 0)
    return rows.where(~anonymous & ~F.coalesce(F.col("item_code").isin("__SECTION_SUBTOTAL__", "__FOOTER__", "__FULL_EXTRACT__"), F.lit(False))).select("item_id")


@query("""
, d AS (SELECT *, document_id % 2 = 0 AS stored FROM docs),
kept AS (SELECT document_id FROM d WHERE NOT stored OR NOT EXISTS (SELECT 1 FROM docs n WHERE n.document_id % 2 = 1 AND n.client_id = d.client_id AND n.priority = d.priority))
SELECT document_id, line_no, item_code FROM (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY line_no) AS line_no, item_code FROM items WHERE product_id % 6 <> 0) JOIN kept USING (document_id)""")
def document_set(spark: SparkSession, d: str) -> DataFrame:
    """Two imports of documents with their rows, of which markers go; those of the second replace equal ones of the first."""
    folder = shared_folder(spark)
    marks = F.when(F.col("product_id") % 6 == 0, F.concat(F.lit("__SECTION_STAGE__:"), F.col("line_no"))).otherwise(F.col("marks"))
    items = S.mapped_rows(C.items(spark, d).select("document_id", "line_no", marks.alias("marks"), "item_code"))
    docs = C.documents(spark, d).withColumn("sha256", F.sha2(F.concat_ws("|", "client_id", "priority"), 256)).select("document_id", "sha256", "source_file_name")
    for odd in (0, 1):
        mine = F.col("document_id") % 2 == odd
        S.write_document_set({"documents": docs.where(mine), "items": items.where(mine)}, folder)
    return S.stored_table(spark, f"{folder}/items").select("document_id", "line_no", "item_code")
