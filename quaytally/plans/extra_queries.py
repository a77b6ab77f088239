"""Further rows in and out: sales lines, extractor JSON, maps of cells, footers, unions and refreshes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.operators import joins as J
from quaytally.operators import reports as R
from quaytally.plans.parse_queries import whole
from quaytally.plans.registry import query
from quaytally.sources import canonical as C
from quaytally.sources import lines as L


@query("""SELECT document_id, line_no, item_code, description, total_cartons::DOUBLE AS total_cartons, total_quantity::DOUBLE AS total_quantity, total_amount_rmb::DOUBLE AS total_amount_rmb, 'A-' || product_id % 9 AS warehouse FROM items""")
def sales_lines(spark: SparkSession, d: str) -> DataFrame:
    numbers = F.concat_ws(" ", whole("total_cartons"), whole("qty_per_carton"), whole("total_quantity"), F.col("unit_price_rmb").cast("string"), F.col("total_amount_rmb").cast("string"), F.lit("30 20 10 0.006 1.5 0.01 3"), F.lit("6901234"), F.concat(F.lit("A-"), F.col("product_id") % 9))
    three = F.array(F.concat("line_no", F.lit(" 2026-01-31")), F.concat_ws(" ", F.lit("26C707-6083"), "item_code", "description"), numbers)
    lines = C.items(spark, d).select("document_id", F.posexplode(three).alias("n", "text"), F.col("line_no").alias("item_line")).select("document_id", (F.col("item_line") * 10 + F.col("n")).alias("line_no"), "text")
    return L.sales_rows(lines).select("document_id", "line_no", "item_code", "description", "total_cartons", "total_quantity", "total_amount_rmb", "warehouse")


@query("""SELECT item_id, line_no, CASE WHEN product_id % 3 <> 0 THEN description END AS description, CASE WHEN product_id % 3 = 0 THEN 'W-' || product_id ELSE item_code END AS item_code, total_quantity::DOUBLE AS total_quantity, total_amount_rmb::DOUBLE AS total_amount_rmb,
  CASE WHEN product_id % 3 <> 0 THEN total_cbm::DOUBLE END AS total_cbm, CASE WHEN product_id % 3 = 0 THEN 'shipped' ELSE section END AS section, CASE WHEN product_id % 3 <> 0 THEN marks END AS cell FROM items""")
def extractor_json(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("product_id") % 3 == 0
    fields = {
        "line_no": F.col("line_no").cast("string"), "description": F.when(odd, "null").otherwise(F.col("description")), "source_item_no": F.when(odd, F.concat(F.lit("W-"), F.col("product_id"))), "item_code": F.when(odd, F.lit("26C707-6083")).otherwise(F.col("item_code")),
        "total_qty": F.concat(whole("total_quantity"), F.lit(" pcs")), "total_amount_rmb": F.concat(F.lit("¥"), F.format_number("total_amount_rmb", 2)), "total_cbm": F.when(odd, "undefined").otherwise(F.col("total_cbm").cast("string")), "section": F.when(~odd, F.col("section")),
        "source_cells": F.create_map(F.lit("MARKS"), F.when(odd, " ").otherwise(F.col("marks"))),
    }
    rows = C.items(spark, d).select("item_id", F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("body"))
    return L.extracted(rows, "body").select("item_id", "line_no", "description", "item_code", "total_quantity", "total_amount_rmb", "total_cbm", "section", F.col("source_cells")["MARKS"].alias("cell"))


@query("""SELECT document_id, client_id::VARCHAR AS client_id, CASE document_id % 3 WHEN 0 THEN 'container_manifest' WHEN 1 THEN 'sales_order' ELSE 'unknown' END AS document_type, printed_amount::DOUBLE AS total_amount_rmb, CASE WHEN document_id % 2 = 0 THEN 6.8 END::DOUBLE AS exchange_rate,
  1 + (document_id % 2 = 0)::INT AS n_payments, 1200.5 + CASE WHEN document_id % 2 = 0 THEN 7 ELSE 0 END::DOUBLE AS paid_usd, CASE WHEN document_id % 2 = 0 THEN 'other' END AS second_type FROM docs""")
def extractor_documents(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("document_id") % 2 == 0
    pay = lambda date, amount, kind: F.struct(F.lit(date).alias("payment_date"), amount.alias("amount_usd"), F.lit(kind).alias("payment_type"))
    payments = F.array(pay("2026-02-13", F.lit("1,200.50"), "deposit"), pay("null", F.when(even, "7"), "wire"))
    kind = F.when(F.col("document_id") % 3 == 0, "packing_list").when(F.col("document_id") % 3 == 1, "sales_order").otherwise("list")
    totals = F.struct(F.concat(F.lit("¥"), F.format_number("printed_amount", 2)).alias("total_amount_rmb"), F.when(even, "6.80").otherwise("undefined").alias("exchange_rate"))
    body = F.to_json(F.struct(F.concat(F.lit(" "), "client_id").alias("client_id"), kind.alias("document_type"), totals.alias("footer_totals"), payments.alias("payments")))
    found = L.extracted_documents(C.documents(spark, d).select("document_id", body.alias("body")), "body")
    paid = F.aggregate("payments", F.lit(0.0), lambda a, p: a + p["amount_usd"])
    return found.select("document_id", "client_id", "document_type", "total_amount_rmb", "exchange_rate", F.size("payments").alias("n_payments"), paid.alias("paid_usd"), F.get("payments", F.lit(1))["payment_type"].alias("second_type"))


@query("""SELECT document_id, count(*) AS n_cells, bool_or(product_id % 4 = 0) AS has_price FROM items, (VALUES ('MARKS'), ('T.QTY'), ('PRICE')) k(key) WHERE key <> 'PRICE' OR product_id % 4 = 0 GROUP BY 1""")
def source_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a row as a map without empty ones; which keys a document has at all."""
    cells = F.map_filter(F.create_map(F.lit("MARKS"), F.col("marks"), F.lit("T.QTY"), whole("total_quantity"), F.lit("PRICE"), F.when(F.col("product_id") % 4 == 0, "1").otherwise("")), lambda k, v: T.text(v) != "")
    rows = C.items(spark, d).select("document_id", cells.alias("cells"))
    return rows.groupBy("document_id").agg(F.sum(F.size("cells")).cast("long").alias("n_cells"), F.max(F.map_contains_key("cells", "PRICE")).alias("has_price"))


@query("""SELECT item_id, description FROM (SELECT item_id, CASE WHEN product_id % 5 = 0 THEN 'TOTAL CBM ' || line_no ELSE description END AS description FROM items) WHERE description LIKE 'TOTAL CBM%' ORDER BY item_id LIMIT 400""")
def footer_rows(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d).withColumn("description", F.when(F.col("product_id") % 5 == 0, F.concat(F.lit("TOTAL CBM "), F.col("line_no"))).otherwise(F.col("description")))
    return J.footer_rows(items, include_deleted=True).select("item_id", "description")


@query("""SELECT item_id FROM items WHERE product_id % 6 = 0 AND line_no % 2 = 0""")
def out_of_stock(spark: SparkSession, d: str) -> DataFrame:
    zeroed = (F.col("product_id") % 6 == 0) & (F.col("line_no") % 2 == 0)
    items = C.items(spark, d).withColumns({"total_cartons": F.when(~zeroed, F.col("total_cartons")), "total_quantity": F.when(~zeroed, F.col("total_quantity"))})
    return items.where((R.zero("total_cartons") == 0) & (R.zero("total_quantity") == 0)).select("item_id")


@query("""
, live AS (SELECT document_id, item_id, line_no, section, NULL::VARCHAR AS sku FROM items WHERE section <> 'left_in_warehouse'),
rows AS (SELECT *, CASE section WHEN 'repacked' THEN 2 ELSE 0 END AS block FROM live UNION ALL SELECT document_id, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, '__SECTION_REPACKAGED__', 1 FROM live GROUP BY 1 HAVING bool_or(section = 'repacked') AND bool_or(section = 'shipped'))
SELECT document_id, item_id, sku, row_number() OVER (PARTITION BY document_id ORDER BY block, line_no) AS place FROM rows""")
def normal_then_repacked(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d).where("section <> 'left_in_warehouse'").select("document_id", "item_id", "line_no", "section")
    return R.compiled_blocks(items).select("document_id", "item_id", "sku", "place")


@query("""SELECT item_id FROM items WHERE product_id % 4 = 0 OR description LIKE '%ring%'""")
def footer_union(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d)
    return J.merged_by_id(items.where("product_id % 4 = 0"), items.where(F.col("description").contains("ring")), "item_id").select("item_id")


@query("""SELECT item_id, round(total_cbm::DOUBLE / nullif(total_cartons::DOUBLE, 0), 6) AS unit_cbm FROM items""")
def unit_cbm(spark: SparkSession, d: str) -> DataFrame:
    return C.items(spark, d).select("item_id", F.when(F.col("total_cartons") > 0, F.round(F.col("total_cbm").cast("double") / F.col("total_cartons").cast("double"), 6)).alias("unit_cbm"))


@query("""SELECT movement_id, product_id FROM movements JOIN part ON product_id = p_partkey WHERE contains(lower(p_name), 'ring') OR contains(movement_type, 'ring')""")
def movement_search(spark: SparkSession, d: str) -> DataFrame:
    names = C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    rows = C.movements(spark, d).join(names, "product_id")
    return rows.where(J.row_matches(("name", "movement_type"), "ring")).select("movement_id", "product_id")


@query("""
, live AS (SELECT document_id, sum(total_amount_rmb)::DOUBLE AS amount FROM items WHERE NOT deleted AND section = 'shipped' GROUP BY 1)
SELECT document_id, coalesce(amount, (document_id % 100)::DOUBLE) AS computed_amount, amount IS NOT NULL AS refreshed FROM docs LEFT JOIN live USING (document_id)""")
def totals_sync(spark: SparkSession, d: str) -> DataFrame:
    """Stored totals are replaced only for documents that have a live item."""
    stored = C.documents(spark, d).select("document_id", (F.col("document_id") % 100).cast("double").alias("computed_amount"))
    return R.totals_synced(stored, C.items(spark, d).where("section = 'shipped'"))


@query(r"""SELECT item_id, marks, shop, line_no::VARCHAR AS item_no, description AS description_of_goods, packaging AS packing, total_cartons::BIGINT || 'CTNS' AS t_ctn, total_quantity::BIGINT || 'pcs' AS t_qty, '' AS unit_cbm, regexp_replace(total_cbm::DOUBLE::VARCHAR, '\.0$', '') || 'CBM' AS t_cbm,
  '' AS unit_weight, regexp_replace(total_weight_kg::DOUBLE::VARCHAR, '\.0$', '') || 'KGS' AS t_weight, '¥' || regexp_replace(unit_price_rmb::DOUBLE::VARCHAR, '\.0$', '') AS u_price_rmb, '¥' || regexp_replace(total_amount_rmb::DOUBLE::VARCHAR, '\.0$', '') AS t_amount, section, coalesce(remarks, '') AS remarks
  FROM items WHERE product_id % 8 <> 0""")
def labelled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with units as the printed table has them; the labels as plain names."""
    none = F.lit(None).cast("double")
    items = C.items(spark, d).withColumns({"unit_cbm": none, "unit_weight_kg": none, "item_code": F.when(F.col("product_id") % 8 == 0, R.SENTINELS[1]).otherwise(F.col("item_code"))})
    rows = R.labelled_rows(items, "item_id")
    return rows.toDF(*(re.sub("[^a-z]+", "_", c.lower()).strip("_") for c in rows.columns)).drop("section_label")


@query("""SELECT item_id, '12pcs/ctn' AS packing, CASE WHEN product_id % 4 = 3 THEN '' ELSE product_id::VARCHAR END AS item_no, CASE WHEN product_id % 4 = 3 THEN '' ELSE description END AS description, CASE product_id % 4 WHEN 0 THEN '不锈钢' WHEN 1 THEN '壶 大' WHEN 2 THEN '壶 x/y' ELSE '12-a' END AS detail FROM items""")
def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    """Item number, name and detail in cells of their own, in one cell, in the lines of the packing cell, or missing."""
    k, p = F.col("product_id") % 4, F.col("product_id").cast("string")
    own = F.when(k == 0, F.array(p, F.col("description"), F.lit("不锈钢"), F.lit("12pcs/ctn"))).when(k == 1, F.array(F.concat_ws(" ", p, "description", F.lit("壶 大")), F.lit("12pcs/ctn")))
    other = F.when(k == 2, F.array(F.lit(""), F.concat(p, F.lit("\n"), "description", F.lit("\n壶\nx/y 12 pcs / ctn")))).otherwise(F.array(F.lit("12-a"), F.lit("12pcs/ctn")))
    cells = F.concat(F.array(F.col("marks"), F.col("shop")), F.coalesce(own, other), F.array(F.lit("3CTNS"), F.lit("36pcs")))
    return L.merged_cells(C.items(spark, d).select("item_id", cells.alias("cells")))


@query("""SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'NEW ORDERS' WHEN 1 THEN 'BEFORE GOODS MAG-' || line_no WHEN 2 THEN 'LOT ' || shop WHEN 3 THEN '37-T-1 18 CTN GOODS STUFFED INTO THIS CONTAINER' WHEN 4 THEN 'cups pans ' || line_no || ' lids' ELSE 'Shipped' END AS label FROM items""")
def shown_labels(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("item_id") % 6, F.col("line_no")
    raw = (
        F.when(k == 0, "new  order").when(k == 1, F.concat(F.lit("before goods mag-"), n)).when(k == 2, F.array_join(F.array_repeat(F.concat(F.lit("LOT "), F.col("shop")), 3), " "))
        .when(k == 3, "37-T-1 18 CTN GOODS STUFFED INTO THIS CO").when(k == 4, F.concat(F.lit("cups cups pans "), n, F.lit(" lids lids"))).otherwise(F.concat(F.lit("MS-301-"), n, F.lit(" ¥ 12 CBM 3")))
    )
    return C.items(spark, d).select("item_id", T.shown_label(F.lit("shipped"), T.section_label_tag(raw)).alias("label"))


@query("""SELECT item_id, line_no::VARCHAR AS first, description, total_quantity::BIGINT::VARCHAR AS last FROM items""")
def aligned_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a description in one cell, or over two."""
    from quaytally.sources import grids as G

    n = F.col("line_no").cast("string")
    split = F.split("description", " ", 2)
    cells = F.when(F.col("line_no") % 3 == 0, F.array(n, F.col("description"), whole("total_quantity"))).otherwise(F.concat(F.array(n), split, F.array(whole("total_quantity"))))
    rows = G.aligned_rows(C.items(spark, d).select("item_id", cells.alias("cells")), ["line_no", "description", "total_quantity"])
    return rows.select("item_id", F.col("cells")[0].alias("first"), F.col("cells")[1].alias("description"), F.element_at("cells", -1).alias("last"))


@query("""
, has AS (SELECT document_id, bool_or(product_id % 9 = 0) AS priced FROM items GROUP BY 1)
SELECT document_id, CASE WHEN product_id % 9 = 0 THEN 'MAG-512-1' ELSE marks END AS marks, item_code, description, total_quantity::DOUBLE AS total_quantity, total_amount_rmb::DOUBLE AS total_amount_rmb FROM items
UNION ALL SELECT document_id, 'MAG-512-' || n || ' SANCARGO', (77 + n)::VARCHAR, 'Food warmer FW-' || n, 30.0 + n, 1250.5 * n FROM has, (VALUES (1), (2)) v(n) WHERE NOT priced""")
def recovered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Priced rows of a document's flat text, for documents that have none."""
    items = C.items(spark, d).withColumn("marks", F.when(F.col("product_id") % 9 == 0, "MAG-512-1").otherwise(F.col("marks")))
    row = "MAG-512-{0} SANCARGO shop {0} {1} Food warmer FW-{0} {2}pcs 3CTNS ¥ 41 ¥ {3} "
    text = "NEW ORDER " + "".join(row.format(n, 77 + n, 30 + n, f"{1250.5 * n:,.2f}") for n in (1, 2))
    found = L.priced_rows(items.select("document_id").distinct().withColumn("text", F.lit(text)))
    columns = ("document_id", "marks", "item_code", "description", "total_quantity", "total_amount_rmb")
    plain = items.select("document_id", "marks", "item_code", "description", *(F.col(c).cast("double").alias(c) for c in columns[4:]))
    return J.appended_if_none(plain, found.select(*columns), F.trim("marks").rlike(L.PRICED_MARKS) & (F.col("total_amount_rmb") > 0))


@query("""SELECT document_id, line_no, item_code, description FROM items UNION ALL
SELECT document_id, 1000 + k, ['__FULL_EXTRACT__', '__SECTION_SUBTOTAL__', '__FOOTER__'][k], ['NEW ORDER', '12CTN 3CBM 4KGS', 'EXCHANGE RATE 6.80'][k] FROM (SELECT DISTINCT document_id FROM items), range(1, 4) r(k)""")
def full_extract(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d)
    texts = F.array(*(F.lit(x) for x in ("NEW ORDER", "12CTN 3CBM 4KGS", "EXCHANGE RATE 6.80")))
    other = items.select("document_id").distinct().select("document_id", F.posexplode(texts).alias("n", "text")).select("document_id", (1001 + F.col("n")).cast("long").alias("line_no"), "text")
    return J.full_extract(items, other)
