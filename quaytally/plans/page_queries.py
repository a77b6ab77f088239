"""Pages with all kinds of rows, built from the items and walked back to products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaytally.functions.columns import joined_in_order
from quaytally.plans.parse_queries import as_text, whole
from quaytally.plans.registry import query
from quaytally.sources import canonical as C
from quaytally.sources import grids as G
from quaytally.sources import imports as I
from quaytally.sources import lines as L
from quaytally.sources import pages as P
from quaytally.sources.shared import shared_folder

# Lines go in fours: the first stands below NEW ORDER, the second below goods from before (or left, by document), the
# third and fourth below a banner of their own. The fourth has no marks and is followed by a subtotal bar.
GROUPS = """
, r AS (SELECT *, line_no % 4 AS k, document_id % 2 = 0 AND line_no % 4 <> 1 AS carried, lag(shop) OVER w AS shop_above, lag(marks) OVER w AS marks_above FROM items WINDOW w AS (PARTITION BY document_id ORDER BY line_no)),
l AS (SELECT *, CASE k WHEN 1 THEN 'NEW ORDERS' WHEN 2 THEN CASE WHEN document_id % 2 = 0 THEN 'BEFORE GOODS MAG-4' ELSE 'GOODS LEFT IN SANCARGO WAREHOUSE' END WHEN 3 THEN 'SPARE PARTS FOR ' || shop ELSE 'SPARE PARTS FOR ' || shop_above END AS label FROM r),
s AS (SELECT *, CASE WHEN k = 1 THEN 'shipped' WHEN k = 2 THEN 'left_in_warehouse' ELSE rtrim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') END AS opened FROM l)"""
HEAD = ("MARKS", "ITEM NO", "DESCRIPTION", "T.CTN", "T.QTY", "T.AMOUNT", "T.CBM")


def manifest_pages(spark: SparkSession, d: str) -> DataFrame:
    """document_id, chunk, html: a text, a page of two tables, a footer."""
    k, n = F.col("line_no") % 4, F.col("line_no")
    tr = lambda *cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c if isinstance(c, F.Column) else F.lit(c), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    alone = lambda c: tr(c, *[""] * (len(HEAD) - 1))
    banner = F.when(k == 1, "NEW ORDER").when((k == 2) & (F.col("document_id") % 2 == 0), "before  goods MAG-4").when(k == 2, "GOODS LEFT IN SANCARGO").when(k == 3, F.concat(F.lit("SPARE PARTS FOR "), F.col("shop")))
    row = tr(F.when(k == 0, "").otherwise(F.col("marks")), F.col("item_code"), F.col("description"), F.concat(whole("total_cartons"), F.lit(" CTNS")), whole("total_quantity"), F.format_number("total_amount_rmb", 2), as_text("total_cbm"))
    bar = F.when(k == 0, tr("", "", F.concat(whole("total_cartons"), F.lit(" CTNS "), as_text("total_cbm"), F.lit(" CBM 5 KGS ¥ "), F.format_number("total_amount_rmb", 2)), "", "", "", ""))
    head = "<table>" + "".join(["<tr>", *(f"<td>{c}</td>" for c in HEAD), "</tr>"])
    # every eighth line opens another table, below a text
    opens = F.when((n > 1) & (n % 8 == 1), F.lit(f"</table><p>see also</p>{head}")).otherwise("")
    html = F.concat(opens, F.coalesce(alone(banner), F.lit("")), row, F.coalesce(bar, F.lit("")))
    rows = C.items(spark, d).groupBy("document_id").agg(joined_in_order("line_no", html, "").alias("rows"))
    parts = F.array(F.lit("CLIENT DETAILS: x"), F.concat(F.lit(head), "rows", alone("TOTAL WEIGHT 9 KGS"), F.lit("</table>")), F.lit("TOTAL CARTON 7 CTNS"))
    return rows.select("document_id", F.posexplode(parts).alias("chunk", "html"))


@query(f"""{GROUPS}
SELECT document_id, line_no, CASE WHEN carried THEN 'left_in_warehouse' ELSE opened END AS section, CASE WHEN k = 0 THEN marks_above ELSE marks END AS marks, item_code, description, total_cartons::DOUBLE AS total_cartons, total_quantity::DOUBLE AS total_quantity,
  floor(total_amount_rmb::DOUBLE / total_quantity::DOUBLE * 100 + 0.5) / 100 AS unit_price_rmb, CASE WHEN NOT carried THEN total_amount_rmb::DOUBLE END AS total_amount_rmb, total_cbm::DOUBLE AS total_cbm,
  CASE WHEN carried THEN 'carryover:before_goods;repair:before_goods_amount_carryover_ignored;' ELSE '' END || 'section_label:' || replace(replace(label, ' ', '%20'), '#', '%23') AS remarks FROM s""")
def page_products(spark: SparkSession, d: str) -> DataFrame:
    """Products out of pages: sections, own keys of unknown banners, goods from before, marks carried down, inferred prices."""
    found = P.products(P.walked(manifest_pages(spark, d)))
    return found.select("document_id", F.col("line_no").cast("long").alias("line_no"), "section", "marks", "item_code", "description", "total_cartons", "total_quantity", "unit_price_rmb", "total_amount_rmb", "total_cbm", "remarks")


@query(f"""{GROUPS}
SELECT document_id, opened AS section, total_cartons::DOUBLE AS total_cartons, total_cbm::DOUBLE AS total_cbm, 5.0::DOUBLE AS total_weight_kg, total_amount_rmb::DOUBLE AS total_amount_rmb FROM s WHERE k = 0 AND NOT carried""")
def page_subtotals(spark: SparkSession, d: str) -> DataFrame:
    """Subtotal bars by section; those of goods from before are left out."""
    return P.section_subtotals(P.walked(manifest_pages(spark, d))).drop("chunk", "piece", "row")


@query(f"""{GROUPS},
e AS (SELECT document_id, -1 AS pos, 'shipped' AS section, '__FULL_EXTRACT__' AS item_code, 'full_extract:text_block' AS remarks FROM (SELECT DISTINCT document_id FROM items)
  UNION ALL SELECT document_id, line_no * 10 - 1, opened, '__FULL_EXTRACT__', 'full_extract:' || CASE k WHEN 1 THEN 'new_order' WHEN 2 THEN CASE WHEN document_id % 2 = 0 THEN 'before_goods' ELSE 'goods_left' END ELSE 'unknown_section_banner' END FROM s WHERE k <> 0
  UNION ALL SELECT document_id, line_no * 10, NULL, NULL, NULL FROM s
  UNION ALL SELECT document_id, line_no * 10 + 1, opened, '__SECTION_SUBTOTAL__', NULL FROM s WHERE k = 0
  UNION ALL SELECT document_id, 1000, last(opened ORDER BY line_no), '__FOOTER__', NULL FROM s GROUP BY 1
  UNION ALL SELECT document_id, 1001, last(opened ORDER BY line_no), '__FULL_EXTRACT__', 'full_extract:text_block' FROM s GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS line_no FROM e)
SELECT document_id, line_no, section, item_code, remarks FROM numbered WHERE item_code IS NOT NULL""")
def page_review_rows(spark: SparkSession, d: str) -> DataFrame:
    """Full extraction: what is no product, by kind, in its section and at its line."""
    rows = P.products(P.walked(manifest_pages(spark, d)), full=True)
    return rows.where(F.col("item_code").isin(P.EXTRACT_CODE, P.SUBTOTAL_CODE, P.FOOTER_CODE)).select("document_id", F.col("line_no").cast("long").alias("line_no"), "section", "item_code", "remarks")


@query("""SELECT document_id AS page_id, line_no - 1 AS row, c AS col, CASE WHEN c = 0 THEN item_code WHEN line_no % 3 <> 0 THEN marks ELSE '' END AS text FROM items, range(2) r(c) WHERE document_id IN (SELECT document_id FROM items WHERE line_no % 3 <> 0)""")
def html_ragged_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one cell and of two: all are as wide as the widest."""
    row = F.concat(F.lit("<tr><td>"), "item_code", F.when(F.col("line_no") % 3 == 0, "").otherwise(F.concat(F.lit("</td><td>"), "marks")), F.lit("</td></tr>"))
    rows = C.items(spark, d).groupBy("document_id").agg(joined_in_order("line_no", row, "\n").alias("rows"))
    return G.html_cells(rows.select(F.col("document_id").alias("page_id"), F.concat(F.lit("<table>"), "rows", F.lit("</table>")).alias("html"))).drop("table")


# Imports by document: every third a sales order, every third a packing list, the others plain exports.
@query("""
, r AS (SELECT *, document_id % 3 AS layout, line_no % 4 AS k, total_cartons::DOUBLE AS c, total_quantity::DOUBLE AS q, total_amount_rmb::DOUBLE AS a FROM items),
m AS (SELECT document_id, line_no, CASE layout WHEN 0 THEN marks WHEN 1 THEN CASE WHEN k = 3 AND line_no = 3 THEN '__SECTION_STAGE__:37 goods stuffed into this container' ELSE marks END ELSE item_code END AS sku,
  CASE WHEN layout = 1 AND line_no = 3 THEN '37 goods stuffed into this container' WHEN layout = 1 AND k = 2 THEN '壶 ' || description ELSE description END AS name,
  CASE WHEN layout = 2 THEN NULL WHEN layout = 1 AND (line_no = 3 OR k = 2) THEN NULL WHEN layout = 0 AND k = 1 AND (q / c) = floor(q / c) THEN (q / c)::BIGINT || 'pcs/ctn' WHEN layout = 0 AND k = 1 THEN NULL ELSE packaging END AS packing,
  CASE WHEN layout = 2 THEN NULL WHEN layout = 1 AND line_no = 3 THEN 0 ELSE c END AS cartons, CASE WHEN layout = 1 AND line_no = 3 THEN 0 ELSE q END AS quantity,
  CASE WHEN layout = 1 AND line_no = 3 THEN 0 WHEN layout = 0 AND k = 2 THEN floor(a / q * 10000 + 0.5) / 10000 WHEN layout = 1 AND k = 1 THEN floor(a / q * 100 + 0.5) / 100 ELSE unit_price_rmb::DOUBLE END AS cost_price,
  CASE WHEN layout = 2 OR layout = 1 AND line_no = 3 THEN NULL WHEN layout = 0 AND k = 3 THEN floor(q * unit_price_rmb::DOUBLE * 100 + 0.5) / 100 ELSE a END AS total_amount_rmb,
  CASE WHEN layout = 0 AND k = 1 THEN CASE WHEN (q / c) = floor(q / c) THEN 'repair:packing_from_qty_cartons' ELSE 'repair:drop_non_numeric_packing' END WHEN layout = 0 AND k = 2 THEN 'repair:price_from_amount' WHEN layout = 0 AND k = 3 THEN 'repair:amount_from_qty_price' END AS remarks
  FROM r WHERE NOT (layout = 1 AND (line_no = 5 OR line_no >= 7)))
SELECT * FROM m""")
def imported_rows(spark: SparkSession, d: str) -> DataFrame:
    """Keys under other names, cells that don't read as a price, names in the packing column, markers, and the header of repacked goods."""
    n, k, layout = F.col("line_no"), F.col("line_no") % 4, F.col("document_id") % 3
    money = F.format_number("total_amount_rmb", 2)
    price = F.col("unit_price_rmb").cast("string")
    cell = lambda key, value: F.struct(F.lit(key).alias("k"), value.alias("v"))
    sales = [
        cell("item_code", F.col("marks")), cell("DESCRIPTION OF GOODS", F.col("description")), cell("PACKING", F.when(k == 1, "box").otherwise(F.col("packaging"))), cell("CTN", F.concat(whole("total_cartons"), F.lit(" CTNS"))), cell("T.QTY", whole("total_quantity")),
        cell("U/P", F.lit("see below")), cell("PRICE", F.when(k == 2, "-").otherwise(F.concat(F.lit("¥"), price))), cell("AMOUNT", F.when(k == 3, "").otherwise(money)),
    ]
    marks = F.when(n == 3, "__SECTION_STAGE__:37 goods stuffed into this container").when(n == 5, "GOODS LEFT IN SANCARGO").when(n == 7, "9 CTN STUFFED INTO THIS CONTAINER (REPACKED GOODS)").otherwise(F.col("marks"))
    name = F.when(k == 2, F.concat(F.lit("壶 "), F.col("description")))
    packing = [
        cell("MARKS", marks), cell("DESCRIPTION OF GOODS", F.when(k == 2, "壶").otherwise("壶")), cell("__col6", F.when(k == 2, "").otherwise(F.col("description"))), cell("PACKING", F.coalesce(name, F.col("packaging"))), cell("T.CTN", whole("total_cartons")), cell("T.QTY", whole("total_quantity")),
        cell("U.PRICE(RMB)", F.when(k == 1, "").otherwise(price)), cell("T.AMOUNT", money),
    ]
    plain = [cell("SKU", F.col("item_code")), cell("Name", F.col("description")), cell("Quantity", whole("total_quantity")), cell("Cost Price", price), cell("other", F.lit("x"))]
    cells = F.map_from_entries(F.when(layout == 0, F.array(*sales)).when(layout == 1, F.array(*packing)).otherwise(F.array(*plain)))
    rows = C.items(spark, d).select(F.col("document_id").alias("file"), n.alias("record"), cells.alias("cells"))
    found = I.imported_rows(rows, F.col("file") % 3 == 0)
    return found.select(F.col("file").alias("document_id"), F.col("record").alias("line_no"), "sku", "name", "packing", "cartons", "quantity", "cost_price", "total_amount_rmb", "remarks")


@query("""
, r AS (SELECT *, nullif(CASE line_no % 3 WHEN 1 THEN '' WHEN 2 THEN marks ELSE item_code END, '') AS order_no, CASE WHEN line_no >= 3 THEN 'C-' || line_no END AS customer_no FROM items),
f AS (SELECT document_id, min(line_no) FILTER (order_no IS NOT NULL) AS l1, min(line_no) FILTER (customer_no IS NOT NULL) AS l2 FROM r GROUP BY 1)
SELECT f.document_id, a.order_no, b.customer_no, 'dock ' || f.document_id % 7 AS delivery_address, CASE WHEN f.document_id % 2 = 0 THEN '2026-03-15' END AS document_date
FROM f LEFT JOIN r a ON a.document_id = f.document_id AND a.line_no = l1 LEFT JOIN r b ON b.document_id = f.document_id AND b.line_no = l2""")
def order_context(spark: SparkSession, d: str) -> DataFrame:
    """What rows say about their order: under the first key or the second, blank at first, in several rows, and a date that is none."""
    n = F.col("line_no")
    cell = lambda key, value: F.struct(F.lit(key).alias("k"), value.cast("string").alias("v"))
    entries = [
        cell("ORD NO.", F.when(n % 3 == 2, F.col("marks")).otherwise(" ")), cell("order_no", F.when(n % 3 == 0, F.col("item_code")).otherwise("")), cell("customer_no", F.when(n >= 3, F.concat(F.lit("C-"), n)).otherwise("")),
        cell("delivery_address", F.concat(F.lit("late "), n)), cell("送货地址", F.concat(F.lit("dock "), F.col("document_id") % 7)), cell("DATE", F.when(F.col("document_id") % 2 == 0, "15/03/2026").otherwise("March")),
    ]
    rows = C.items(spark, d).select(F.col("document_id").alias("file"), n.alias("record"), F.map_from_entries(F.array(*entries)).alias("cells"))
    return I.order_context(rows).withColumnRenamed("file", "document_id")


@query("""SELECT document_id, 'ABCD' || (1000000 + document_id) AS container_no, CASE WHEN document_id % 2 = 0 THEN '2026-03-15' ELSE '2001-01-01' END AS document_date, (5 + document_id % 7)::DOUBLE AS total_cartons, 70.125::DOUBLE AS total_cbm, 23183.0::DOUBLE AS total_weight_kg, (1000 + document_id)::DOUBLE AS total_amount_rmb FROM docs""")
def part_facts(spark: SparkSession, d: str) -> DataFrame:
    """Documents in parts: other dates and other lines of totals in header, table and footer."""
    n = F.col("document_id")
    head = F.concat(F.lit("CONTAINER NO.: ABCD"), F.lit(1_000_000) + n, F.lit(" 9 CTN 9 CBM 9 KGS ¥9 "), F.when(n % 2 == 0, "DATE: 2026/03/15").otherwise("no day"))
    table = F.lit("<table><tr><td>2019-12-31</td><td>TOTAL 8 CTN 8 CBM 8 KGS ¥8</td></tr></table>")
    foot = F.concat(F.lit("TOTAL "), 5 + n % 7, F.lit(" CTNS 70.125 CBM 23183 KGS ¥"), F.format_number(F.lit(1000) + n, 0), F.lit(" DATE: 2001-01-01"))
    chunks = C.documents(spark, d).select("document_id", F.posexplode(F.array(head, table, foot)).alias("chunk", "html"))
    facts = L.document_facts(L.document_parts(chunks), "text", "header", "footer")
    return facts.select("document_id", "container_no", "document_date", "total_cartons", "total_cbm", "total_weight_kg", "total_amount_rmb")


def note_files(spark: SparkSession, d: str) -> str:
    """A folder with a CSV file for each supplier: a title, a header, a record for each item; some cells are quoted, with
    commas, quotes and line breaks."""
    quoted = F.concat(F.lit('"'), F.col("description"), F.lit(', ""best""\nof '), "shop", F.lit('"'))
    record = F.concat_ws(",", F.concat(F.lit("#"), "item_id"), F.when(F.col("line_no") % 2 == 0, quoted).otherwise(F.col("description")), F.concat(whole("total_quantity"), F.lit("\r")))
    rows = C.items(spark, d).groupBy("supplier_id").agg(F.array_join(F.sort_array(F.collect_list(record)), "\n").alias("records"))
    folder = shared_folder(spark, "notes")
    rows.select(F.concat(F.lit("notes of the week\nSKU,NAME,QTY\r\n"), "records")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


NOTE = """CASE WHEN line_no % 2 = 0 THEN description || ', "best"' || chr(10) || 'of ' || shop ELSE description END"""


@query(f"""SELECT '#' || item_id AS first, {NOTE} AS second, total_quantity::BIGINT::VARCHAR AS third FROM items""")
def csv_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of CSV files, with commas, quotes and line breaks inside of cells."""
    rows = G.delivery_notes(spark, note_files(spark, d)).where("size(cells) = 3 and cells[0] <> 'SKU'")
    return rows.select(*(F.col("cells")[i].alias(c) for i, c in enumerate(("first", "second", "third"))))


@query(f"""SELECT '#' || item_id AS sku, {NOTE} AS name, total_quantity::BIGINT::VARCHAR AS qty FROM items""")
def csv_headed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows below the header of their file, as maps."""
    rows = G.headed_rows(G.delivery_notes(spark, note_files(spark, d)))
    return rows.select(*(F.col("cells")[k].alias(k.lower()) for k in ("SKU", "NAME", "QTY")))


@query("""SELECT item_id, 'a' || item_id AS first, CASE WHEN item_id % 2 = 0 THEN 'b,' || line_no ELSE '"' || line_no END AS second FROM items""")
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    """One record a file's line, read back by its first cell."""
    record = F.concat(F.lit("a"), "item_id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(',"b,'), "line_no", F.lit('"'))).otherwise(F.concat(F.lit(',""""'), "line_no")))
    folder = shared_folder(spark, "records")
    C.items(spark, d).select(record).write.text(folder)
    rows = G.delivery_notes(spark, folder).where("size(cells) = 2")
    return rows.select(F.substring(F.col("cells")[0], 2, 30).cast("long").alias("item_id"), F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"))
