"""Texts, grids and lines built from the items and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaytally.functions.columns import joined_in_order
from quaytally.functions.headers import field_of_label
from quaytally.plans.registry import query
from quaytally.sources import canonical as C
from quaytally.sources import grids as G
from quaytally.sources import lines as L
from quaytally.sources import sales as X


def as_text(c: str) -> F.Column:
    return F.col(c).cast("double").cast("decimal(18,4)").cast("double").cast("string")


def whole(c: str) -> F.Column:
    return F.col(c).cast("long").cast("string")


MARKUP, SHOWN = " &amp;amp; caf&#233; &#x20AC;<br>x<br/>Y&lt;1&gt;", " &amp; café € x Y<1>"


def item_pages(spark: SparkSession, d: str, spans: bool = False) -> DataFrame:
    """An HTML page for each document: a title row over all columns, a header row, a row per item.

    With spans, every second or third row (by document) opens with a cell of the shop that goes on in the rows below."""
    shop = F.concat(F.lit("<td rowspan='"), 2 + F.col("document_id") % 2, F.lit("'>"), F.col("shop"), F.lit("</td>"))
    opens = F.when((F.col("line_no") - 1) % (2 + F.col("document_id") % 2) == 0, shop).otherwise("") if spans else F.lit("")
    row = F.concat(F.lit("<tr>"), opens, F.lit("<td>"), F.col("line_no"), F.lit("</td><td>"), F.col("item_code"), F.lit("</td><td>"), F.col("description"), F.lit(MARKUP + "</td><td><b>"), whole("total_quantity"), F.lit("</b>&nbsp;</td></tr>"))
    rows = C.items(spark, d).groupBy("document_id").agg(joined_in_order("line_no", row, "\n").alias("rows"))
    head = f"<p>list</p><TABLE border=1><tr><td colspan={4 + spans}>order &amp; goods</td></tr><tr>{'<th>SHOP</th>' * spans}<th>No.:</th><th>ITEM NO</th><th>DES.</th><th>T.QTY</th></tr>"
    return rows.select(F.col("document_id").alias("page_id"), F.concat(F.lit(head), "rows", F.lit("</TABLE>")).alias("html"))


@query(f"""SELECT document_id AS page_id, 0 AS "table", 0 AS row, c AS col, 'order & goods' AS text FROM (SELECT DISTINCT document_id FROM items), range(4) r(c)
UNION ALL SELECT document_id, 0, 1, c, ['No.:', 'ITEM NO', 'DES.', 'T.QTY'][c + 1] FROM (SELECT DISTINCT document_id FROM items), range(4) r(c)
UNION ALL SELECT document_id, 0, line_no + 1, c, [line_no::VARCHAR, item_code, description || '{SHOWN}', total_quantity::BIGINT::VARCHAR][c + 1] FROM items, range(4) r(c)""")
def html_cells(spark: SparkSession, d: str) -> DataFrame:
    return G.html_cells(item_pages(spark, d))


@query(f"""SELECT document_id AS page_id, 0 AS "table", 0 AS row, c AS col, 'order & goods' AS text FROM (SELECT DISTINCT document_id FROM items), range(5) r(c)
UNION ALL SELECT document_id, 0, 1, c, ['SHOP', 'No.:', 'ITEM NO', 'DES.', 'T.QTY'][c + 1] FROM (SELECT DISTINCT document_id FROM items), range(5) r(c)
UNION ALL SELECT i.document_id, 0, i.line_no + 1, c, [f.shop, i.line_no::VARCHAR, i.item_code, i.description || '{SHOWN}', i.total_quantity::BIGINT::VARCHAR][c + 1]
  FROM items i JOIN items f ON f.document_id = i.document_id AND f.line_no = i.line_no - (i.line_no - 1) % (2 + i.document_id % 2), range(5) r(c)""")
def html_cells_rowspan(spark: SparkSession, d: str) -> DataFrame:
    return G.html_cells(item_pages(spark, d, spans=True))


@query(f"""SELECT document_id AS page_id, line_no + 1 AS row, item_code, description || '{SHOWN}' AS description, total_quantity::BIGINT::VARCHAR AS total_quantity FROM items""")
def html_field_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.field_rows(item_pages(spark, d), ("item_code", "description", "total_quantity")).drop("table")


@query("""SELECT document_id AS page_id, line_no + 1 AS row, item_code, description, total_weight_kg::VARCHAR AS total_weight_kg, material, shop AS warehouse FROM items""")
def html_two_header_rows(spark: SparkSession, d: str) -> DataFrame:
    """Grouped columns: the second header row names what the first leaves open, or both do together."""
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *map(cell, ("line_no", "item_code", "description", "total_weight_kg", "material", "shop")), F.lit("</tr>"))
    rows = C.items(spark, d).groupBy("document_id").agg(joined_in_order("line_no", row, "").alias("rows"))
    head = "<table><tr><td>NO.</td><td colspan=2>GOODS</td><td>TOTAL</td><td>MATERIAL</td><td>W.H.</td></tr><tr><td></td><td>ITEM NO</td><td>DES.</td><td>WEIGHT</td><td></td><td></td></tr>"
    pages = rows.select(F.col("document_id").alias("page_id"), F.concat(F.lit(head), "rows", F.lit("</table>")).alias("html"))
    return G.field_rows(pages, ("item_code", "description", "total_weight_kg", "material", "warehouse")).drop("table")


# label, its field in manifests, its field in sales orders
LABELS = (
    ("U.PRICE(RMB)", "unit_price_rmb", None), ("T. AMOUNT", "total_amount_rmb", "total_amount_rmb"), ("unit  price (¥)", "unit_price_rmb", "unit_price_rmb"), ("BOX .NO", "box_no_start", None), ("DEL NO. 送货单号", None, "delivery_no"),
    ("ITEM NO：", "item_code", "item_code"), ("客户货号 (CUS)", None, "customer_item_ref"), ("T.T.CBM 总体积", None, "total_cbm"), ("QTY pcs", None, "packaging"), ("W.H.", None, "warehouse"), ("L （cm）", None, "dim_l_cm"), ("image", "skip", None), ("colour", None, None), ("品名", "description", "product_name_local"),
)


@query(f"""SELECT item_id, container, sales FROM items JOIN (VALUES {', '.join(str((i, c or '', s or '')) for i, (_, c, s) in enumerate(LABELS))}) v(i, c, s) ON product_id % {len(LABELS)} = i, LATERAL (SELECT nullif(c, '') AS container, nullif(s, '') AS sales)""")
def column_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels are resolved once each, then joined to the rows that have them."""
    rows = C.items(spark, d).select("item_id", F.element_at(F.array(*(F.lit(x) for x, _, _ in LABELS)), (F.col("product_id") % len(LABELS) + 1).cast("int")).alias("label"))
    fields = rows.select("label").distinct().select("label", field_of_label(F.col("label"), False).alias("container"), field_of_label(F.col("label"), True).alias("sales"))
    return rows.join(fields, "label").drop("label")


def manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each item as a marks line and either one data line or three."""
    rest = [F.concat(F.lit("SANCARGO "), F.col("shop"), F.lit(" "), F.col("description")), F.concat(F.col("packaging"), F.lit(" "), whole("total_cartons"), F.lit("CTNS "), whole("total_quantity"), F.lit("pcs")), F.concat(as_text("total_cbm"), F.lit("CBM ¥"), F.col("unit_price_rmb"), F.lit(" ¥"), F.col("total_amount_rmb"))]
    body = F.when(F.col("line_no") % 2 == 0, F.array(F.array_join(F.array(*rest), " "))).otherwise(F.array(*rest))
    return C.items(spark, d).select("document_id", F.posexplode(F.concat(F.array("marks"), body)).alias("n", "text"), F.col("line_no").alias("item_line")).select("document_id", (F.col("item_line") * 10 + F.col("n")).alias("line_no"), "text")


@query("""SELECT document_id, line_no * 10 AS first_line, marks, packaging, total_cartons::DOUBLE AS total_cartons, total_quantity::DOUBLE AS total_quantity, total_cbm::DOUBLE AS total_cbm, unit_price_rmb::DOUBLE AS unit_price_rmb, total_amount_rmb::DOUBLE AS total_amount_rmb FROM items""")
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return L.manifest_rows(manifest_lines(spark, d))


@query("""SELECT document_id, marks, total_cartons::DOUBLE AS total_cartons, total_cbm::DOUBLE AS total_cbm FROM items""")
def flat_manifest(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat(F.col("marks"), F.lit(" SANCARGO x "), whole("total_cartons"), F.lit("CTNS 0.001CBM "), as_text("total_cbm"), F.lit("CBM "))
    flat = C.items(spark, d).groupBy("document_id").agg(F.concat(joined_in_order("line_no", row, ""), F.lit("TOTAL WEIGHT 9KGS")).alias("text"))
    return L.flat_manifest_rows(flat).select("document_id", "marks", "total_cartons", "total_cbm")


@query("""SELECT item_id, packaging, total_cartons::DOUBLE AS total_cartons, total_quantity::DOUBLE AS total_quantity, total_cbm::DOUBLE AS total_cbm, total_weight_kg::DOUBLE AS total_weight_kg, unit_price_rmb::DOUBLE AS unit_price_rmb, total_amount_rmb::DOUBLE AS total_amount_rmb FROM items""")
def cell_pattern_rows(spark: SparkSession, d: str) -> DataFrame:
    cells = [F.col("marks"), F.col("description"), F.col("packaging"), F.concat(whole("total_cartons"), F.lit("CTNS")), F.concat(whole("total_quantity"), F.lit("pcs")), F.lit("0.001CBM"), F.concat(as_text("total_cbm"), F.lit("CBM")), F.lit("1KGS"), F.concat(as_text("total_weight_kg"), F.lit("KGS")), F.concat(F.lit("¥"), F.col("unit_price_rmb")), F.concat(F.lit("¥"), F.col("total_amount_rmb"))]
    moved = F.when(F.col("line_no") % 2 == 0, F.concat(F.array(F.lit("")), F.array(*cells))).otherwise(F.array(*cells))
    return L.pattern_rows(C.items(spark, d).select("item_id", moved.alias("cells")))


TAILS = ("dim_l_cm", "dim_w_cm", "dim_h_cm", "unit_cbm", "unit_weight_kg", "total_cbm", "total_weight_kg")


@query("""
, r AS (SELECT *, line_no % 7 AS k, document_id % 4 <> 3 AS sales, total_cartons::DOUBLE + 1 AS c, qty_per_carton::DOUBLE AS p FROM items),
n AS (SELECT *, sales AND (k IN (0, 1) OR k = 2 AND c <= 600 AND p <= 200) AS found FROM r)
SELECT item_id, CASE WHEN sales AND k IN (0, 4) THEN 'SAN' || product_id ELSE CASE WHEN k = 6 THEN marks ELSE '' END END AS marks,
  CASE WHEN sales AND k = 5 THEN '浦江仓' WHEN k = 5 THEN '浦江仓  PCS' WHEN found AND k = 0 THEN '12仓' WHEN found AND k = 2 THEN '东阳仓' WHEN found THEN '浙江仓' END AS warehouse,
  CASE WHEN found THEN c WHEN k = 3 AND sales THEN round(c * p / p, 3) WHEN k = 3 THEN c * p + 1 WHEN k = 6 AND NOT sales THEN 50001.0 END AS total_cartons,
  CASE WHEN found OR k = 3 THEN c * p END AS total_quantity, CASE WHEN found THEN 2.5 WHEN k = 5 THEN 400000.0 WHEN k = 6 AND NOT sales THEN 500001.0 END AS unit_price_rmb, CASE WHEN found THEN c * p * 2.5 END AS total_amount_rmb, CASE WHEN found THEN 30.0 END AS dim_l_cm, CASE WHEN found THEN 37.5 END AS total_weight_kg FROM n""")
def tail_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Stored sales rows: twelve numbers before the warehouse, with others behind it; behind the warehouse alone; and in rows
    that can't be mended (a wrong amount). Codes as marks, units in the warehouse, too many cartons, absurd numbers."""
    k = F.col("line_no") % 7
    c, p = F.col("total_cartons").cast("long") + 1, F.col("qty_per_carton").cast("long")
    amount = F.when(k == 4, F.lit("999999999")).otherwise((c * p * 2.5).cast("decimal(18,1)").cast("string"))
    numbers = F.concat_ws(" ", c, p, c * p, F.lit("2.5"), amount, F.lit("30 20 10 0.25 12.5 0.75 37.5"))
    text = F.when(k == 0, F.concat_ws(" ", F.lit("pan 3x40"), numbers, F.lit("12仓 PCS 7 8 9"))).when(k == 1, F.concat_ws("/", F.split(numbers, " ")[0], F.array_join(F.slice(F.split(numbers, " "), 2, 11), "cm "), F.lit("浙江仓")))
    text = text.when(k == 2, F.concat_ws(" ", F.lit("lid 5 东阳仓"), numbers)).when(k == 4, F.concat_ws(" ", numbers, F.lit("12仓")))
    none = lambda t="double": F.lit(None).cast(t)
    columns = {x: none() for x in TAILS} | {
        "marks": F.when(k == 6, F.col("marks")).otherwise(""), "item_code": F.when(k.isin(0, 4), F.concat(F.lit("san"), "product_id")).otherwise(F.col("item_code")), "warehouse": F.when(k == 5, "浦江仓  PCS"), "description": text,
        "total_cartons": F.when(k == 3, c * p + 1).when(k == 6, 50_001), "qty_per_carton": F.when(k == 3, p), "total_quantity": F.when(k == 3, c * p), "unit_price_rmb": F.when(k == 5, 400_000).when(k == 6, 500_001), "total_amount_rmb": none(),
    }
    rows = C.items(spark, d).select("item_id", "document_id", *(v.alias(x) for x, v in columns.items()))
    found = X.stored_rows_normalised(rows, F.col("document_id") % 4 != 3)
    return found.select("item_id", "marks", "warehouse", "total_cartons", "total_quantity", "unit_price_rmb", "total_amount_rmb", "dim_l_cm", "total_weight_kg")


@query("""SELECT document_id, sum(total_cartons)::DOUBLE AS cartons, sum(total_cbm)::DOUBLE AS cbm, sum(total_amount_rmb)::DOUBLE AS rmb FROM items GROUP BY 1""")
def subtotal_bars(spark: SparkSession, d: str) -> DataFrame:
    sums = C.items(spark, d).groupBy("document_id").agg(F.sum("total_cartons").alias("c"), F.sum("total_cbm").alias("v"), F.sum("total_amount_rmb").alias("a"))
    bars = sums.select("document_id", F.lit(900).alias("line_no"), F.concat(F.col("c").cast("long"), F.lit("CTN "), F.col("v"), F.lit("CBM 5KGS ¥"), F.format_number("a", 2)).alias("text"))
    rows = manifest_lines(spark, d).select("document_id", "line_no", "text").unionByName(bars)
    return L.subtotal_bars(rows).select("document_id", "cartons", "cbm", "rmb")


@query("""
, extra AS (SELECT DISTINCT document_id FROM items)
SELECT document_id, line_no * 10 AS line_no, NULL::VARCHAR AS stage_total FROM items WHERE line_no <= CASE WHEN document_id % 3 = 2 THEN 999 ELSE 4 END
UNION ALL SELECT document_id, 31, '12CTNS 3.5CBM 45KGS ¥1,200' FROM extra WHERE document_id % 2 = 0 UNION ALL SELECT document_id, 32, NULL FROM extra WHERE document_id % 2 = 0
UNION ALL SELECT document_id, 33, '7CTN 1CBM 2KGS' FROM extra WHERE document_id % 2 = 1""")
def stage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Product lines with a printed total on one line or two, and a header over two lines, a banner, or no end."""
    items = C.items(spark, d)
    rows = items.select("document_id", (F.col("line_no") * 10).alias("line_no"), F.concat_ws(" ", "marks", F.lit("SANCARGO"), "description", "packaging").alias("text"))
    kind = F.col("document_id") % 3
    more = {31: F.when(F.col("document_id") % 2 == 0, "12CTNS  3.5 CBM"), 32: F.when(F.col("document_id") % 2 == 0, "45 KGS ¥ 1,200"), 33: F.when(F.col("document_id") % 2 == 1, "7 ctn 1CBM 2KGS"), 41: F.when(kind == 0, "Goods left in").when(kind == 1, "9 CTN goods stuffed into this container"), 42: F.when(kind == 0, "SANCARGO warehouse")}
    added = items.select("document_id").distinct().select("document_id", F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("line_no"), t.alias("text")) for n, t in more.items()))).alias("e")).select("document_id", "e.*").where("text is not null")
    return L.stage_lines(rows.unionByName(added)).select("document_id", "line_no", "stage_total")


@query("""SELECT document_id, line_no % 3 = 2 AS carried, CASE line_no % 4
  WHEN 0 THEN marks || ' SANCARGO ' || shop || ' ' || packaging || ' ' || total_cartons::BIGINT || 'CTNS'
  WHEN 1 THEN marks || ' SANCARGO ' || shop || ' x 1' ELSE marks || ' SANCARGO ' || shop || ' ' || packaging END AS text FROM items""")
def fragment_lines(spark: SparkSession, d: str) -> DataFrame:
    """Three items a page. Marks stand above their SANCARGO line, for the last item of a page on the page before."""
    n, last = F.col("line_no"), F.col("line_no") % 3 == 2
    page, top = F.floor(n / 3) + F.when(last, 1).otherwise(0), F.when(last, 950.0).otherwise(900.0 - (n % 3) * 100)
    piece = lambda p, x, y, c: F.struct(p.cast("long").alias("page"), F.lit(x).alias("x"), y.alias("y"), c.cast("string").alias("text"))
    # what stands below a SANCARGO line without packing is part of it
    below = F.when(n % 4 == 0, F.concat_ws(" ", "packaging", F.concat(whole("total_cartons"), F.lit("CTNS")))).when(n % 4 == 1, F.lit("x 1")).otherwise(F.lit(" "))
    beside = F.when(n % 4 > 1, F.col("packaging")).otherwise(F.lit(" "))
    parts = F.array(piece(page, 60.0, top - 10, F.col("shop")), piece(F.floor(n / 3), 10.0, F.when(last, 5.0).otherwise(top), F.col("marks")), piece(page, 20.0, top - 9.5, F.lit("SANCARGO")), piece(page, 90.0, top - 10, beside), piece(page, 30.0, top - 20, below))
    fragments = C.items(spark, d).select("document_id", F.explode(parts).alias("p")).select("document_id", "p.*")
    joined = L.manifest_lines_joined(L.fragments_to_lines(fragments))
    return joined.select("document_id", (F.col("row") > 230).alias("carried"), "text")


@query("""
, l AS (SELECT document_id, row_number() OVER w - 1 AS i, line_no * 10 + n AS line_no, n = 0 AS anchor, sum((n = 0)::INT) OVER w - (n = 0)::INT AS anchors
  FROM items, range(4) r(n) WHERE n < CASE WHEN line_no % 2 = 0 THEN 2 ELSE 4 END WINDOW w AS (PARTITION BY document_id ORDER BY line_no * 10 + n)),
steps AS (
  SELECT document_id, i, 0::BIGINT AS b, 0 AS chunk FROM l WHERE i = 0
  UNION ALL SELECT document_id, i, CASE WHEN cut THEN greatest(b, i - 2) ELSE b END, CASE WHEN cut THEN chunk + 1 ELSE chunk END
  FROM (SELECT s.document_id, n.i, s.b, s.chunk, n.anchor AND n.i > s.b AND n.anchors - f.anchors >= 2 OR n.i - s.b >= 5 AS cut
    FROM steps s JOIN l n ON n.document_id = s.document_id AND n.i = s.i + 1 JOIN l f ON f.document_id = s.document_id AND f.i = s.b)),
ends AS (SELECT document_id, chunk, min(b) AS b, max(i) AS e FROM steps GROUP BY 1, 2)
SELECT e.document_id, chunk, f.line_no AS first_line, t.line_no AS last_line FROM ends e JOIN l f ON f.document_id = e.document_id AND f.i = e.b JOIN l t ON t.document_id = e.document_id AND t.i = e.e""")
def row_chunks(spark: SparkSession, d: str) -> DataFrame:
    lines = manifest_lines(spark, d)
    return L.chunks(lines, rows=2, most=5, overlap=2).select("document_id", "chunk", "first_line", "last_line")
