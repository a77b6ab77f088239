"""Rows as parsers leave them: moved columns, totals among the rows, sales rows without a header, and facts of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.operators import shifts as S
from quaytally.plans.parse_queries import whole
from quaytally.plans.registry import query
from quaytally.sources import canonical as C
from quaytally.sources import lines as L
from quaytally.sources import sales as X

# By kind of row: (packaging, what the description ends with, numbers from pieces a carton to total weight), and what becomes of them.
NUMBERS = S.ROW_FIELDS[6:]
MOVED = (
    ("3CTNS", " 40pcs/ctn", (None, 120, 50, 600, 5, 0.5, 40, 30, 0.3, 12, 14, 12.5)),
    ("2CTNS", " FOOD WARMER PARTS 30pcs/ctn", (None, 10, 66, None, None, 0.2, None, None, 0.4, 8, 15, None)),
    ("4CTNS", "", (None, 96, 45, 2000, None, 0.02, 30, 20, 0.1, 9, 11, 20.8)),
    ("5CTNS", "", (None, 60, 33, None, None, 0.03, 40, 22, 0.2, 7, 12, 6.5)),
    ("3CTNS", " 20pcs/ctn", (None, 60, 60, 2, 120, 30, 20, 10, 0.01, 0.03, 5, 15)),
    (None, "", (None, None, None, 2.5, 60, None, None, 24, None, None, None, None)),
    ("20pcs/ctn", "", (20, 3, 60, 2, 120, 30, 20, 10, 0.01, 0.03, 5, 15)),
)
REPAIRED = (
    ("40pcs/ctn", "", "repair:shifted_manifest_columns", (40, 3, 120, 12.5, 600, 40, 30, 50, 0.5, 0.3, 12, 14)),
    ("30pcs/ctn", " FOOD WARMER PARTS", "repair:shifted_manifest_parts_row", (None, 2, 60, None, None, 0.2, None, None, 0.2, 0.4, 8, 15)),
    ("24pcs/ctn", "", "repair:shifted_manifest_carton_only_row", (24, 4, 96, 20.8, 2000, 30, 20, 45, 0.02, 0.1, 9, 11)),
    ("5CTNS", "", "repair:ctn_packed_shifted_row", (None, 5, 60, 6.5, None, 40, 22, 33, 0.03, 0.2, 7, 12)),
    ("3CTNS", " 20pcs/ctn", "repair:cartons_from_pack_when_qty_correct", (None, 3, 60, 2, 120, 30, 20, 10, 0.01, 0.03, 5, 15)),
    (None, "", "repair:sparse_qty_in_dim", (None, None, 24, 2.5, 60, None, None, None, None, None, None, None)),
    ("20pcs/ctn", "", None, (20, 3, 60, 2, 120, 30, 20, 10, 0.01, 0.03, 5, 15)),
)


def sql_text(v: str | None) -> str:
    return "NULL" if v is None else f"'{v}'"


def sql_list(values: tuple, kind: str) -> str:
    return f"[{', '.join('NULL' if v is None else str(v) for v in values)}]::{kind}[]"


def pick(k: Column, values: tuple, kind: str = "double") -> Column:
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), k.cast("int"))


@query(f"""SELECT item_id, ([{", ".join(sql_text(p) for p, _, _, _ in REPAIRED)}])[line_no % 7 + 1] AS packaging, description || (['{"', '".join(e for _, e, _, _ in REPAIRED)}'])[line_no % 7 + 1] AS description,
  ([{", ".join(sql_text(t) for _, _, t, _ in REPAIRED)}])[line_no % 7 + 1] AS remarks, {", ".join(f"({sql_list(tuple(n[i] for _, _, _, n in REPAIRED), 'DOUBLE')})[line_no % 7 + 1] AS {c}" for i, c in enumerate(NUMBERS))} FROM items""")
def moved_columns(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("line_no") % 7
    numbers = [pick(k, tuple(n[i] for _, _, n in MOVED)).alias(c) for i, c in enumerate(NUMBERS)]
    rows = C.items(spark, d).select("item_id", "marks", "item_code", "section", pick(k, tuple(p for p, _, _ in MOVED), "string").alias("packaging"), F.concat("description", pick(k, tuple(e for _, e, _ in MOVED), "string")).alias("description"), F.lit(None).cast("string").alias("remarks"), *numbers)
    return S.parsed_rows_repaired(rows).drop("marks", "item_code", "section")


@query("""
, r AS (SELECT document_id, item_id, line_no * 10 AS line_no, marks, item_code, section, total_amount_rmb::DOUBLE AS amount, CASE WHEN product_id % 2 = 0 THEN remarks END AS remarks FROM items
  UNION ALL SELECT document_id, -item_id, line_no * 10 - 5, marks, item_code, 'shipped', total_amount_rmb::DOUBLE + CASE WHEN product_id % 3 = 0 THEN 0.02 ELSE 0 END, NULL FROM items WHERE section = 'left_in_warehouse' AND line_no % 2 = 0),
g AS (SELECT *, section = 'left_in_warehouse' AND amount > 0 AND (remarks IS NOT NULL OR EXISTS (SELECT 1 FROM r p WHERE p.document_id = r.document_id AND p.marks = r.marks AND p.item_code = r.item_code AND p.section = 'shipped' AND p.line_no < r.line_no AND abs(p.amount - r.amount) < 0.0095)) AS gone FROM r)
SELECT item_id, CASE WHEN NOT gone THEN amount END AS total_amount_rmb, CASE WHEN gone THEN coalesce(remarks || ';', '') || 'repair:before_goods_amount_carryover_ignored' ELSE remarks END AS remarks FROM g""")
def carryover_amounts(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d).select("document_id", "item_id", (F.col("line_no") * 10).alias("line_no"), "marks", "item_code", "section", F.col("total_amount_rmb").cast("double").alias("total_amount_rmb"), F.when(F.col("product_id") % 2 == 0, F.col("remarks")).alias("remarks"), "product_id")
    more = F.when(F.col("product_id") % 3 == 0, 0.02).otherwise(0.0)
    copies = items.where("section = 'left_in_warehouse' and line_no % 20 = 0").withColumns({"item_id": -F.col("item_id"), "line_no": F.col("line_no") - 5, "section": F.lit("shipped"), "total_amount_rmb": F.col("total_amount_rmb") + more, "remarks": F.lit(None).cast("string")})
    return S.carryover_amounts_dropped(items.unionByName(copies), F.col("section") == "left_in_warehouse").select("item_id", "total_amount_rmb", "remarks")


@query("""SELECT item_id, item_id % 8 IN (0, 1) AS subtotal_line, item_id % 8 IN (2, 3) AS subtotal_fields, item_id % 8 = 4 AS totals_blob, item_id % 8 = 5 AS banner_noise, item_id % 8 = 6 AS anonymous_parts, item_id % 8 = 7 AND line_no % 2 = 0 AS stuffed_banner, line_no % 3 <> 2 AS divider FROM items""")
def parser_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a parsed table that are no products, each told by its own rule."""
    k, n = F.col("item_id") % 8, F.col("line_no")
    other = lambda at, value: F.when(k == at, value).otherwise(F.col("description"))
    cells = F.when(k == 0, F.array(F.lit("Sub  total"), n.cast("string"))).when(k == 1, F.array(F.concat(n, F.lit("CTNS")), F.lit(" 85.3CBM"), F.lit("¥ 1,200"))).otherwise(F.array(F.col("description"), F.concat(n, F.lit("pcs/ctn 5CTNS 6CBM 7KGS"))))
    bare = (k == 2) | (k == 3)
    blob = F.when(k == 4, F.concat(F.lit("12CTNS 4.5CBM "), n, F.lit("KGS"))).otherwise(F.col("description"))
    new_order = F.when(k == 5, " new order ")
    unnamed = lambda c: F.when(k != 6, F.col(c))
    sku = F.when(n % 3 == 0, "__SECTION_REPACKAGED__").when(n % 3 == 1, F.concat(F.lit("__SECTION_STAGE_TOTAL__:"), n)).otherwise(F.col("item_code"))
    banner = F.when(k == 7, "37-T-1 18 CTN GOODS STUFFED INTO THIS CONTAINER").otherwise(F.col("description"))
    return C.items(spark, d).select(
        "item_id",
        T.subtotal_line(cells).alias("subtotal_line"),
        T.subtotal_fields(F.when(~bare, F.col("description")), F.when(~bare, F.col("item_code")), F.when(k == 2, 40).otherwise(1), F.when(k == 3, 200).otherwise(1), F.when(bare, 10_000).otherwise(1)).alias("subtotal_fields"),
        T.totals_blob(F.col("marks"), blob).alias("totals_blob"),
        T.banner_noise(*([new_order] * 4)).alias("banner_noise"),
        T.anonymous_parts(unnamed("marks"), unnamed("item_code"), unnamed("shop"), other(6, F.lit("food  warmer parts"))).alias("anonymous_parts"),
        T.stuffed_banner(banner, F.lit(0.0), F.when(n % 2 == 1, 3.0)).alias("stuffed_banner"),
        T.section_divider(sku).alias("divider"),
    )


@query("""SELECT item_id, item_code, '26C707-' || line_no AS delivery_no, 'CG' || product_id % 9 AS customer_item_ref, description, total_cartons::DOUBLE AS total_cartons, (total_cartons * qty_per_carton)::DOUBLE AS total_quantity, unit_price_rmb::DOUBLE AS unit_price_rmb, total_amount_rmb::DOUBLE AS total_amount_rmb,
  30.0::DOUBLE AS dim_l_cm, 20.0::DOUBLE AS dim_w_cm, 10.0::DOUBLE AS dim_h_cm, 0.25::DOUBLE AS unit_cbm, 12.5::DOUBLE AS unit_weight_kg, CASE WHEN line_no % 6 = 2 THEN 2.5 ELSE total_cartons * 0.25 END::DOUBLE AS total_cbm, (total_cartons * 12.5)::DOUBLE AS total_weight_kg,
  CASE WHEN line_no % 6 NOT IN (1, 2) THEN '6901234567890' END AS barcode, '浦江仓' AS warehouse, 'PCS' AS unit, 'steel' AS material FROM items""")
def positional_sales_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of 23 or 24 cells: with and without a barcode, without total weight, and with neighbours in one cell."""
    k, n = F.col("line_no") % 6, F.col("line_no")
    cartons = F.col("total_cartons").cast("long")
    pieces = (F.col("total_cartons") * F.col("qty_per_carton")).cast("long")
    text = lambda *parts: F.array(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    volume = F.when(k == 2, F.lit("2.5")).otherwise((cartons * 0.25).cast("string"))
    printed = F.when(n % 5 == 0, cartons * 10).otherwise(cartons)
    head = text(n, F.concat(F.lit("26C707-"), n), F.concat(F.lit("CG"), F.col("product_id") % 9), F.col("item_code"), "", F.col("description"), printed, whole("qty_per_carton"), pieces, F.col("unit_price_rmb"), F.format_number("total_amount_rmb", 2))
    sizes = F.when(k == 3, text("30", "20 10")).when(k == 4, text("30 20", "10")).otherwise(text("30", "20", "10"))
    weights = F.when(k == 5, F.concat(text("0.25", ""), F.array(F.concat(F.lit("12.5 "), volume)))).otherwise(F.concat(text("0.25", "12.5"), F.array(volume)))
    total = F.when(k == 2, F.array().cast("array<string>")).otherwise(text((cartons * 12.5).cast("decimal(18,1)")))
    end = F.concat(text(F.when(k.isin(1, 2), "").otherwise("6901234567890"), "", " 浦江仓"), text("PCS", "杯", "steel"))
    rows = C.items(spark, d).select("item_id", F.concat(head, sizes, weights, total, end).alias("cells"))
    return X.positional_rows(rows).drop("remarks", "product_name_local", "qty_per_carton")


TAILS = """
, r AS (SELECT item_id, line_no % 6 AS k, description, (total_cartons + 1)::DOUBLE AS c FROM items)"""


@query(f"""{TAILS}
SELECT item_id, description || CASE WHEN k = 4 THEN ' 浦江仓 PCS' ELSE '' END AS description, CASE WHEN k IN (0, 3, 4) THEN c END AS total_cartons, CASE WHEN k NOT IN (2, 5) THEN 40 END::DOUBLE AS qty_per_carton, CASE WHEN k = 5 THEN 7 ELSE c * 40 END::DOUBLE AS total_quantity,
  CASE WHEN k = 5 THEN 3 WHEN k IN (3, 4) THEN 2 ELSE 700 END::DOUBLE AS unit_price_rmb, CASE WHEN k = 5 THEN 21 WHEN k IN (3, 4) THEN c * 80 ELSE c * 28000 END::DOUBLE AS total_amount_rmb, CASE WHEN k = 5 THEN NULL ELSE c * 12.5 END::DOUBLE AS total_weight_kg,
  CASE WHEN k NOT IN (2, 5) THEN '40pcs' END AS packaging, CASE k WHEN 4 THEN '浦江仓 PCS' WHEN 5 THEN 'A' ELSE '东阳 仓' END AS warehouse, CASE k WHEN 4 THEN 'repair:continuation_sales_metrics' WHEN 5 THEN NULL ELSE 'repair:collapsed_sales_metrics' END AS remarks FROM r""")
def metrics_in_description(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that went into the description: all twelve, without cartons, without pieces a carton, with amount and price exchanged, behind the warehouse; and a sound row."""
    k, c = F.col("line_no") % 6, F.col("total_cartons").cast("long") + 1
    price, amount = F.when(k.isin(3, 4), F.lit(2)).otherwise(700), F.when(k.isin(3, 4), c * 80).otherwise(c * 28000)
    pair = F.when(k.isin(3, 4), F.concat_ws(" ", amount.cast("string"), price.cast("string"))).otherwise(F.concat_ws(" ", price.cast("string"), amount.cast("string")))
    count = F.when(k == 1, F.lit("40")).when(k != 2, F.concat_ws(" ", c.cast("string"), F.lit("40")))
    numbers = F.concat_ws(" ", count, (c * 40).cast("string"), pair, F.lit("30 20 10 0.25 12.5"), (c * 0.25).cast("string"), (c * 12.5).cast("decimal(18,1)").cast("string"))
    text = F.when(k == 5, F.col("description")).when(k == 4, F.concat_ws(" ", "description", F.lit("浦江仓 PCS"), numbers)).otherwise(F.concat_ws(" ", "description", numbers, F.lit("东阳 仓")))
    fine = {"total_cartons": None, "total_quantity": 7.0, "unit_price_rmb": 3.0, "total_amount_rmb": 21.0, "qty_per_carton": None}
    values = {c_: F.when(k == 5, F.lit(fine.get(c_))).cast("double") for c_ in L.TAIL}
    rows = C.items(spark, d).select("item_id", text.alias("description"), *(v.alias(c_) for c_, v in values.items()), F.lit(None).cast("string").alias("packaging"), F.when(k == 5, "A").alias("warehouse"), F.lit(None).cast("string").alias("remarks"))
    found = X.continuation_metrics(X.collapsed_metrics(rows))
    return found.select("item_id", "description", "total_cartons", "qty_per_carton", "total_quantity", "unit_price_rmb", "total_amount_rmb", "total_weight_kg", "packaging", "warehouse", "remarks")


@query(f"""{TAILS}
SELECT r.item_id, '26C707-6083' AS marks, 'PX' || product_id AS item_code, r.description || ' 12.7cm' AS description, c AS total_cartons, c * 40 AS total_quantity, c * 28000 AS total_amount_rmb, 'full_extract:flattened_sales_order_row;repair:collapsed_sales_metrics' AS remarks FROM r JOIN items USING (item_id)""")
def flattened_sales_rows(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("total_cartons").cast("long") + 1
    parts = [F.col("line_no"), F.lit("26C707 - 6083"), F.concat(F.lit("PX"), F.col("product_id")), F.col("description"), F.lit(" 12.7cm"), c, F.lit(40), c * 40, F.lit(700), c * 28000, F.lit("30 20 10 0.25 12.5"), c * 0.25, (c * 12.5).cast("decimal(18,1)"), F.lit("6901234567 浦江")]
    rows = C.items(spark, d).select("item_id", F.concat_ws(" ", *(p.cast("string") for p in parts)).alias("text"))
    return X.flattened_rows(rows).select("item_id", "marks", "item_code", "description", "total_cartons", "total_quantity", "total_amount_rmb", "remarks")


@query("""SELECT document_id, CASE WHEN document_id % 3 <> 2 THEN 'ABCD' || (1000000 + document_id) END AS container_no, CASE document_id % 3 WHEN 0 THEN 'MS-' || client_id || ' trading' WHEN 1 THEN 'C' || client_id ELSE 'C707-' || client_id END AS client_id,
  CASE document_id % 3 WHEN 0 THEN 'T-' || document_id WHEN 2 THEN 'C25-' || document_id END AS doc_number, CASE document_id % 3 WHEN 0 THEN strftime(created_at, '%Y-%m-%d') WHEN 2 THEN strftime(created_at, '%Y-%m-%d') END AS document_date,
  (5 + document_id % 7)::DOUBLE AS total_cartons, CASE WHEN document_id % 3 = 2 THEN 87.57 ELSE 70.1 END::DOUBLE AS total_cbm, CASE WHEN document_id % 3 = 2 THEN 21772.49 ELSE 23183 END::DOUBLE AS total_weight_kg, (100000 + document_id)::DOUBLE AS total_amount_rmb,
  CASE WHEN document_id % 3 = 0 THEN 48123 END::DOUBLE AS total_amount_usd, CASE WHEN document_id % 3 = 0 THEN 6.8 END::DOUBLE AS exchange_rate, CASE WHEN document_id % 3 = 0 THEN 5200 END::DOUBLE AS freight_usd, CASE WHEN document_id % 3 = 0 THEN 44836.5 END::DOUBLE AS total_balance_usd FROM docs""")
def doc_facts(spark: SparkSession, d: str) -> DataFrame:
    """Header and footer facts in three layouts: labelled, as one line of totals, and as a sales order."""
    k, n = F.col("document_id") % 3, F.col("document_id")
    day, cartons, amount = F.date_format("created_at", "yyyy-MM-dd"), 5 + n % 7, F.lit(100_000) + n
    money = F.format_number(amount, 0)
    container = F.concat(F.lit("ABCD"), F.lit(1_000_000) + n)
    labelled = F.concat(F.lit("CLIENT DETAILS: MS-"), F.col("client_id"), F.lit(" trading CONTAINER NO.: "), container, F.lit("\nMANIFEST NO: T-"), n, F.lit(" DATE: "), F.replace(day, F.lit("-"), F.lit("/")), F.lit("\nTOTAL CARTON: "), cartons, F.lit(" CTNS\nTOTAL CBM 70.1CBM TOTAL WEIGHT 23,183KGS\nTOTAL COST RMB "), money, F.lit("\nTOTAL COST IN USD $48,123\nYIWU-MOMBASA FREIGHT USD 5,200\nTOTAL BALANCE USD 44,836.5\nEXCHANGE RATE: 6.80"))
    one_line = F.concat(F.lit("CLIENT NO. C"), F.col("client_id"), F.lit(", CONT # "), container, F.lit("\nTOTAL "), cartons, F.lit("CTNS 70.1CBM 23183KGS ¥"), money)
    sales = F.concat(F.lit("客户：C707-"), F.col("client_id"), F.lit(" NO: C25-"), n, F.lit("\n销售日期："), day, F.lit("\nTOTAL: "), cartons, F.lit(" 36839 "), amount, F.lit(" 87.57 21,772.49\nPCS Amount"))
    body = F.when(k == 0, labelled).when(k == 1, one_line).otherwise(sales)
    return L.document_facts(C.documents(spark, d).select("document_id", body.alias("text")), "text")


@query("""SELECT document_id, n, CASE WHEN document_id % 2 = 1 OR n < 2 THEN strftime(created_at + INTERVAL 10 YEAR, '%Y-%m-%d') END AS payment_date, CASE WHEN document_id % 2 = 1 THEN 700 + document_id % 50 ELSE [10000, 33555.5, 5200, 12][n + 1] END::DOUBLE AS amount_usd,
  CASE WHEN document_id % 2 = 1 THEN 'deposit' ELSE ['deposit', 'balance', 'freight'][n + 1] END AS payment_type FROM docs, range(3) r(n) WHERE document_id % 2 = 0 OR n = 0""")
def doc_payments(spark: SparkSession, d: str) -> DataFrame:
    # dates before 2000 are no dates of payments
    day, n = F.date_format(F.col("created_at") + F.expr("interval 10 years"), "dd/MM/yyyy"), F.col("document_id")
    lines = F.concat(day, F.lit(" PAYMENT PAID IN CHINA USD 10,000\nsecond payment "), day, F.lit(" $ 33,555.50\nPAYMENT FOR FREIGHT 45/13/2026 USD: 5,200\nPAYMENT terms apply\nUSD 12"))
    split = F.concat(day, F.lit(" \nPAYMENT\n of goods $"), 700 + n % 50)
    body = F.when(n % 2 == 0, lines).otherwise(split)
    return L.document_payments(C.documents(spark, d).select("document_id", body.alias("text")), "text").select("document_id", F.col("n").cast("long").alias("n"), "payment_date", "amount_usd", "payment_type")


@query("""SELECT document_id, CASE document_id % 3 WHEN 0 THEN 'MS-' || document_id % 1000 WHEN 1 THEN 'T-' || client_id % 1000 END AS document_number, CASE document_id % 3 WHEN 0 THEN 'Client' WHEN 1 THEN 'acme' END AS client FROM docs""")
def document_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("document_id") % 3
    details = F.when(k == 0, F.concat(F.lit(" .Client no. MS-"), F.col("document_id") % 1000, F.lit(" X-9"))).when(k == 1, " acme").otherwise(" ")
    name = F.when(k == 1, F.concat(F.lit("/in/T-"), F.col("client_id") % 1000, F.lit(".pdf"))).when(k == 0, "Z-1.pdf").otherwise("plain.pdf")
    return C.documents(spark, d).select("document_id", T.document_number(details, name).alias("document_number"), T.client_id(details).alias("client"))
