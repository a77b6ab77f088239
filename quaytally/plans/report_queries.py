"""Reports over items, documents, products and movements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.operators import joins as J
from quaytally.operators import reports as R
from quaytally.plans.registry import query
from quaytally.sources import canonical as C

SUMS = "sum(total_cartons)::DOUBLE AS total_cartons, sum(total_quantity)::DOUBLE AS total_quantity, sum(total_cbm)::DOUBLE AS total_cbm, sum(total_weight_kg)::DOUBLE AS total_weight_kg, sum(total_amount_rmb)::DOUBLE AS total_amount_rmb"
LABEL = "CASE WHEN total_quantity > 40 THEN 'ORDER ' || shop END"


def labelled(items: DataFrame) -> DataFrame:
    return items.withColumn("label", F.when(F.col("total_quantity") > 40, F.concat(F.lit("ORDER "), F.col("shop"))))


@query(f"""
, live AS (SELECT document_id, {SUMS.replace("AS total_amount_rmb", "AS computed_amount")} FROM items WHERE NOT deleted GROUP BY 1)
SELECT document_id, source_file_name, printed_amount::DOUBLE AS printed_amount, total_cartons, total_quantity, total_cbm, total_weight_kg, computed_amount,
  round(computed_amount - printed_amount::DOUBLE, 2) AS amount_diff, printed_amount IS NULL OR coalesce(computed_amount = printed_amount::DOUBLE, false) AS totals_match
FROM docs LEFT JOIN live USING (document_id)""")
def doc_totals_recon(spark: SparkSession, d: str) -> DataFrame:
    found = R.document_totals(C.items(spark, d), C.documents(spark, d))
    return found.select("document_id", "source_file_name", "printed_amount", "total_cartons", "total_quantity", "total_cbm", "total_weight_kg", "computed_amount", F.round(F.col("amount_diff").cast("double"), 2).alias("amount_diff"), "totals_match")


@query(f"""SELECT count(*) AS n_items, count(*) FILTER (section = 'shipped') AS n_shipped, count(*) FILTER (section = 'left_in_warehouse') AS n_left_in_warehouse,
  count(*) FILTER (section = 'repacked') AS n_repacked, count(*) FILTER (section = 'other') AS n_other, {SUMS} FROM items WHERE NOT deleted""")
def item_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.item_statistics(C.items(spark, d).where("not deleted"))


@query(r"""SELECT item_id, document_id, marks, description FROM items
WHERE NOT deleted AND (marks ILIKE '%-7%' OR description ILIKE '%-7%' OR item_code ILIKE '%-7%' OR shop ILIKE '%-7%')""")
def item_search(spark: SparkSession, d: str) -> DataFrame:
    return J.searched(C.items(spark, d).where("not deleted"), "-7", ("marks", "description", "item_code", "shop")).select("item_id", "document_id", "marks", "description")


@query("""SELECT item_id, source_file_name FROM items JOIN docs USING (document_id)
WHERE contains(lower(description), 'cust-12') OR contains(lower(marks), 'cust-12') OR contains(lower(source_file_name), 'cust-12')""")
def item_row_search(spark: SparkSession, d: str) -> DataFrame:
    rows = J.with_document(C.items(spark, d), C.documents(spark, d))
    return rows.where(J.row_matches(("description", "marks", "source_file_name"), "cust-12")).select("item_id", "source_file_name")


@query("""SELECT document_id, sum(CASE WHEN section <> 'left_in_warehouse' THEN total_cartons ELSE 0 END)::DOUBLE AS total_cartons, sum(CASE WHEN section <> 'left_in_warehouse' THEN total_cbm ELSE 0 END)::DOUBLE AS total_cbm,
  sum(CASE WHEN section <> 'left_in_warehouse' THEN total_weight_kg ELSE 0 END)::DOUBLE AS total_weight_kg, sum(total_quantity)::DOUBLE AS total_quantity, sum(total_amount_rmb)::DOUBLE AS total_amount_rmb FROM items GROUP BY 1""")
def physical_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.physical_totals(C.items(spark, d))


@query(f"""
, labelled AS (SELECT *, {LABEL} AS label FROM items),
named AS (SELECT *, max(CASE WHEN section = 'shipped' AND label IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id) AS named FROM labelled)
SELECT document_id, section, CASE section WHEN 'shipped' THEN 0 WHEN 'repacked' THEN 1 WHEN 'left_in_warehouse' THEN 2 ELSE 3 END AS section_rank,
  coalesce(label, CASE WHEN section = 'shipped' AND named = 1 THEN 'NEW ORDERS' END, upper(section)) AS title, count(*) AS n_items, min(line_no) AS first_line, {SUMS}
FROM named GROUP BY 1, 2, 3, 4""")
def section_groups(spark: SparkSession, d: str) -> DataFrame:
    return R.section_groups(labelled(C.items(spark, d)))


COMPILED = """
, named AS (SELECT *, section = 'repacked' AS is_repacked, lower(split_part(description, ' ', 1) || ' ' || split_part(description, ' ', 2)) || '||pack||' || packaging AS k FROM items WHERE NOT deleted),
groups AS (
  SELECT document_id, is_repacked, k, min_by({item_id: item_id, marks: marks, item_code: item_code, description: description, packaging: packaging}, item_id) AS f, min(item_id) AS place, count(*) AS variants,
    sum(total_cartons)::DOUBLE AS cartons, sum(total_quantity)::DOUBLE AS quantity, round(sum(total_cbm), 4)::DOUBLE AS cbm, round(sum(total_weight_kg), 1)::DOUBLE AS weight_kg, sum(total_amount_rmb)::DOUBLE AS amount_rmb
  FROM named GROUP BY 1, 2, 3)
SELECT document_id, is_repacked, row_number() OVER (PARTITION BY document_id ORDER BY is_repacked, place) AS row_no, f.item_id AS item_id, f.marks AS marks, f.item_code AS item_code, f.description AS base, f.packaging AS packaging,
  variants, cartons, quantity, cbm, weight_kg, amount_rmb FROM groups"""


@query(COMPILED)
def compiled_products(spark: SparkSession, d: str) -> DataFrame:
    return R.compiled_products(C.items(spark, d).where("not deleted"), ("document_id",))


@query(f"SELECT section, {SUMS} FROM items WHERE NOT deleted GROUP BY 1")
def metric_sums(spark: SparkSession, d: str) -> DataFrame:
    return R.sums(C.items(spark, d).where("not deleted"), "section")


@query("""
, t AS (SELECT document_id, sum(CASE WHEN section = 'left_in_warehouse' THEN 0 ELSE total_amount_rmb END) AS ca, sum(CASE WHEN section = 'left_in_warehouse' THEN total_amount_rmb ELSE 0 END) AS la,
  sum(CASE WHEN section = 'left_in_warehouse' THEN 0 ELSE total_cartons END) AS cc, sum(CASE WHEN section = 'left_in_warehouse' THEN total_cartons ELSE 0 END) AS lc, sum(total_amount_rmb) AS sa FROM items WHERE NOT deleted GROUP BY 1)
SELECT document_id, cc::DOUBLE AS compiled_cartons, lc::DOUBLE AS left_cartons, round(ca - printed_amount, 2)::DOUBLE AS footer_vs_compiled, round(ca + la - sa, 2)::DOUBLE AS combined_vs_stored FROM docs JOIN t USING (document_id)""")
def recon_deltas(spark: SparkSession, d: str) -> DataFrame:
    return R.reconciliation_deltas(C.items(spark, d), C.documents(spark, d))


@query("""SELECT document_id, section, sum(total_amount_rmb)::DOUBLE AS imported_amount, sum(CASE WHEN deleted THEN 0 ELSE total_amount_rmb END)::DOUBLE AS live_amount,
  sum(total_cartons)::DOUBLE AS imported_cartons, sum(CASE WHEN deleted THEN 0 ELSE total_cartons END)::DOUBLE AS live_cartons FROM items GROUP BY GROUPING SETS ((document_id, section), (document_id))""")
def imported_vs_live(spark: SparkSession, d: str) -> DataFrame:
    return R.imported_and_live(C.items(spark, d))


@query("""SELECT document_id, any_value(source_file_name) AS source_file_name, count(*) AS n_lines, sum(total_cartons)::DOUBLE AS cartons,
  count(*) FILTER (total_cartons = 0 AND total_quantity = 0) AS n_out_of_stock FROM docs JOIN items USING (document_id) WHERE NOT deleted GROUP BY 1""")
def doc_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return R.document_dashboard(C.items(spark, d), C.documents(spark, d))


@query(r"""
, f AS (SELECT document_id, regexp_extract(marks, '^([A-Za-z]+-\d+)', 1) AS family, count(*) AS n_lines, min(line_no) AS first_line FROM items GROUP BY 1, 2)
SELECT document_id, family, n_lines FROM f QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n_lines DESC, first_line) = 1""")
def container_code(spark: SparkSession, d: str) -> DataFrame:
    return R.container_code(C.items(spark, d))


@query("""SELECT n_products, stock_value, n_low_stock, (SELECT count(*) FROM movements WHERE created_at >= (SELECT max(created_at) FROM movements) - INTERVAL 7 DAY) AS n_movements_7d
FROM (SELECT count(*) AS n_products, sum(p_size * p_retailprice::DECIMAL(14,2))::DOUBLE AS stock_value, count(*) FILTER (p_size <= 10) AS n_low_stock FROM part)""")
def stock_dashboard(spark: SparkSession, d: str) -> DataFrame:
    products = C.table(spark, d, "part").select(F.col("p_size").alias("quantity"), F.col("p_retailprice").cast("decimal(14,2)").alias("cost"))
    return R.stock_dashboard(products, C.movements(spark, d), 10)


PAYMENTS = """
, payments AS (SELECT event_id AS payment_id, user_id AS document_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts::DATE END AS payment_date, value::DECIMAL(14,2) AS amount_usd,
  CASE event_type WHEN 'purchase' THEN 'freight' WHEN 'signup' THEN 'credit' WHEN 'click' THEN 'other' WHEN 'view' THEN 'deposit' ELSE 'balance' END AS payment_type, CASE event_id % 4 WHEN 0 THEN 'pivoc fee' WHEN 1 THEN ' ' WHEN 2 THEN 'misc' END AS note FROM events)"""


def payments(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for x in ("purchase", "freight", "signup", "credit", "click", "other", "view", "deposit", "error", "balance")))
    return C.table(spark, d, "events").select(
        F.col("event_id").alias("payment_id"),
        F.col("user_id").alias("document_id"),
        F.when(F.col("event_id") % 11 != 0, F.to_date("ts")).alias("payment_date"),
        F.col("value").cast("decimal(14,2)").alias("amount_usd"),
        F.try_element_at(kinds, F.col("event_type")).alias("payment_type"),
        F.when(F.col("event_id") % 4 == 0, "pivoc fee").when(F.col("event_id") % 4 == 1, " ").when(F.col("event_id") % 4 == 2, "misc").alias("note"),
    )


@query(f"""{PAYMENTS}
, last AS (SELECT document_id, payment_type, amount_usd FROM payments WHERE payment_type IN ('freight', 'credit', 'other')
  QUALIFY row_number() OVER (PARTITION BY document_id, payment_type ORDER BY payment_date IS NULL DESC, payment_date DESC, payment_id DESC) = 1),
first AS (SELECT document_id, payment_type, amount_usd FROM payments WHERE payment_type IN ('deposit', 'balance') AND payment_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY document_id, payment_type ORDER BY payment_date, payment_id) = 1),
a AS (SELECT * FROM last UNION ALL SELECT * FROM first)
SELECT document_id, max(amount_usd) FILTER (payment_type = 'freight')::DOUBLE AS freight, max(amount_usd) FILTER (payment_type = 'credit')::DOUBLE AS credit, max(amount_usd) FILTER (payment_type = 'other')::DOUBLE AS other,
  max(amount_usd) FILTER (payment_type = 'deposit')::DOUBLE AS deposit, max(amount_usd) FILTER (payment_type = 'balance')::DOUBLE AS balance FROM a GROUP BY 1""")
def payments_fold(spark: SparkSession, d: str) -> DataFrame:
    return R.payments_fold(payments(spark, d))


@query(f"""{PAYMENTS}
SELECT payment_id, document_id, CASE payment_type WHEN 'freight' THEN 'YIWU-MOMBASA FREIGHT' WHEN 'credit' THEN 'CREDIT SUPPORT TO MOMBASA' WHEN 'other' THEN CASE WHEN note LIKE '%pivoc%' THEN 'PIVOC' ELSE coalesce(nullif(trim(note), ''), 'Other') END
  ELSE coalesce(strftime(payment_date, '%d/%m/%Y') || ' PAYMENT', CASE payment_type WHEN 'balance' THEN 'BALANCE PAYMENT' ELSE 'PAYMENT' END) END AS label, '$' || format('{{:,.2f}}', amount_usd::DOUBLE) || ' USD' AS value, payment_type = 'balance' AS highlight FROM payments""")
def payment_labels(spark: SparkSession, d: str) -> DataFrame:
    return R.payment_rows(payments(spark, d)).select("payment_id", "document_id", "label", "value", "highlight")


@query("""SELECT p_partkey AS product_id, p_name AS name, s_name AS supplier_name FROM part LEFT JOIN supplier ON p_partkey % 120 = s_suppkey""")
def supplier_products(spark: SparkSession, d: str) -> DataFrame:
    products = C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 120).alias("supplier_id"))
    suppliers = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"))
    return J.with_dimension(products, suppliers, "supplier_id").select("product_id", "name", "supplier_name")


@query("""SELECT movement_id, product_id, movement_type, quantity::DOUBLE AS quantity, p_name AS name FROM movements LEFT JOIN part ON product_id = p_partkey ORDER BY created_at DESC, movement_id DESC LIMIT 500""")
def movements_latest(spark: SparkSession, d: str) -> DataFrame:
    """Names that begin with an accented letter, composed or not, stand where the plain letter does."""
    k = F.col("p_partkey") % 6
    accented = F.when(k == 0, "é").when(k == 3, "e\u0301").when(k == 1, "Å").when(k == 4, "a").otherwise("")
    names = C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    latest = C.movements(spark, d).orderBy(F.desc("created_at"), F.desc("movement_id")).limit(500)
    return latest.join(names, "product_id", "left").select("movement_id", "product_id", "movement_type", "quantity", "name")


@query("SELECT document_id, source_file_name FROM docs WHERE document_id IN (SELECT document_id FROM items WHERE NOT deleted)")
def docs_with_items(spark: SparkSession, d: str) -> DataFrame:
    return J.referenced(C.documents(spark, d), C.items(spark, d).where("not deleted"), "document_id").select("document_id", "source_file_name")


@query("SELECT document_id FROM docs WHERE document_id IN (SELECT document_id FROM items WHERE section = 'repacked') ORDER BY created_at DESC, document_id LIMIT 300")
def docs_referenced_latest(spark: SparkSession, d: str) -> DataFrame:
    found = J.referenced(C.documents(spark, d), C.items(spark, d).where("section = 'repacked'"), "document_id")
    return found.orderBy(F.desc("created_at"), "document_id").limit(300).select("document_id")


@query(f"""{PAYMENTS}
, t AS (SELECT document_id, sum(total_cartons)::DOUBLE AS total_cartons, CASE WHEN document_id % 2 = 0 THEN sum(total_amount_rmb)::DOUBLE END AS total_amount_rmb FROM items WHERE document_id % 3 <> 0 GROUP BY 1)
SELECT document_id, source_file_name, coalesce(total_cartons, CASE WHEN document_id % 5 <> 0 THEN (document_id % 50)::DOUBLE END) AS total_cartons, coalesce(total_amount_rmb, printed_amount::DOUBLE) AS total_amount_rmb, n_payments, paid_usd
FROM docs LEFT JOIN t USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n_payments, sum(amount_usd)::DOUBLE AS paid_usd FROM payments GROUP BY 1) USING (document_id)""")
def doc_bundle(spark: SparkSession, d: str) -> DataFrame:
    printed = F.struct(F.when(F.col("document_id") % 5 != 0, (F.col("document_id") % 50).cast("string")).otherwise("n/a").alias("total_cartons"), F.col("printed_amount").alias("total_amount_rmb"))
    docs = C.documents(spark, d).withColumn("raw", F.to_json(F.struct(printed.alias("footer_totals"))))
    even = F.col("document_id") % 2 == 0
    sums = C.items(spark, d).where("document_id % 3 <> 0").groupBy("document_id").agg(F.sum("total_cartons").alias("total_cartons"), F.sum("total_cbm").alias("total_cbm"), F.sum("total_weight_kg").alias("total_weight_kg"), F.sum("total_amount_rmb").alias("amount"))
    totals = sums.withColumn("total_amount_rmb", F.when(even, F.col("amount"))).drop("amount")
    return R.document_bundle(docs, totals, payments(spark, d)).select("document_id", "source_file_name", "total_cartons", "total_amount_rmb", "n_payments", "paid_usd")


@query("""SELECT p_partkey AS product_id, p_name AS name, NULL::BIGINT AS document_id, '2024-01-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') AS created_at FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT product_id, description, document_id, strftime(created_at, '%Y-%m-%d') FROM items JOIN docs USING (document_id)""")
def all_products(spark: SparkSession, d: str) -> DataFrame:
    """Products entered by hand, and those of documents."""
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("p_partkey") % 28).cast("string"), 2, "0"))
    manual = C.table(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), day.alias("created_at"))
    linked = J.with_document(C.items(spark, d), C.documents(spark, d), "inner").select("product_id", F.col("description").alias("name"), "document_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))
    return R.merged_products(manual, linked).select("product_id", "name", "document_id", "created_at")


@query("""SELECT item_id, document_id, source_file_name, description AS name, total_weight_kg::DOUBLE::VARCHAR || 'KGS' AS weight_text FROM items LEFT JOIN docs USING (document_id)""")
def item_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = J.with_document(C.items(spark, d), C.documents(spark, d))
    return rows.select("item_id", "document_id", "source_file_name", F.coalesce("description", "marks").alias("name"), F.concat(F.col("total_weight_kg").cast("double").cast("string"), F.lit("KGS")).alias("weight_text"))


@query("""SELECT item_id, line_no, document_id FROM items JOIN docs USING (document_id) ORDER BY created_at DESC, document_id, line_no, item_id LIMIT 150 OFFSET 300""")
def item_page(spark: SparkSession, d: str) -> DataFrame:
    rows = J.with_document(C.items(spark, d), C.documents(spark, d), "inner")
    return J.page(J.reading_order(rows), 3, 150).select("item_id", "line_no", "document_id")


@query("""SELECT document_id, source_file_name, created_at::VARCHAR AS created_at FROM docs QUALIFY row_number() OVER (PARTITION BY lower(trim(source_file_name)) ORDER BY created_at DESC, document_id DESC) = 1""")
def latest_per_file(spark: SparkSession, d: str) -> DataFrame:
    return J.latest_per_file(C.documents(spark, d)).select("document_id", "source_file_name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("""SELECT l_orderkey AS document_id, count(*) AS n_items, sum(l_quantity)::DOUBLE AS total_quantity FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1""")
def selected_totals(spark: SparkSession, d: str) -> DataFrame:
    chosen = C.documents(spark, d).where("document_id % 3 = 0").select("document_id")
    return C.items(spark, d).join(chosen, "document_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("total_quantity").alias("total_quantity"))


@query("""SELECT item_id, section FROM items WHERE coalesce(section, 'shipped') NOT IN ('left_in_warehouse', 'repacked')""")
def publishable_items(spark: SparkSession, d: str) -> DataFrame:
    return J.publishable(C.items(spark, d)).select("item_id", "section")


@query("""SELECT product_id, name, stock_status FROM (SELECT p_partkey AS product_id, p_name AS name, CASE WHEN p_size <= 0 THEN 'out' WHEN p_size <= 12 THEN 'low' ELSE 'ok' END AS stock_status FROM part) WHERE stock_status <> 'ok'""")
def stock_status(spark: SparkSession, d: str) -> DataFrame:
    products = C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), T.stock_status(F.col("p_size"), F.lit(12)).alias("stock_status"))
    return products.where("stock_status <> 'ok'")


@query("""SELECT section, total_cartons::DOUBLE AS total_cartons, row_kind FROM (
  SELECT section, sum(total_cartons) AS total_cartons, 'section' AS row_kind FROM items GROUP BY 1 UNION ALL SELECT 'TOTALS', sum(total_cartons), 'totals' FROM items)""")
def report_with_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = C.items(spark, d).groupBy("section").agg(F.sum("total_cartons").alias("total_cartons")).withColumn("row_kind", F.lit("section"))
    return J.with_totals_row(rows, "section", ("total_cartons",), "row_kind")


@query("""SELECT p_partkey AS product_id, dense_rank() OVER (ORDER BY lower(CASE WHEN p_partkey % 3 = 0 THEN 'e' || p_name WHEN p_partkey % 3 = 1 THEN 'a' || p_name ELSE p_name END)) AS name_rank FROM part""")
def name_order(spark: SparkSession, d: str) -> DataFrame:
    """Names that begin with an accented letter, composed or not, stand where the plain letter does."""
    k = F.col("p_partkey") % 6
    accented = F.when(k == 0, "é").when(k == 3, "e\u0301").when(k == 1, "Å").when(k == 4, "a").otherwise("")
    names = C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.collate(F.concat(accented, F.col("p_name")), "UNICODE_CI_AI").alias("name"))
    return names.join(J.name_ranks(names.select("name").distinct(), "name"), "name").select("product_id", "name_rank")


@query("""SELECT supplier_id, name FROM (SELECT s_suppkey AS supplier_id, s_name AS name FROM supplier) WHERE contains(lower(name), '12')""")
def supplier_search(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name")).where(F.lower("name").contains("12"))


@query("""SELECT document_id, imports_7d FROM (SELECT document_id, count(*) OVER (ORDER BY created_at::DATE RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS imports_7d FROM docs)""")
def imports_in_week(spark: SparkSession, d: str) -> DataFrame:
    # documents are counted by day first, so that the window runs over days
    docs = C.documents(spark, d).withColumn("day", F.to_date("created_at"))
    days = docs.groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("day_no", F.datediff("day", F.lit("1970-01-01")))
    recent = days.withColumn("imports_7d", F.sum("n").over(Window.orderBy("day_no").rangeBetween(-6, 0)))
    return docs.join(recent.select("day", "imports_7d"), "day").select("document_id", "imports_7d")
