"""Row rules: flags, caps, repairs, parsing of numbers, packings, sections and kinds of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaytally.functions import numbers as N
from quaytally.functions import text as T
from quaytally.operators import joins as J
from quaytally.operators import rules as U
from quaytally.plans.registry import query
from quaytally.sources import canonical as C

#: Items with the faults that the rules look for.
ROUGH_SQL = """
, rough AS (
  SELECT item_id, document_id, line_no, section, remarks, shop, product_id,
    CASE WHEN product_id % 13 = 0 AND line_no % 2 = 0 THEN NULL ELSE marks END AS marks, CASE WHEN product_id % 13 = 0 THEN NULL ELSE item_code END AS item_code,
    CASE WHEN product_id % 17 = 0 THEN NULL ELSE description END AS description, CASE WHEN product_id % 7 = 0 THEN 'CTN' WHEN product_id % 11 = 0 THEN NULL ELSE packaging END AS packaging,
    qty_per_carton::DOUBLE AS qty_per_carton,
    CASE WHEN product_id % 23 = 0 THEN total_cartons::DOUBLE * 100000 WHEN line_no % 9 = 0 THEN 0 ELSE total_cartons::DOUBLE END AS total_cartons,
    CASE WHEN product_id % 19 = 0 THEN total_quantity::DOUBLE * 100000 WHEN line_no % 8 = 0 THEN 0 ELSE total_quantity::DOUBLE END AS total_quantity,
    CASE WHEN line_no % 5 = 0 THEN 0 WHEN line_no % 6 = 0 THEN NULL ELSE unit_price_rmb::DOUBLE END AS unit_price_rmb,
    CASE WHEN line_no % 4 = 0 THEN total_amount_rmb::DOUBLE * 1.5 WHEN line_no % 7 = 0 THEN NULL WHEN line_no % 11 = 0 THEN total_weight_kg::DOUBLE ELSE total_amount_rmb::DOUBLE END AS total_amount_rmb,
    CASE WHEN line_no % 3 = 0 THEN NULL ELSE total_cbm::DOUBLE END AS total_cbm, total_weight_kg::DOUBLE AS total_weight_kg
  FROM items)"""


def rough(spark: SparkSession, d: str) -> DataFrame:
    product, line = F.col("product_id"), F.col("line_no")
    value = lambda c: F.col(c).cast("double")
    return C.items(spark, d).select(
        "item_id", "document_id", "line_no", "section", "remarks", "shop", "product_id",
        F.when(~((product % 13 == 0) & (line % 2 == 0)), F.col("marks")).alias("marks"),
        F.when(product % 13 != 0, F.col("item_code")).alias("item_code"),
        F.when(product % 17 != 0, F.col("description")).alias("description"),
        F.when(product % 7 == 0, "CTN").when(product % 11 != 0, F.col("packaging")).alias("packaging"),
        value("qty_per_carton").alias("qty_per_carton"),
        F.when(product % 23 == 0, value("total_cartons") * 100000).when(line % 9 == 0, 0.0).otherwise(value("total_cartons")).alias("total_cartons"),
        F.when(product % 19 == 0, value("total_quantity") * 100000).when(line % 8 == 0, 0.0).otherwise(value("total_quantity")).alias("total_quantity"),
        F.when(line % 5 == 0, 0.0).when(line % 6 != 0, value("unit_price_rmb")).alias("unit_price_rmb"),
        F.when(line % 4 == 0, value("total_amount_rmb") * 1.5).when(line % 7 == 0, F.lit(None)).when(line % 11 == 0, value("total_weight_kg")).otherwise(value("total_amount_rmb")).alias("total_amount_rmb"),
        F.when(line % 3 != 0, value("total_cbm")).alias("total_cbm"),
        value("total_weight_kg").alias("total_weight_kg"),
    )


FLAGS_A = """concat_ws(';', CASE WHEN coalesce(description, '') = '' THEN 'missing description' END, CASE WHEN coalesce(item_code, '') = '' AND coalesce(marks, '') = '' THEN 'missing item code' END,
  CASE WHEN unit_price_rmb < 0 THEN 'negative unit price' END, CASE WHEN total_amount_rmb < 0 THEN 'negative total amount' END, CASE WHEN total_cbm < 0 THEN 'negative CBM' END, CASE WHEN total_weight_kg < 0 THEN 'negative weight' END,
  CASE WHEN total_quantity > 0 AND unit_price_rmb > 0 AND abs(total_quantity * unit_price_rmb - total_amount_rmb) / (total_quantity * unit_price_rmb) > 0.05 THEN 'amount cross-check failed' END)"""
FLAGGED_A = f"""{ROUGH_SQL}, flagged AS (SELECT *, {FLAGS_A} AS flags FROM rough),
counted AS (SELECT *, CASE WHEN flags = '' THEN 0 ELSE length(flags) - length(replace(flags, ';', '')) + 1 END AS n FROM flagged),
scored AS (SELECT *, greatest(0, 100 - n * 15 - CASE WHEN coalesce(description, '') = '' THEN 20 ELSE 0 END - CASE WHEN coalesce(item_code, '') = '' AND coalesce(marks, '') = '' THEN 20 ELSE 0 END
  - CASE WHEN total_cbm IS NULL THEN 10 ELSE 0 END - CASE WHEN unit_price_rmb IS NULL THEN 10 ELSE 0 END) AS confidence FROM counted)"""


@query(f"{FLAGGED_A} SELECT item_id, flags, confidence, confidence < 80 OR n > 0 AS needs_review FROM scored")
def row_flags_a(spark: SparkSession, d: str) -> DataFrame:
    return U.row_flags(rough(spark, d)).select("item_id", F.concat_ws(";", "flags").alias("flags"), "confidence", "needs_review")


@query(f"{FLAGGED_A} SELECT document_id, greatest(0, floor(avg(confidence) - CASE WHEN max(n) > 0 THEN 10 ELSE 0 END + 0.5))::BIGINT AS confidence FROM scored GROUP BY 1")
def doc_confidence(spark: SparkSession, d: str) -> DataFrame:
    per = U.row_flags(rough(spark, d)).groupBy("document_id").agg(F.avg("confidence").alias("mean"), F.max(F.size("flags")).alias("most"))
    return per.select("document_id", F.greatest(F.lit(0), N.half_up(F.col("mean") - F.when(F.col("most") > 0, 10).otherwise(0))).cast("long").alias("confidence"))


FLAGS_B = """concat_ws(';', CASE WHEN coalesce(description, '') = '' THEN 'missing_name' END, CASE WHEN coalesce(packaging, '') = '' THEN 'missing_packing' END,
  CASE WHEN coalesce(total_quantity, 0) > 0 AND coalesce(total_cartons, 0) <= 0 THEN 'qty_without_cartons' END, CASE WHEN coalesce(total_cartons, 0) > 0 AND coalesce(total_quantity, 0) <= 0 THEN 'cartons_without_qty' END,
  CASE WHEN coalesce(unit_price_rmb, 0) <= 0 AND coalesce(total_amount_rmb, 0) > 0 THEN 'price_missing_but_amount_present' END, CASE WHEN coalesce(total_quantity, 0) = 0 AND coalesce(total_cartons, 0) = 0 THEN 'zero_qty_and_zero_cartons' END,
  CASE WHEN total_quantity > 0 AND unit_price_rmb > 0 AND total_amount_rmb > 0 AND abs(total_quantity * unit_price_rmb - total_amount_rmb) > greatest(5, total_quantity * unit_price_rmb * 0.02) THEN 'amount_mismatch' END)"""
FLAGGED_B = f"{ROUGH_SQL}, flagged AS (SELECT *, {FLAGS_B} AS flags FROM rough)"


@query(f"{FLAGGED_B} SELECT item_id, flags FROM flagged")
def row_flags_b(spark: SparkSession, d: str) -> DataFrame:
    return U.import_flags(rough(spark, d)).select("item_id", F.concat_ws(";", "flags").alias("flags"))


@query(f"""{FLAGGED_B}
, c AS (SELECT document_id, count(*) AS n_rows, count(*) FILTER (flags <> '') AS n_flagged, count(*) FILTER (regexp_matches(flags, 'missing_name|missing_packing|amount_mismatch')) AS n_critical FROM flagged GROUP BY 1)
SELECT document_id, n_rows, n_flagged, n_critical, greatest(0, floor(100 - n_flagged / n_rows * 35 - n_critical / n_rows * 65 + 0.5))::BIGINT AS quality_score,
  n_flagged / n_rows >= 0.1 OR n_critical > 0 AS should_review, n_critical / n_rows >= 0.45 AS should_fail FROM c""")
def batch_quality(spark: SparkSession, d: str) -> DataFrame:
    return U.import_quality(U.import_flags(rough(spark, d)))


@query(f"{FLAGGED_B} SELECT flag, count(*) AS n_rows FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM flagged WHERE flags <> '') GROUP BY 1")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return U.flag_counts(U.import_flags(rough(spark, d)))


@query(f"""{ROUGH_SQL}
, b AS (SELECT *, total_quantity > 500000 AS bq, qty_per_carton > 20000 AS bp, coalesce(unit_price_rmb > 50000, false) AS bu, coalesce(total_amount_rmb > 50000000, false) AS ba, total_cartons > 50000 AS bc FROM rough)
SELECT item_id, CASE WHEN NOT bq THEN total_quantity END AS total_quantity, CASE WHEN NOT bp THEN qty_per_carton END AS qty_per_carton, CASE WHEN NOT bu THEN unit_price_rmb END AS unit_price_rmb, CASE WHEN NOT ba THEN total_amount_rmb END AS total_amount_rmb,
  CASE WHEN NOT bc AND NOT ((bq OR bp OR bu OR ba) AND bq AND total_cartons > 10000) THEN total_cartons END AS total_cartons,
  CASE WHEN NOT (bq OR bp OR bu OR ba OR bc) THEN remarks WHEN coalesce(remarks, '') = '' THEN 'repair:capped_absurd_ocr' ELSE remarks || ';repair:capped_absurd_ocr' END AS remarks FROM b""")
def caps(spark: SparkSession, d: str) -> DataFrame:
    return U.capped(rough(spark, d)).select("item_id", "total_quantity", "qty_per_carton", "unit_price_rmb", "total_amount_rmb", "total_cartons", "remarks")


@query(f"""{ROUGH_SQL}
, a AS (SELECT *, coalesce(packaging, '') <> '' AND NOT regexp_matches(coalesce(packaging, ''), '[0-9]') AND total_cartons > 0 AND total_quantity > 0 AS bad, total_quantity / nullif(total_cartons, 0) AS per, coalesce(total_amount_rmb, 0) AS amount FROM rough),
b AS (SELECT *, bad AND floor(per + 0.5) > 0 AND abs(per - floor(per + 0.5)) <= 0.02 AS whole, floor(amount / nullif(total_quantity, 0) * 10000 + 0.5) / 10000 AS inferred FROM a),
c AS (SELECT *, coalesce(unit_price_rmb, 0) <= 0 AND amount > 0 AND total_quantity > 0 AND inferred > 0 AS np FROM b),
e AS (SELECT *, CASE WHEN np THEN inferred ELSE unit_price_rmb END AS price FROM c)
SELECT item_id, CASE WHEN whole THEN floor(per + 0.5)::BIGINT || 'pcs/ctn' WHEN bad THEN NULL ELSE packaging END AS packaging, price AS unit_price_rmb,
  CASE WHEN amount <= 0 AND total_quantity > 0 AND coalesce(price, 0) > 0 THEN floor(total_quantity * price * 100 + 0.5) / 100 ELSE total_amount_rmb END AS total_amount_rmb,
  nullif(concat_ws(';', remarks, CASE WHEN whole THEN 'repair:packing_from_qty_cartons' WHEN bad THEN 'repair:drop_non_numeric_packing' END, CASE WHEN np THEN 'repair:price_from_amount' END, CASE WHEN amount <= 0 AND total_quantity > 0 AND coalesce(price, 0) > 0 THEN 'repair:amount_from_qty_price' END), '') AS remarks FROM e""")
def sales_repair(spark: SparkSession, d: str) -> DataFrame:
    return U.sales_repaired(rough(spark, d)).select("item_id", "packaging", "unit_price_rmb", "total_amount_rmb", "remarks")


@query(f"""{ROUGH_SQL}
, a AS (SELECT *, coalesce(unit_price_rmb, 0) AS price, coalesce(total_amount_rmb, 0) AS amount, coalesce(total_amount_rmb, 0) / nullif(coalesce(unit_price_rmb, 0), 0) AS share FROM rough),
b AS (SELECT *, CASE WHEN amount > 0 AND price > 0 AND floor(share + 0.5) > 0 AND abs(share - floor(share + 0.5)) <= 0.02 THEN floor(share + 0.5) END AS inferred FROM a),
c AS (SELECT *, CASE WHEN inferred IS NOT NULL AND (total_quantity <= 0 OR total_quantity > inferred * 2) THEN inferred ELSE total_quantity END AS qty FROM b),
e AS (SELECT *, qty > 0 AND NOT (total_cartons > 0 AND qty_per_carton > 0 AND NOT (qty / (total_cartons * qty_per_carton) BETWEEN 0.8 AND 1.25)) AS plausible, floor(qty * price * 100 + 0.5) / 100 AS expected FROM c),
f AS (SELECT *, CASE WHEN qty > 0 AND price > 0 AND amount <= 0 AND plausible THEN expected ELSE total_amount_rmb END AS amount2 FROM e),
g AS (SELECT *, coalesce(amount2, 0) > 0 AND (coalesce(abs(amount2 - total_weight_kg) <= 0.2, false) OR coalesce(abs(amount2 - total_cbm) <= 0.02, false)) AS borrowed FROM f)
SELECT item_id, qty AS total_quantity, CASE WHEN qty > 0 AND price > 0 AND (coalesce(amount2, 0) <= 0 OR (abs(coalesce(amount2, 0) - expected) > greatest(5, expected * 0.25) AND borrowed AND plausible)) THEN expected ELSE amount2 END AS total_amount_rmb FROM g""")
def qty_coherence(spark: SparkSession, d: str) -> DataFrame:
    return U.coherent(rough(spark, d)).select("item_id", "total_quantity", "total_amount_rmb")


FOOTERS = """, footers AS (SELECT document_id, CASE WHEN document_id % 3 <> 0 THEN (count(*) * 3)::DOUBLE END AS footer_cartons, CASE WHEN document_id % 7 <> 0 THEN sum(total_cbm)::DOUBLE + (document_id % 3) * 0.3 END AS footer_cbm,
  CASE WHEN document_id % 4 <> 0 THEN sum(total_weight_kg)::DOUBLE + document_id % 9 END AS footer_weight, CASE WHEN document_id % 5 <> 0 THEN floor(sum(total_amount_rmb)::DOUBLE + (document_id % 4) * 60) END AS footer_amount, count(*) + (document_id % 11 = 0)::INT AS rows_read FROM items GROUP BY 1)"""


def footers(spark: SparkSession, d: str) -> DataFrame:
    per = C.items(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).cast("double").alias(c) for c in U.FOOTER_METRICS.values()))
    k = F.col("document_id")
    return per.select(
        "document_id",
        F.when(k % 3 != 0, (F.col("n") * 3).cast("double")).alias("footer_cartons"),
        F.when(k % 7 != 0, F.col("total_cbm") + (k % 3) * 0.3).alias("footer_cbm"),
        F.when(k % 4 != 0, F.col("total_weight_kg") + k % 9).alias("footer_weight"),
        F.when(k % 5 != 0, F.floor(F.col("total_amount_rmb") + (k % 4) * 60).cast("double")).alias("footer_amount"),
        (F.col("n") + (k % 11 == 0).cast("int")).alias("rows_read"),
    )


@query(f"""{ROUGH_SQL} {FOOTERS}
, a AS (SELECT r.*, footer_cartons AS footer, coalesce(total_quantity > 500000, false) AS bq, coalesce(qty_per_carton > 20000, false) AS bp, total_quantity / nullif(qty_per_carton, 0) AS share FROM rough r LEFT JOIN footers USING (document_id)),
b AS (SELECT *, CASE WHEN qty_per_carton > 0 AND qty_per_carton <= 8000 AND total_quantity > 0 AND share < 1e6 AND abs(share - floor(share + 0.5)) <= 0.051 AND floor(share + 0.5) > 0 THEN floor(share + 0.5) END AS inferred, coalesce(footer > 0 AND total_cartons > footer * 50, false) AS far, total_cartons >= 100000 AS huge FROM a),
c AS (SELECT *, total_cartons > 0 AND NOT bq AND NOT bp AS counted, coalesce((total_cartons >= 500 AND total_cartons > inferred * 12) OR (total_cartons >= 2500 AND abs(total_cartons - inferred) > greatest(100, inferred * 6)), false) AS odd FROM b),
e AS (SELECT *, counted AND inferred IS NOT NULL AND (footer IS NULL OR inferred <= greatest(footer * 3, 8000)) AND (huge OR far OR odd) AS use FROM c),
f AS (SELECT *, counted AND NOT use AND (huge OR far) AS gone FROM e)
SELECT item_id, CASE WHEN NOT bq THEN total_quantity END AS total_quantity, CASE WHEN bq OR bp OR gone THEN NULL WHEN use THEN inferred ELSE total_cartons END AS total_cartons,
  nullif(concat_ws(';', remarks, CASE WHEN bq OR bp THEN 'repair:insane_qty_qpc_cleared' WHEN use THEN 'repair:ctn_from_tqty_qpc' WHEN gone THEN 'repair:ctn_garbage_cleared' END), '') AS remarks FROM f""")
def carton_garbage(spark: SparkSession, d: str) -> DataFrame:
    return U.carton_garbage_repaired(rough(spark, d), footers(spark, d)).select("item_id", "total_quantity", "total_cartons", "remarks")


@query(f"""{FOOTERS}
, c AS (SELECT document_id, sum(CASE WHEN section <> 'left_in_warehouse' THEN total_cartons ELSE 0 END)::DOUBLE AS cartons, sum(CASE WHEN section <> 'left_in_warehouse' THEN total_cbm ELSE 0 END)::DOUBLE AS cbm,
  sum(CASE WHEN section <> 'left_in_warehouse' THEN total_weight_kg ELSE 0 END)::DOUBLE AS weight, sum(total_amount_rmb)::DOUBLE AS amount, count(*) FILTER (section = 'shipped') AS n_publishable FROM items GROUP BY 1)
SELECT document_id, cartons, cbm, weight, amount, n_publishable, CASE WHEN cbm > 0 THEN floor(abs(cbm - footer_cbm) * 100 + 0.5) / 100 END AS cbm_diff, concat_ws(';', CASE WHEN cbm > 0 AND abs(cbm - footer_cbm) > 0.5 THEN 'CBM mismatch' END,
  CASE WHEN weight > 0 AND abs(weight - footer_weight) > 5 THEN 'Weight mismatch' END, CASE WHEN abs(amount - footer_amount) > 100 THEN 'Amount mismatch' END, CASE WHEN abs(cartons - footer_cartons) > 2 THEN 'Carton count mismatch' END,
  CASE WHEN n_publishable = 0 THEN 'No products extracted' END, CASE WHEN n_publishable < 5 THEN 'Suspiciously few rows' END) AS flags FROM footers JOIN c USING (document_id)""")
def extraction_validation(spark: SparkSession, d: str) -> DataFrame:
    found = U.extraction_validated(C.items(spark, d), footers(spark, d))
    return found.select("document_id", *U.FOOTER_METRICS, "n_publishable", "cbm_diff", F.concat_ws(";", "flags").alias("flags"))


@query(f"""{FOOTERS}
, c AS (SELECT document_id, count(*) AS n, sum(total_cartons)::DOUBLE AS cartons, sum(total_cbm)::DOUBLE AS cbm, sum(total_weight_kg)::DOUBLE AS weight, sum(total_amount_rmb)::DOUBLE AS amount FROM items WHERE NOT deleted OR document_id % 2 = 0 GROUP BY 1),
g AS (SELECT document_id, n = rows_read AS rows_ok, footer_cartons IS NOT NULL AND footer_cbm IS NOT NULL AND footer_weight IS NOT NULL AND footer_amount IS NOT NULL AS footers_present,
  coalesce(footer_cartons, footer_cbm, footer_weight, footer_amount) IS NOT NULL AND abs(coalesce(cartons - footer_cartons, 0)) <= 0.5 AND abs(coalesce(cbm - footer_cbm, 0)) <= 0.05 AND abs(coalesce(weight - footer_weight, 0)) <= 1 AND abs(coalesce(amount - footer_amount, 0)) <= 5 AS totals_match
  FROM footers JOIN c USING (document_id))
SELECT *, rows_ok AND footers_present AND totals_match AS passes FROM g""")
def import_gate(spark: SparkSession, d: str) -> DataFrame:
    return U.import_gate(C.items(spark, d).where("not deleted or document_id % 2 = 0"), footers(spark, d))


@query(f"""{FOOTERS}
, p AS (SELECT document_id, sum(CASE WHEN section <> 'left_in_warehouse' THEN total_cartons ELSE 0 END)::DOUBLE AS total_cartons, sum(CASE WHEN section <> 'left_in_warehouse' THEN total_cbm ELSE 0 END)::DOUBLE AS total_cbm,
  sum(CASE WHEN section <> 'left_in_warehouse' THEN total_weight_kg ELSE 0 END)::DOUBLE AS total_weight_kg, sum(total_amount_rmb)::DOUBLE AS total_amount_rmb FROM items GROUP BY 1)
SELECT p.*, round(total_cartons - coalesce(footer_cartons, 0), 2) AS cartons_diff, round(total_cbm - coalesce(footer_cbm, 0), 4) AS cbm_diff, round(total_weight_kg - coalesce(footer_weight, 0), 2) AS weight_diff, round(total_amount_rmb - coalesce(footer_amount, 0), 2) AS amount_diff,
  abs(total_cartons - coalesce(footer_cartons, 0)) <= 3 AND abs(total_cbm - coalesce(footer_cbm, 0)) <= 0.02 AND abs(total_weight_kg - coalesce(footer_weight, 0)) <= 1 AND abs(total_amount_rmb - coalesce(footer_amount, 0)) <= 1 AS totals_match FROM p JOIN footers USING (document_id)""")
def physical_totals_match(spark: SparkSession, d: str) -> DataFrame:
    return U.physical_totals_matched(C.items(spark, d), footers(spark, d))


@query("""
, bars AS (SELECT document_id, section, max_by(total_amount_rmb, line_no)::DOUBLE AS bar_amount, max_by(total_cartons, line_no)::DOUBLE AS bar_cartons FROM items WHERE deleted GROUP BY 1, 2),
s AS (SELECT document_id, section, sum(total_amount_rmb)::DOUBLE AS amount, sum(total_cartons)::DOUBLE AS cartons FROM items WHERE NOT deleted GROUP BY 1, 2)
SELECT document_id, section, amount, cartons, bar_amount, bar_cartons, abs(amount - bar_amount) <= 1 AND (section = 'left_in_warehouse' OR abs(cartons - bar_cartons) <= 3) AS matches FROM s JOIN bars USING (document_id, section)""")
def section_vs_printed(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d)
    return U.section_against_bars(items.where("not deleted"), items.where("deleted").select("document_id", "section", F.col("line_no").alias("bar_order"), F.col("total_amount_rmb").alias("bar_amount"), F.col("total_cartons").alias("bar_cartons")))


@query("""SELECT item_id, CASE WHEN section = 'shipped' AND total_cartons >= 2 AND supplier_id % 3 = 0 THEN 0 ELSE total_cartons END::DOUBLE AS total_cartons,
  CASE WHEN section = 'shipped' AND total_cartons >= 2 AND supplier_id % 3 = 0 THEN coalesce(remarks || ' ', '') || 'carton_dedup:qty_misread_as_ctn' ELSE remarks END AS remarks FROM items""")
def phantom_cartons(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d)
    some = F.col("supplier_id") % 3 != 0
    bare = items.withColumns({"total_cbm": F.when(some, F.col("total_cbm")), "total_weight_kg": F.when(some, F.col("total_weight_kg"))})
    return U.without_phantom_cartons(bare, least=2).select("item_id", "total_cartons", "remarks")


@query("""SELECT item_id, CASE WHEN section = 'repacked' AND supplier_id % 4 <> 0 THEN 'left_in_warehouse' ELSE section END AS section FROM items""")
def sections_continued(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d).withColumn("marks", F.when(F.col("supplier_id") % 4 == 0, F.concat(F.lit("37-T-1 "), F.col("marks"))).otherwise(F.col("marks")))
    return U.sections_continued(items).select("item_id", "section")


@query("""SELECT item_id, CASE WHEN section = 'left_in_warehouse' THEN 0 ELSE total_cartons END::DOUBLE AS total_cartons, CASE WHEN section = 'left_in_warehouse' THEN 0 ELSE total_cbm END::DOUBLE AS total_cbm,
  CASE WHEN section = 'left_in_warehouse' THEN coalesce(remarks || ' ', '') || 'warehouse:physical_zeroed' ELSE remarks END AS remarks FROM items""")
def warehouse_zeroed(spark: SparkSession, d: str) -> DataFrame:
    return U.warehouse_zeroed(C.items(spark, d)).select("item_id", "total_cartons", "total_cbm", "remarks")


@query("""
, x AS (SELECT *, CASE WHEN line_no % 2 = 0 THEN -2 ELSE 3 END AS delta, total_cartons::DOUBLE AS c, total_quantity::DOUBLE AS q FROM items),
y AS (SELECT *, greatest(0, c + delta) AS a FROM x), z AS (SELECT *, CASE WHEN a <= 0 THEN 0 ELSE floor(q / c * a + 0.5) END AS nq FROM y)
SELECT item_id, a AS total_cartons, nq::DOUBLE AS total_quantity, floor(unit_price_rmb::DOUBLE * nq * 100 + 0.5) / 100 AS total_amount_rmb, floor(total_cbm::DOUBLE / c * a * 10000 + 0.5) / 10000 AS total_cbm FROM z""")
def carton_adjustments(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d)
    deltas = items.select("item_id", F.when(F.col("line_no") % 2 == 0, -2).otherwise(3).alias("delta"))
    return U.cartons_adjusted(items, deltas)


TEXTS = """
, t AS (SELECT item_id, CASE item_id % 9 WHEN 0 THEN ' ' || total_quantity::DOUBLE::BIGINT || ',500.25 kg' WHEN 1 THEN '-' || total_quantity::DOUBLE::BIGINT || '.5' WHEN 2 THEN '.' WHEN 3 THEN '-' WHEN 4 THEN '¥' || total_quantity::DOUBLE::BIGINT || '.50'
  WHEN 5 THEN total_quantity::DOUBLE::BIGINT || 'KGS' WHEN 6 THEN '' WHEN 7 THEN 'null' ELSE '1e' || item_id % 3 || 'x' END AS s FROM items)"""


@query(f"""{TEXTS}
SELECT item_id, try_cast(nullif(regexp_extract(replace(trim(s), ',', ''), '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?'), '') AS DOUBLE) AS finite, try_cast(replace(trim(s), ',', '') AS DOUBLE) AS strict,
  coalesce(try_cast(nullif(regexp_extract(regexp_replace(s, '[^0-9.-]', '', 'g'), '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?'), '') AS DOUBLE), 0) AS loose, try_cast(nullif(regexp_replace(s, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits,
  try_cast(nullif(regexp_extract(trim(regexp_replace(regexp_replace(s, '[¥￥,%]', '', 'g'), '(?i)(?:PCS|CTNS?|KGS?|CBM|CM|MM)', '', 'g')), '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?'), '') AS DOUBLE) AS cell,
  coalesce(try_cast(nullif(regexp_extract(regexp_replace(s, '[^0-9.]', '', 'g'), '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?'), '') AS DOUBLE), 0) AS weight, CASE WHEN trim(s) NOT IN ('', 'null', 'undefined') THEN trim(s) END AS clean FROM t""")
def number_parse(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("total_quantity").cast("double").cast("long"), F.col("item_id") % 9
    s = (
        F.when(k == 0, F.concat(F.lit(" "), n, F.lit(",500.25 kg"))).when(k == 1, F.concat(F.lit("-"), n, F.lit(".5"))).when(k == 2, ".").when(k == 3, "-").when(k == 4, F.concat(F.lit("¥"), n, F.lit(".50")))
        .when(k == 5, F.concat(n, F.lit("KGS"))).when(k == 6, "").when(k == 7, "null").otherwise(F.concat(F.lit("1e"), F.col("item_id") % 3, F.lit("x")))
    )
    t = C.items(spark, d).select("item_id", s.alias("s"))
    c = F.col("s")
    return t.select("item_id", N.finite(c).alias("finite"), N.strict(c).alias("strict"), N.loose(c).alias("loose"), N.digits(c).alias("digits"), N.cell(c).alias("cell"), N.weight(c).alias("weight"), T.clean(c).alias("clean"))


@query("""
, t AS (SELECT document_id, CASE document_id % 4 WHEN 0 THEN strftime(created_at, '%Y-%m-%d') WHEN 1 THEN strftime(created_at, ' %d/%m/%Y') WHEN 2 THEN strftime(created_at, '%d-%m-%Y') ELSE strftime(created_at, '%d.%m.%Y') END AS s, strftime(created_at, '%Y-%m-%d') AS iso FROM docs)
SELECT document_id, s AS printed, CASE WHEN document_id % 4 = 3 THEN NULL ELSE iso END AS iso FROM t""")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("document_id") % 4, F.col("created_at")
    s = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.concat(F.lit(" "), F.date_format(at, "dd/MM/yyyy"))).when(k == 2, F.date_format(at, "dd-MM-yyyy")).otherwise(F.date_format(at, "dd.MM.yyyy"))
    return C.documents(spark, d).select("document_id", s.alias("printed")).withColumn("iso", N.iso_date(F.col("printed")))


@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'pcs' WHEN 1 THEN 'sets' ELSE 'pcs' END AS unit, CASE WHEN item_id % 3 = 2 THEN total_cartons::DOUBLE END AS cartons, CASE WHEN item_id % 3 = 0 THEN qty_per_carton::DOUBLE END AS pieces, packaging AS trailing, description AS bare FROM items""")
def packing_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id") % 3
    packing = F.when(k == 0, F.col("packaging")).when(k == 1, F.concat(F.col("qty_per_carton").cast("int"), F.lit(" SETS / CTN"))).otherwise(F.concat(F.col("total_cartons").cast("int"), F.lit("CTNS")))
    t = C.items(spark, d).select("item_id", packing.alias("p"), F.concat("description", F.lit(" "), "packaging").alias("long_text"))
    return t.select("item_id", T.unit(F.col("p")).alias("unit"), T.packing_cartons(F.col("p")).alias("cartons"), T.packing_pieces(F.col("p")).alias("pieces"), T.trailing_packing(F.col("long_text")).alias("trailing"), T.without_trailing_packing(F.col("long_text")).alias("bare"))


@query("""SELECT p_partkey AS product_id, CASE p_partkey % 4 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN p_name WHEN 2 THEN p_name ELSE 'KD63-218A' END AS base FROM part""")
def base_name(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    second = F.substring_index(name, " ", 1)
    s = F.when(k == 0, F.concat(second, F.lit(" 保温壶 flask"))).when(k == 1, F.concat(name, F.lit("  TE-R100FG-1"))).when(k == 2, F.concat(name, F.lit(" SCT- x"))).otherwise(F.concat(F.lit("KD63-218A "), name))
    return C.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), T.base_name(s).alias("base"))


@query("""SELECT item_id, CASE item_id % 8 WHEN 0 THEN 'new_order' WHEN 1 THEN 'before_goods' WHEN 2 THEN 'goods_left' WHEN 3 THEN 'repacked' WHEN 4 THEN 'stuffed' WHEN 5 THEN 'unknown' END AS kind FROM items""")
def section_headers(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("item_id") % 8, F.col("line_no")
    s = (
        F.when(k == 0, " NEW  ORDER NEW ORDERS:").when(k == 1, F.concat(F.lit("before goods MAG-"), n)).when(k == 2, F.concat(F.lit("GOODS LEFT IN SANCARGO "), n)).when(k == 3, F.concat(F.lit("37-T-"), n, F.lit(" 18 CTN GOODS STUFFED INTO THIS CONTAINER(REPACKED GOODS)")))
        .when(k == 4, "MMB GOODS LOAD IN THIS CONTANIER").when(k == 5, F.concat(F.lit("Kitchen wares lot "), F.col("shop"))).when(k == 6, F.concat(F.col("marks"), F.lit(" ¥ 12 CBM 3"))).otherwise("")
    )
    return C.items(spark, d).select("item_id", T.header_kind(s).alias("kind"))


@query("""SELECT item_id, CASE WHEN section = 'shipped' THEN 'shipped' ELSE section END AS canonical, CASE item_id % 3 WHEN 0 THEN 'repacked' WHEN 1 THEN 'left_in_warehouse' ELSE 'shipped' END AS stored, CASE item_id % 3 WHEN 0 THEN 'REPACKED & ' || shop WHEN 1 THEN 'goods left ' || shop ELSE NULL END AS label FROM items""")
def section_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id") % 3
    label = F.when(k == 0, F.concat(F.lit("REPACKED & "), F.col("shop"))).when(k == 1, F.concat(F.lit("goods left "), F.col("shop")))
    t = C.items(spark, d).select("item_id", "section", F.concat_ws(";", F.lit("x"), T.section_label_tag(label)).alias("remarks"))
    return t.select("item_id", T.canonical_section(F.col("section")).alias("canonical"), T.storage_section(F.lit("none"), F.col("remarks")).alias("stored"), T.section_label(F.col("remarks")).alias("label"))


@query("""SELECT item_id, item_id % 4 IN (0, 1) AS footer_like, item_id % 4 = 3 AS valid_marks FROM items""")
def footer_predicates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id") % 4
    description = F.when(k == 0, F.concat(F.lit("Total  weight "), F.col("line_no"))).when(k == 1, F.concat(F.lit("PAYMENT 13/02/2026 USD "), F.col("line_no"))).otherwise(F.col("description"))
    marks = F.when(k == 2, F.concat(F.col("marks"), F.lit("CTN"))).when(k == 3, F.col("marks")).otherwise("x y z")
    t = C.items(spark, d).select("item_id", marks.alias("marks"), description.alias("description"), "item_code", F.lit(None).cast("string").alias("shop"))
    return t.select("item_id", T.footer_like(*(F.col(c) for c in ("marks", "description", "item_code", "shop"))).alias("footer_like"), T.valid_marks(F.col("marks")).alias("valid_marks"))


@query("""SELECT document_id, CASE document_id % 5 WHEN 0 THEN 'sales_order' WHEN 1 THEN 'container_manifest' WHEN 2 THEN 'sales_order' WHEN 3 THEN 'container_manifest' ELSE 'sales_order' END AS kind FROM docs""")
def doc_type(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("document_id") % 5, F.col("document_id").cast("string")
    body = F.when(k == 0, "").when(k == 1, F.concat(F.lit("CONTAINER NO "), n, F.lit("\nCLIENT DETAILS SANCARGO"))).when(k == 2, F.concat(F.lit("DEL NO\nCUS NO "), n)).when(k == 3, F.concat(F.lit("lines "), n)).otherwise(F.concat(F.lit("送货单 "), n))
    name = F.when(k.isin(0, 1), F.concat(F.lit("/in/销售单"), n, F.lit(".pdf"))).when(k == 3, F.concat(F.lit("MS-"), n, F.lit(".pdf"))).otherwise(F.col("source_file_name"))
    return C.documents(spark, d).select("document_id", T.resolved_kind(body, name).alias("kind"))


@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'W-' || product_id WHEN 1 THEN item_code ELSE '26C' || (100 + product_id % 900) || '-7' END AS item_code, CASE item_id % 3 WHEN 0 THEN 'W-' || product_id WHEN 1 THEN (product_id % 1000)::VARCHAR ELSE '26C' || (100 + product_id % 900) || '-7' END AS source_item_no FROM items""")
def sku_fields(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("item_id") % 3, F.col("product_id")
    delivery = F.concat(F.lit("26C"), 100 + p % 900, F.lit("-7"))
    source = F.when(k == 0, F.concat(F.lit("W-"), p)).when(k == 1, (p % 1000).cast("string"))
    code = F.when(k == 1, F.col("item_code")).otherwise(delivery)
    return C.items(spark, d).select("item_id", T.sku_fields(source, code).alias("f")).select("item_id", "f.item_code", "f.source_item_no")


@query("""SELECT item_id, CASE WHEN item_id % 3 = 2 THEN NULL ELSE line_no END::INT AS box_start, CASE item_id % 3 WHEN 0 THEN line_no + 5 WHEN 1 THEN line_no END::INT AS box_end FROM items""")
def box_ranges(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("item_id") % 3, F.col("line_no")
    label = F.when(k == 0, F.concat(n, F.lit(" - "), n + 5)).when(k == 1, F.concat(F.lit(" "), n)).otherwise("box")
    return C.items(spark, d).select("item_id", T.box_range(label).alias("r")).select("item_id", F.col("r.start").alias("box_start"), F.col("r.end").alias("box_end"))


@query("""
, rows AS (SELECT *, split_part(description, ' ', 1) AS w1, split_part(description, ' ', 2) AS w2, substr(regexp_replace(item_code, '-[A-Z0-9]+$', ''), 1, 5) AS stem, line_no % 3 = 0 AS bare FROM items),
s AS (SELECT n.item_id, n.total_quantity, d.line_no AS donor_line, d.unit_price_rmb::DOUBLE AS price, 4 * (n.stem = d.stem)::INT + CASE WHEN (length(d.w1) >= 3 AND d.w1 IN (n.w1, n.w2))::INT + (length(d.w2) >= 3 AND d.w2 IN (n.w1, n.w2))::INT >= 2 THEN 3 ELSE 0 END
  + CASE WHEN abs(n.qty_per_carton - d.qty_per_carton) <= 2 THEN 1 ELSE 0 END AS score FROM rows n JOIN rows d USING (document_id) WHERE n.bare AND NOT d.bare)
SELECT item_id, donor_line, score, price AS unit_price_rmb, floor(total_quantity::DOUBLE * price * 100 + 0.5) / 100 AS total_amount_rmb FROM s WHERE score >= 3 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, donor_line) = 1""")
def price_donor(spark: SparkSession, d: str) -> DataFrame:
    bare = F.col("line_no") % 3 == 0
    items = C.items(spark, d)
    return J.price_donors(items.withColumns({"unit_price_rmb": F.when(~bare, F.col("unit_price_rmb")), "total_amount_rmb": F.when(~bare, F.col("total_amount_rmb"))}))


@query("""SELECT item_id, remarks FROM items i WHERE remarks IS NULL OR NOT EXISTS (SELECT 1 FROM items g WHERE g.document_id = i.document_id AND g.marks = i.marks AND g.section = 'left_in_warehouse' AND g.remarks IS NULL)""")
def carryover_anti(spark: SparkSession, d: str) -> DataFrame:
    return J.without_carryovers(C.items(spark, d)).select("item_id", "remarks")


@query("""SELECT item_id, CASE WHEN product_id % 3 = 0 THEN 'Cup ' || product_id WHEN product_id % 3 = 1 THEN '壶' || product_id ELSE NULL END AS name FROM items""")
def english_first(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("product_id") % 3, F.col("product_id")
    a = F.when(k < 2, F.concat(F.lit("壶"), p)).otherwise("")
    b = F.when(k == 0, F.concat(F.lit("Cup "), p)).otherwise("")
    return C.items(spark, d).select("item_id", T.english_first(a, b).alias("name"))


@query("""SELECT item_id, CASE WHEN line_no % 3 = 2 THEN NULL ELSE 3::DOUBLE END AS cartons, CASE line_no % 3 WHEN 0 THEN 120 WHEN 1 THEN 2 ELSE 5 END::DOUBLE AS quantity, CASE line_no % 3 WHEN 0 THEN 12.5 WHEN 1 THEN 7 ELSE 60 END::DOUBLE AS cost_price,
  CASE line_no % 3 WHEN 0 THEN 600 WHEN 1 THEN 14 ELSE 1500 END::DOUBLE AS total_amount_rmb, CASE line_no % 3 WHEN 0 THEN 'repair:shifted_manifest_columns' WHEN 2 THEN 'repair:no_packing_amount_row' END AS remarks,
  CASE line_no % 3 WHEN 0 THEN '40pcs/ctn' WHEN 1 THEN packaging END AS packing FROM items""")
def shift_repair(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("line_no") % 3
    pick = lambda a, b, c, t="double": F.when(k == 0, F.lit(a)).when(k == 1, F.lit(b)).otherwise(F.lit(c)).cast(t)
    rows = C.items(spark, d).select(
        "item_id", F.col("item_code").alias("sku"), F.when(k == 0, F.concat("description", F.lit(" 40pcs/ctn"))).otherwise(F.col("description")).alias("description"), F.when(k == 0, "3CTNS").when(k == 1, F.col("packaging")).alias("packing"),
        pick(120, 3, 5).alias("cartons"), pick(50, 2, 0).alias("quantity"), pick(0.5, 10, 10).alias("dim_l_cm"), pick(40, 10, 10).alias("dim_w_cm"), pick(30, 10, 10).alias("dim_h_cm"), pick(0.3, 0.1, 0.1).alias("unit_cbm"), pick(12, 0.3, 0.3).alias("cbm"),
        pick("14KGS", "1KGS", "1KGS", "string").alias("unit_weight"), pick("12.5", "3KGS", "60", "string").alias("total_weight"), pick(600, 7, 1500).alias("cost_price"), pick(20, 14, 300).alias("total_amount_rmb"), F.lit(None).cast("string").alias("remarks"),
    )
    return U.manifest_repaired(rows).select("item_id", "cartons", "quantity", "cost_price", "total_amount_rmb", "remarks", "packing")
