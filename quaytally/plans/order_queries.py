"""Order-dependent operators over items, movements and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaytally.operators import order as O
from quaytally.plans.registry import query
from quaytally.sources import canonical as C

HEADER = "CASE WHEN line_no % 4 = 1 THEN CASE product_id % 3 WHEN 0 THEN 'repacked' WHEN 1 THEN 'left_in_warehouse' ELSE 'shipped' END END"


def headed(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("product_id") % 3 == 0, "repacked").when(F.col("product_id") % 3 == 1, "left_in_warehouse").otherwise("shipped")
    return C.items(spark, d).drop("section").withColumn("header_section", F.when(F.col("line_no") % 4 == 1, kind))


@query(f"""SELECT item_id, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no), 'shipped') AS section FROM (SELECT *, {HEADER} AS h FROM items)""")
def section_fill(spark: SparkSession, d: str) -> DataFrame:
    return O.section_filled(headed(spark, d)).select("item_id", "section")


@query("""
, b AS (SELECT *, sum(r::INT) OVER (PARTITION BY document_id ORDER BY line_no) AS block FROM (SELECT *, line_no % 6 = 0 AS r, CASE WHEN product_id % 2 = 0 THEN marks ELSE '' END AS m FROM items))
SELECT item_id, CASE WHEN r OR line_no % 7 = 3 THEN m ELSE last_value(nullif(m, '') IGNORE NULLS) OVER (PARTITION BY document_id, block ORDER BY line_no) END AS marks FROM b""")
def marks_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = C.items(spark, d).withColumns({"is_reset": F.col("line_no") % 6 == 0, "is_anonymous": F.col("line_no") % 7 == 3, "marks": F.when(F.col("product_id") % 2 == 0, F.col("marks")).otherwise("")})
    return O.marks_filled(rows).select("item_id", "marks")


@query("""
, r AS (SELECT item_id, document_id, line_no, 'M' || product_id % 2 AS marks, 2 AS cartons, section FROM (SELECT *, CASE WHEN line_no % 5 = 0 THEN 'left_in_warehouse' ELSE 'shipped' END AS section FROM (SELECT * EXCLUDE (section) FROM items))),
m AS (SELECT *, coalesce(section = 'shipped' AND lag(section) OVER w = 'shipped' AND lag(marks) OVER w = marks, false) AS match FROM r WINDOW w AS (PARTITION BY document_id ORDER BY line_no)),
i AS (SELECT *, sum((NOT match)::INT) OVER (PARTITION BY document_id ORDER BY line_no) AS island FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY document_id, island ORDER BY line_no) - 1 AS place FROM i)
SELECT item_id, CASE WHEN match AND place % 2 = 1 THEN 0 ELSE cartons END::DOUBLE AS total_cartons, CASE WHEN match AND place % 2 = 1 THEN 'carton_dedup:secondary_row' END AS remarks FROM p""")
def carton_dedupe(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d).select(
        "item_id", "document_id", "line_no",
        F.concat(F.lit("M"), F.col("product_id") % 2).alias("marks"),
        *(F.lit("same").alias(c) for c in ("item_code", "description", "shop")),
        F.lit(2).cast("decimal(18,3)").alias("total_cartons"),
        *(F.lit(1).cast("decimal(16,2)").alias(c) for c in ("total_quantity", "unit_price_rmb", "total_amount_rmb", "total_cbm", "total_weight_kg")),
        F.when(F.col("line_no") % 5 == 0, "left_in_warehouse").otherwise("shipped").alias("section"),
        F.lit(None).cast("string").alias("remarks"),
    )
    return O.cartons_deduplicated(items).select("item_id", "total_cartons", "remarks")


@query("""
, read AS (SELECT *, 0 AS copy FROM items UNION ALL SELECT *, 1 FROM items WHERE line_no % 3 <> 1)
SELECT item_id, document_id, copy FROM read QUALIFY row_number() OVER (PARTITION BY document_id, section, marks, item_code, description, total_cartons, total_quantity, total_amount_rmb ORDER BY copy, line_no) = 1""")
def first_seen_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Rows of overlapping pieces of a document are read twice."""
    items = C.items(spark, d)
    read = items.withColumn("copy", F.lit(0)).unionByName(items.where("line_no % 3 <> 1").withColumn("copy", F.lit(1)))
    keys = ("document_id", "section", "marks", "item_code", "description", "total_cartons", "total_quantity", "total_amount_rmb")
    return O.first_seen(read, keys, ("copy", "line_no")).select("item_id", "document_id", "copy")


@query("""SELECT movement_id, product_id, sum(CASE movement_type WHEN 'out' THEN -quantity ELSE quantity END) OVER (PARTITION BY product_id, segment ORDER BY created_at, movement_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS stock
FROM (SELECT *, count(*) FILTER (movement_type = 'adjustment') OVER (PARTITION BY product_id ORDER BY created_at, movement_id ROWS UNBOUNDED PRECEDING) AS segment FROM movements)""")
def running_stock(spark: SparkSession, d: str) -> DataFrame:
    return O.running_stock(C.movements(spark, d)).select("movement_id", "product_id", "stock")


VERSIONS = """
, versions AS (SELECT product_id AS item_id, row_number() OVER (PARTITION BY product_id ORDER BY document_id, line_no) AS version, section, total_cartons::BIGINT::VARCHAR AS cartons, deleted FROM items)
, changed AS (SELECT *, lag(section) OVER w AS s0, lag(cartons) OVER w AS c0, lag(deleted) OVER w AS d0 FROM versions WINDOW w AS (PARTITION BY item_id ORDER BY version))
, changes AS (SELECT *, CASE WHEN deleted AND NOT d0 THEN 'delete' WHEN NOT deleted AND d0 THEN 'restore' WHEN section <> s0 OR cartons <> c0 THEN 'update' END AS action FROM changed WHERE d0 IS NOT NULL)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a product, in document order, as versions of one item."""
    rows = C.items(spark, d).select(F.col("product_id").alias("item_id"), "document_id", F.col("line_no").alias("line"), "section", F.col("total_cartons").cast("long").cast("string").alias("cartons"), "deleted")
    return O.numbered(rows, "item_id", "document_id", "line").withColumnRenamed("line_no", "version").withColumn("version", F.col("version").cast("long")).drop("document_id", "line")


@query(f"""{VERSIONS} SELECT item_id, version, action, concat_ws(';', CASE WHEN section <> s0 THEN 'section=' || s0 END, CASE WHEN cartons <> c0 THEN 'cartons=' || c0 END) AS old_values,
  concat_ws(';', CASE WHEN section <> s0 THEN 'section=' || section END, CASE WHEN cartons <> c0 THEN 'cartons=' || cartons END) AS new_values FROM changes WHERE action IS NOT NULL""")
def row_change_log(spark: SparkSession, d: str) -> DataFrame:
    shown = lambda c: F.concat_ws(";", F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    found = O.version_changes(versions(spark, d), "item_id", ("section", "cartons"))
    return found.withColumns({"old_values": shown("old_values"), "new_values": shown("new_values")})


@query(f"""{VERSIONS} SELECT item_id, count(*) AS n_changes, max(version) AS last_version, max_by(action, version) AS last_action FROM changes WHERE action IS NOT NULL GROUP BY 1""")
def change_counts(spark: SparkSession, d: str) -> DataFrame:
    found = O.version_changes(versions(spark, d), "item_id", ("section", "cartons"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_changes"), F.max("version").alias("last_version"), F.max_by("action", "version").alias("last_action"))


@query(f"""{VERSIONS} SELECT item_id, version, first_value(cartons) OVER (PARTITION BY item_id ORDER BY version) AS original_cartons, abs(cartons::DOUBLE - first_value(cartons::DOUBLE) OVER (PARTITION BY item_id ORDER BY version)) >= 0.005 AS moved FROM versions""")
def originals(spark: SparkSession, d: str) -> DataFrame:
    rows = O.originals_frozen(versions(spark, d), "item_id", ("cartons",))
    return rows.select("item_id", "version", "original_cartons", (F.abs(F.col("cartons").cast("double") - F.col("original_cartons").cast("double")) >= 0.005).alias("moved"))


@query(f"""{VERSIONS}
, last AS (SELECT item_id, max_by(action, version) AS last_action, count(*) AS n_changes FROM changes WHERE action IS NOT NULL GROUP BY 1),
ends AS (SELECT item_id, max_by(deleted, version) AS deleted, min_by(cartons, version)::DOUBLE AS original, max_by(cartons, version)::DOUBLE AS live FROM versions GROUP BY 1)
SELECT item_id, deleted, live - original AS delta, last_action FROM ends LEFT JOIN last USING (item_id) WHERE deleted OR n_changes > 0 OR abs(live - original) >= 0.005""")
def changed_items(spark: SparkSession, d: str) -> DataFrame:
    rows = versions(spark, d)
    last = O.version_changes(rows, "item_id", ("section", "cartons")).groupBy("item_id").agg(F.max_by("action", "version").alias("last_action"), F.count(F.lit(1)).alias("n_changes"))
    ends = rows.groupBy("item_id").agg(F.max_by("deleted", "version").alias("deleted"), F.min_by("cartons", "version").cast("double").alias("original"), F.max_by("cartons", "version").cast("double").alias("live"))
    found = ends.join(last, "item_id", "left").where("deleted or n_changes > 0 or abs(live - original) >= 0.005")
    return found.select("item_id", "deleted", (F.col("live") - F.col("original")).alias("delta"), "last_action")


@query("""SELECT user_id AS item_id, max(event_id) AS change_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1""")
def note_target(spark: SparkSession, d: str) -> DataFrame:
    changes = C.table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("change_id"), F.when(F.col("event_id") % 3 == 0, "noted").alias("note"))
    return O.note_target(changes, "item_id")


@query("""SELECT user_id AS job_key, event_id AS job_id, event_type AS status FROM events WHERE event_type IN ('view', 'click', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    jobs = C.table(spark, d, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    return O.latest(jobs, ("user_id",), F.desc("ts"), F.desc("event_id")).select(F.col("user_id").alias("job_key"), F.col("event_id").alias("job_id"), F.col("event_type").alias("status"))


@query("""SELECT event_id AS job_id, event_type = 'error' AND value < 100 AS retryable, event_id % 4 AS attempts, CASE WHEN event_type = 'error' AND value < 100 AND event_id % 4 < 2 THEN strftime(ts + to_seconds(5 * (event_id % 4 + 1)), '%Y-%m-%d %H:%M:%S') END AS retry_at,
  event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 8 MINUTE AS stale FROM events""")
def retry_report(spark: SparkSession, d: str) -> DataFrame:
    jobs = C.table(spark, d, "events").withColumn("error", F.when(F.col("event_type") == "error", F.when(F.col("value") < 100, "fetch failed: ETIMEDOUT").otherwise("bad document")))
    attempts = F.col("event_id") % 4
    retryable = F.coalesce(F.lower("error").rlike("timeout|timedout|econnreset|fetch failed|rate limit|429|503"), F.lit(False))
    at = F.when(retryable & (attempts < 2), F.date_format(F.col("ts") + F.make_dt_interval(secs=5 * (attempts + 1)), "yyyy-MM-dd HH:mm:ss"))
    stale = (F.col("event_type") == "view") & (F.col("ts") < F.expr("timestamp_ntz'2024-01-15 00:00:00' - interval 8 minutes"))
    return jobs.select(F.col("event_id").alias("job_id"), retryable.alias("retryable"), attempts.alias("attempts"), at.alias("retry_at"), stale.alias("stale"))


@query("""
, h AS (SELECT *, CASE WHEN product_id % 29 = 0 THEN 'repacked' WHEN product_id % 7 = 0 THEN 'goods_left' END AS header FROM items),
s AS (SELECT *, max(coalesce(header = 'repacked', false)::INT) OVER (PARTITION BY document_id ORDER BY line_no) AS seen FROM h)
SELECT item_id FROM s WHERE seen = 0 AND coalesce(header, '') <> 'goods_left'""")
def repack_boundary(spark: SparkSession, d: str) -> DataFrame:
    rows = C.items(spark, d).withColumn("header", F.when(F.col("product_id") % 29 == 0, "repacked").when(F.col("product_id") % 7 == 0, "goods_left"))
    return O.until_boundary(rows).select("item_id")


@query("""
, i AS (SELECT document_id, item_id, line_no, total_cartons::DOUBLE + CASE WHEN line_no % 2 = 0 THEN 4 + product_id % 5 ELSE 0 END AS cartons, ceil(total_quantity / qty_per_carton)::DOUBLE AS whole, qty_per_carton FROM items),
f AS (SELECT document_id, sum(cartons) - greatest(sum(cartons) - 9, 0) AS overflow FROM i GROUP BY 1 HAVING sum(cartons) - 9 > 0),
c AS (SELECT document_id, item_id, whole, cartons - whole AS reduction, row_number() OVER (PARTITION BY document_id ORDER BY cartons - whole DESC, line_no DESC) AS n FROM i WHERE cartons - whole >= 4),
taken AS (SELECT document_id, overflow AS left_over, 0 AS n, NULL::BIGINT AS item_id, NULL::DOUBLE AS new_cartons FROM f
  UNION ALL SELECT t.document_id, CASE WHEN c.reduction <= t.left_over THEN t.left_over - c.reduction ELSE t.left_over END, c.n, CASE WHEN c.reduction <= t.left_over THEN c.item_id END, c.whole
  FROM taken t JOIN c ON c.document_id = t.document_id AND c.n = t.n + 1)
SELECT document_id, item_id, new_cartons FROM taken WHERE item_id IS NOT NULL""")
def overflow_reconcile(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d).withColumn("total_cartons", F.col("total_cartons") + F.when(F.col("line_no") % 2 == 0, 4 + F.col("product_id") % 5).otherwise(0))
    footers = items.groupBy("document_id").agg((F.sum("total_cartons").cast("double") - 9).alias("footer_cartons"))
    return O.overflow_reconciled(items.withColumn("total_quantity", F.ceil(F.col("total_quantity") / F.col("qty_per_carton")) * F.col("qty_per_carton")), footers, least_pieces=1)


CONTINUATIONS = r"""
, r AS (SELECT document_id, item_id, line_no, CASE supplier_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'M1' ELSE 'M' END AS marks, 'K ' || supplier_id % 2 AS item_code,
  CASE (product_id + line_no) % 6 WHEN 0 THEN NULL WHEN 1 THEN '22' WHEN 2 THEN '[ ] []' WHEN 3 THEN 'ab' ELSE description END AS description,
  CASE WHEN line_no % 3 <> 1 THEN total_quantity::DOUBLE END AS total_quantity, CASE WHEN line_no % 4 <> 2 THEN unit_price_rmb::DOUBLE END AS unit_price_rmb, CASE WHEN line_no % 5 <> 3 THEN total_amount_rmb::DOUBLE END AS total_amount_rmb, remarks, CASE WHEN line_no % 2 = 0 THEN material END AS material FROM items),
noise AS (SELECT *, trim(coalesce(description, '')) AS d, regexp_full_match(trim(coalesce(description, '')), '\d{1,15}|(\[\s*\]\s*)*') AS noise, greatest(coalesce(total_quantity, 0), coalesce(unit_price_rmb, 0), coalesce(total_amount_rmb, 0)) > 0 AS brings FROM r),
steps AS (
  SELECT document_id, line_no, 0 AS g, item_id, marks, item_code, d, noise, brings, total_quantity, unit_price_rmb, total_amount_rmb, remarks, material FROM noise WHERE line_no = 1
  UNION ALL
  SELECT document_id, line_no, CASE WHEN m THEN g ELSE g + 1 END, CASE WHEN m THEN item_id ELSE item_id2 END, CASE WHEN m THEN marks ELSE marks2 END, CASE WHEN m THEN item_code ELSE item_code2 END,
    CASE WHEN NOT m THEN d2 ELSE joined END, CASE WHEN NOT m THEN noise2 ELSE regexp_full_match(joined, '\d{1,15}|(\[\s*\]\s*)*') END, CASE WHEN m THEN brings OR brings2 ELSE brings2 END,
    CASE WHEN m THEN coalesce(total_quantity, q2) ELSE q2 END, CASE WHEN m THEN coalesce(unit_price_rmb, p2) ELSE p2 END, CASE WHEN m THEN coalesce(total_amount_rmb, a2) ELSE a2 END,
    CASE WHEN m THEN coalesce(remarks || ';', r2 || ';', '') || 'repair:merged_continuation_row' ELSE r2 END, CASE WHEN m THEN coalesce(material, m2) ELSE m2 END
  FROM (
    SELECT s.* EXCLUDE (line_no), n.line_no, n.item_id AS item_id2, n.marks AS marks2, n.item_code AS item_code2, n.d AS d2, n.noise AS noise2, n.brings AS brings2, n.total_quantity AS q2, n.unit_price_rmb AS p2, n.total_amount_rmb AS a2, n.remarks AS r2, n.material AS m2,
      CASE WHEN n.noise OR contains(s.d, left(n.d, 24)) THEN s.d WHEN s.d = '' THEN n.d ELSE s.d || ' ' || n.d END AS joined,
      s.item_code = n.item_code AND (s.marks = '' OR n.marks = '' OR s.marks = n.marks) AND CASE
        WHEN n.d <> '' AND n.noise AND n.brings AND s.total_quantity > 0 AND s.unit_price_rmb > 0 AND s.total_amount_rmb > 0 AND length(s.d) >= 4 THEN false
        WHEN n.d <> '' AND n.noise AND n.brings AND (length(s.d) >= 6 AND NOT s.noise OR length(s.d) < 4 OR NOT s.brings) THEN true
        WHEN length(s.d) < 4 AND length(n.d) >= 6 AND NOT n.noise THEN true
        ELSE length(s.d) >= 6 AND NOT s.brings AND n.brings AND (n.noise OR length(n.d) < 4) END AS m
    FROM steps s JOIN noise n ON n.document_id = s.document_id AND n.line_no = s.line_no + 1)),
last AS (SELECT document_id, g, max(line_no) AS line_no FROM steps GROUP BY 1, 2)
SELECT item_id, nullif(d, '') AS description, total_quantity, unit_price_rmb, total_amount_rmb, material, remarks FROM steps JOIN last USING (document_id, g, line_no)"""


@query(CONTINUATIONS)
def continuation_merge(spark: SparkSession, d: str) -> DataFrame:
    n, supplier = F.col("line_no"), F.col("supplier_id")
    kind = (F.col("product_id") + n) % 6
    rows = C.items(spark, d).select(
        "document_id", "item_id", "line_no", F.when(supplier % 5 == 0, "").when(supplier % 5 == 1, "M1").otherwise("M").alias("marks"), F.concat(F.lit("K "), supplier % 2).alias("item_code"),
        F.when(kind == 1, "22").when(kind == 2, "[ ] []").when(kind == 3, "ab").when(kind > 3, F.col("description")).alias("description"),
        F.when(n % 3 != 1, F.col("total_quantity")).alias("total_quantity"), F.when(n % 4 != 2, F.col("unit_price_rmb")).alias("unit_price_rmb"), F.when(n % 5 != 3, F.col("total_amount_rmb")).alias("total_amount_rmb"), "remarks", F.when(n % 2 == 0, F.col("material")).alias("material"),
    )
    # an empty description is none
    return O.continuations_merged(rows).select("item_id", F.nullif(F.trim("description"), F.lit("")).alias("description"), "total_quantity", "unit_price_rmb", "total_amount_rmb", "material", "remarks")
