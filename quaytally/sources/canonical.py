"""The canonical tables of the trade-document model, derived from the given tables.

`items` come from line items, `documents` from orders, `products` from parts, `movements` from events.
ITEMS_SQL, DOCUMENTS_SQL and MOVEMENTS_SQL state the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECTIONS = {"N": "shipped", "A": "left_in_warehouse", "R": "repacked"}
MOVEMENT_TYPES = {"purchase": "out", "signup": "in", "click": "adjustment"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of documents. Line numbers follow all columns of a line, so equal lines only tie with each other."""
    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type")
    cartons = F.ceil(F.col("l_quantity") / F.col("p_size"))
    section = F.when(F.col("l_returnflag") == "N", "shipped").when(F.col("l_returnflag") == "A", "left_in_warehouse").otherwise("repacked")
    return (
        lines.withColumn("line_no", F.row_number().over(order).cast("long"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            (F.col("l_orderkey") * 1000 + F.col("line_no")).alias("item_id"),
            F.col("l_orderkey").alias("document_id"),
            "line_no",
            F.concat(F.lit("MS-"), F.col("l_suppkey"), F.lit("-"), F.col("l_linenumber")).alias("marks"),
            F.concat(F.lit("P-"), F.col("l_partkey")).alias("item_code"),
            F.col("p_name").alias("description"),
            F.col("p_brand").alias("shop"),
            F.col("p_type").alias("material"),
            F.concat(F.col("p_size"), F.lit("pcs/ctn")).alias("packaging"),
            F.col("p_size").cast("decimal(18,3)").alias("qty_per_carton"),
            cartons.cast("decimal(18,3)").alias("total_cartons"),
            F.col("l_quantity").cast("decimal(18,3)").alias("total_quantity"),
            (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).cast("decimal(14,2)").alias("unit_price_rmb"),
            F.col("l_extendedprice").cast("decimal(16,2)").alias("total_amount_rmb"),
            (cartons * (F.col("l_linenumber") + 1) / 100).cast("decimal(12,6)").alias("total_cbm"),
            (F.col("l_quantity") * F.col("l_linenumber") / 4).cast("decimal(12,4)").alias("total_weight_kg"),
            section.alias("section"),
            F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), "carryover:before_goods").alias("remarks"),
            (F.col("l_discount") >= 0.1).alias("deleted"),
            F.col("l_shipdate").alias("shipped_at"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_tax").alias("tax"),
        )
    )


ITEMS_SQL = """
items AS (
  SELECT l.l_orderkey * 1000 + line_no AS item_id, l_orderkey AS document_id, line_no, 'MS-' || l_suppkey || '-' || l_linenumber AS marks, 'P-' || l_partkey AS item_code,
    p_name AS description, p_brand AS shop, p_type AS material, p_size || 'pcs/ctn' AS packaging, p_size::DECIMAL(18,3) AS qty_per_carton,
    ceil(l_quantity / p_size)::DECIMAL(18,3) AS total_cartons, l_quantity::DECIMAL(18,3) AS total_quantity,
    (floor(l_extendedprice / l_quantity * 100 + 0.5) / 100)::DECIMAL(14,2) AS unit_price_rmb, l_extendedprice::DECIMAL(16,2) AS total_amount_rmb,
    (ceil(l_quantity / p_size) * (l_linenumber + 1) / 100)::DECIMAL(12,6) AS total_cbm, (l_quantity * l_linenumber / 4)::DECIMAL(12,4) AS total_weight_kg,
    CASE l_returnflag WHEN 'N' THEN 'shipped' WHEN 'A' THEN 'left_in_warehouse' ELSE 'repacked' END AS section,
    CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'carryover:before_goods' END AS remarks,
    l_discount >= 0.1 AS deleted, l_shipdate AS shipped_at, l_partkey AS product_id, l_suppkey AS supplier_id, l_tax AS tax
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_no FROM lineitem) l
  JOIN part ON l_partkey = p_partkey
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order; a customer's orders share a file name, as re-imports do."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"),
        F.concat(F.lit("cust-"), F.col("o_custkey"), F.lit(".pdf")).alias("source_file_name"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").cast("decimal(16,2)").alias("printed_amount"),
        F.col("o_orderpriority").alias("priority"),
    )


DOCUMENTS_SQL = """
docs AS (
  SELECT o_orderkey AS document_id, 'cust-' || o_custkey || '.pdf' AS source_file_name, o_custkey AS client_id, o_orderstatus AS status, o_orderdate AS created_at,
    o_totalprice::DECIMAL(16,2) AS printed_amount, o_orderpriority AS priority
  FROM orders
)"""


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock movements by product, in order of (created_at, movement_id)."""
    kind = F.when(F.col("event_type") == "purchase", "out").when(F.col("event_type") == "signup", "in").otherwise("adjustment")
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin(*MOVEMENT_TYPES))
        .select(F.col("event_id").alias("movement_id"), F.col("user_id").alias("product_id"), kind.alias("movement_type"), F.col("value").cast("decimal(18,2)").alias("quantity"), F.col("ts").alias("created_at"))
    )


MOVEMENTS_SQL = """
movements AS (
  SELECT event_id AS movement_id, user_id AS product_id, CASE event_type WHEN 'purchase' THEN 'out' WHEN 'signup' THEN 'in' ELSE 'adjustment' END AS movement_type,
    value::DECIMAL(18,2) AS quantity, ts AS created_at
  FROM events WHERE event_type IN ('purchase', 'signup', 'click')
)"""


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for results that are compared with SQL."""
    return df.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))
