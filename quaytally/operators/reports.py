"""Report aggregates over items and documents: totals, reconciliation, sections, compiled products, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.functions.text import base_name

METRICS = ("total_cartons", "total_quantity", "total_cbm", "total_weight_kg", "total_amount_rmb")
# Item codes of synthetic rows, tolerances by purpose (cartons, cbm, kg, amount).
SENTINELS = ("__FULL_EXTRACT__", "__SECTION_SUBTOTAL__", "__FOOTER__")
TOLERANCE_EXTRACT = (2, 0.5, 5, 100)
TOLERANCE_GATE = (0.5, 0.05, 1, 5)
TOLERANCE_REPAIR = (3, 0.02, 1, 1)


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def sums(df: DataFrame, *keys: str, when: Column | None = None) -> DataFrame:
    """Sums of the metrics by keys; null counts as 0, as does a row that `when` leaves out."""
    value = (lambda c: zero(c)) if when is None else (lambda c: F.when(when, zero(c)).otherwise(F.lit(0)))
    return df.groupBy(*keys).agg(*(F.sum(value(c)).alias(c) for c in METRICS))


def live(items: DataFrame) -> DataFrame:
    """Items that count: neither deleted nor synthetic."""
    return items.where(~F.col("deleted") & ~F.coalesce(F.col("item_code").isin(*SENTINELS), F.lit(False)))


def document_totals(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Live totals of each document with its printed amount; a null printed amount matches.

    Documents without a live item keep null totals."""
    computed = sums(live(items), "document_id").withColumnRenamed("total_amount_rmb", "computed_amount")
    diff = F.col("computed_amount") - F.col("printed_amount")
    return documents.join(computed, "document_id", "left").withColumn("amount_diff", diff).withColumn("totals_match", F.col("printed_amount").isNull() | F.coalesce(diff == 0, F.lit(False)))


def item_statistics(items: DataFrame) -> DataFrame:
    """Row count, rows by section and five sums in one pass."""
    section = F.coalesce(F.col("section"), F.lit("shipped"))
    counts = [F.count_if(section == s).alias(f"n_{s}") for s in ("shipped", "left_in_warehouse", "repacked", "other")]
    return items.agg(F.count(F.lit(1)).alias("n_items"), *counts, *(F.sum(zero(c)).alias(c) for c in METRICS))


def physical_totals(items: DataFrame) -> DataFrame:
    """Cartons, volume and weight without goods left in the warehouse; quantity and amount with them.

    A null section counts in neither physical sum, as in SQL."""
    physical = F.col("section") != "left_in_warehouse"
    part = [F.sum(F.when(physical, zero(c)).otherwise(0)).alias(c) for c in ("total_cartons", "total_cbm", "total_weight_kg")]
    return items.groupBy("document_id").agg(*part, *(F.sum(zero(c)).alias(c) for c in ("total_quantity", "total_amount_rmb")))


def section_groups(items: DataFrame) -> DataFrame:
    """Subtotals by document, section and label, with the first line and the section's rank.

    Where a document has a named shipped block, its unnamed shipped rows are NEW ORDERS."""
    named = F.max(F.when((F.col("section") == "shipped") & F.col("label").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("document_id"))
    label = F.coalesce(F.col("label"), F.when((F.col("section") == "shipped") & (F.col("named") == 1), "NEW ORDERS"), F.upper(F.col("section")))
    rank = F.when(F.col("section") == "shipped", 0).when(F.col("section") == "repacked", 1).when(F.col("section") == "left_in_warehouse", 2).otherwise(3)
    rows = items.withColumn("named", named).withColumn("title", label).withColumn("section_rank", rank)
    return rows.groupBy("document_id", "section", "section_rank", "title").agg(F.count(F.lit(1)).alias("n_items"), F.min("line_no").alias("first_line"), *(F.sum(zero(c)).alias(c) for c in METRICS))


def compiled_products(items: DataFrame, keys: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """Products of one base name and packing (or, without packing, quantity) as one row.

    The first row in (line_no, item_id) order gives the other columns. Volume is rounded to 4 places
    after the sum; exact=True rounds after each addition, in row order. Repacked rows compile apart,
    rows without a name stay single. Rows are numbered by first appearance, singles after groups,
    the repacked block after the other."""
    name = F.coalesce(F.col("description"), F.lit(""))
    packing = F.lower(F.trim(F.coalesce(F.col("packaging"), F.lit(""))))
    base = base_name(name)
    key = (
        F.when(name == "", F.concat(F.lit("single||"), F.col("item_id")))
        .when(packing != "", F.concat(F.lower(base), F.lit("||pack||"), packing))
        .when(zero("total_quantity") > 0, F.concat(F.lower(base), F.lit("||no_pack_qty||"), F.col("total_quantity").cast("string")))
        .otherwise(F.concat(F.lower(base), F.lit("||no_pack_no_qty")))
    )
    rows = items.select("*", (F.col("section") == "repacked").alias("is_repacked"), base.alias("base"), key.alias("group_key"), (name == "").alias("is_single"))
    place = F.struct("line_no", "item_id")
    first = F.min_by(F.struct("item_id", "marks", "item_code", "base", "packaging"), place)
    cbm = F.sum(zero("total_cbm"))
    if exact:
        volumes = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "item_id", zero("total_cbm").alias("v")))), lambda r: r["v"].cast("decimal(18,6)"))
        cbm = F.aggregate(volumes, F.lit(0).cast("decimal(18,6)"), lambda acc, v: F.round(acc + v, 4).cast("decimal(18,6)"))
    groups = rows.groupBy(*keys, "is_repacked", "is_single", "group_key").agg(
        first.alias("first"),
        F.min(place).alias("place"),
        F.count(F.lit(1)).alias("variants"),
        F.sum(zero("total_cartons")).alias("cartons"),
        F.sum(zero("total_quantity")).alias("quantity"),
        F.round(cbm, 4).alias("cbm"),
        F.round(F.sum(zero("total_weight_kg")), 1).alias("weight_kg"),
        F.sum(zero("total_amount_rmb")).alias("amount_rmb"),
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("is_repacked", "is_single", "place"))
    return groups.select(*keys, "is_repacked", number.cast("long").alias("row_no"), *(F.col(f"first.{c}").alias(c) for c in ("item_id", "marks", "item_code", "base", "packaging")), "variants", "cartons", "quantity", "cbm", "weight_kg", "amount_rmb")


def rounded(c: Column, places: int) -> Column:
    """Half away from zero on decimals."""
    return F.round(c, places)


def reconciliation_deltas(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Sums without goods left in the warehouse against the printed amount, and all sums against the stored ones."""
    left = F.col("section") == "left_in_warehouse"
    value = lambda c, keep: F.sum(F.when(keep, zero(c)).otherwise(0))
    totals = live(items).groupBy("document_id").agg(
        value("total_amount_rmb", ~left).alias("compiled_amount"),
        value("total_amount_rmb", left).alias("left_amount"),
        value("total_cartons", ~left).alias("compiled_cartons"),
        value("total_cartons", left).alias("left_cartons"),
        F.sum(zero("total_amount_rmb")).alias("stored_amount"),
    )
    return documents.join(totals, "document_id").select(
        "document_id",
        "compiled_cartons",
        "left_cartons",
        rounded(F.col("compiled_amount") - F.col("printed_amount"), 2).alias("footer_vs_compiled"),
        rounded(F.col("compiled_amount") + F.col("left_amount") - F.col("stored_amount"), 2).alias("combined_vs_stored"),
    )


def imported_and_live(items: DataFrame) -> DataFrame:
    """Imported totals (deleted rows too) and live totals by document and section, with the document's own row."""
    kept = ~F.col("deleted")
    return (
        items.rollup("document_id", "section")
        .agg(
            F.grouping_id().alias("level"),
            F.sum(zero("total_amount_rmb")).alias("imported_amount"),
            F.sum(F.when(kept, zero("total_amount_rmb")).otherwise(0)).alias("live_amount"),
            F.sum(zero("total_cartons")).alias("imported_cartons"),
            F.sum(F.when(kept, zero("total_cartons")).otherwise(0)).alias("live_cartons"),
        )
        .where("level < 3")
        .drop("level")
    )


def document_dashboard(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Lines, cartons and out-of-stock lines of each document."""
    out = (zero("total_cartons") == 0) & (zero("total_quantity") == 0)
    per = items.where(~F.col("deleted")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(zero("total_cartons")).alias("cartons"), F.count_if(out).alias("n_out_of_stock"))
    return documents.join(per, "document_id").select("document_id", "source_file_name", "n_lines", "cartons", "n_out_of_stock")


def container_code(items: DataFrame) -> DataFrame:
    """The most frequent family of marks of each document; of equals, the one seen first."""
    family = F.regexp_extract("marks", r"^([A-Za-z]+-\d+)", 1)
    counts = items.where(family != "").groupBy("document_id", family.alias("family")).agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))
    best = F.min_by(F.struct("family", "n_lines"), F.struct((-F.col("n_lines")).alias("n"), "first_line"))
    return counts.groupBy("document_id").agg(best.alias("best")).select("document_id", "best.family", "best.n_lines")


def stock_dashboard(products: DataFrame, movements: DataFrame, reorder_level: int) -> DataFrame:
    """Products, stock value, low stock, and movements of the seven days before the latest."""
    stock = products.agg(F.count(F.lit(1)).alias("n_products"), F.sum(F.col("quantity") * F.col("cost")).alias("stock_value"), F.count_if(F.col("quantity") <= reorder_level).alias("n_low_stock"))
    last = movements.agg(F.max("created_at").alias("last_at"))
    recent = movements.join(F.broadcast(last), F.col("created_at") >= F.col("last_at") - F.expr("interval 7 days")).agg(F.count(F.lit(1)).alias("n_movements_7d"))  # one row
    return stock.join(F.broadcast(recent))


def payments_fold(payments: DataFrame) -> DataFrame:
    """Of freight, credit and other, the last by date; of deposit and balance, the first dated one. Undated come last."""
    undated = F.col("payment_date").isNull()
    late = F.struct(undated.alias("undated"), "payment_date", "payment_id")
    last = lambda kind: F.max_by("amount_usd", F.when(F.col("payment_type") == kind, late)).alias(kind)
    first = lambda kind: F.min_by("amount_usd", F.when((F.col("payment_type") == kind) & ~undated, F.struct("payment_date", "payment_id"))).alias(kind)
    return payments.groupBy("document_id").agg(last("freight"), last("credit"), last("other"), first("deposit"), first("balance"))


def totals_synced(stored: DataFrame, items: DataFrame) -> DataFrame:
    """Stored totals with new values for documents that have a live item; the others keep theirs."""
    fresh = live(items).groupBy("document_id").agg(F.sum(zero("total_amount_rmb")).cast("double").alias("fresh"))
    rows = stored.join(fresh, "document_id", "left")
    return rows.select("document_id", F.coalesce("fresh", "computed_amount").alias("computed_amount"), F.col("fresh").isNotNull().alias("refreshed"))


def payment_rows(payments: DataFrame) -> DataFrame:
    """Payments as a document's footer shows them: label, value, highlight."""
    note, kind = F.trim(F.coalesce("note", F.lit(""))), F.coalesce("payment_type", F.lit(""))
    stated = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c))
    dated = kind.isin("deposit", "balance")
    # fixed values: what the footer calls its lines
    label = (
        F.when(kind == "freight", "YIWU-MOMBASA FREIGHT")
        .when(kind == "credit", "CREDIT SUPPORT TO MOMBASA")
        .when((kind == "other") & note.rlike("(?i)PIVOC"), "PIVOC")
        .when(kind == "other", F.coalesce(stated(note), F.lit("Other")))
        .when(dated & F.col("payment_date").isNotNull(), F.concat(F.date_format("payment_date", "dd/MM/yyyy"), F.lit(" PAYMENT")))
        .when(kind == "balance", "BALANCE PAYMENT")
        .when(kind == "deposit", "PAYMENT")
        .otherwise(F.coalesce(stated(note, kind), F.lit("Payment")))
    )
    return payments.withColumns({"label": label, "value": F.coalesce(T.usd(F.col("amount_usd")), F.lit("-")), "highlight": kind == "balance"})


def document_bundle(documents: DataFrame, totals: DataFrame, payments: DataFrame, raw: str = "raw") -> DataFrame:
    """Documents with their totals and payments. A total that is not stored is taken from the document's raw JSON.

    totals: document_id and the four total_ metrics; payments: document_id, payment_id, amount_usd."""
    metrics = ("total_cartons", "total_cbm", "total_weight_kg", "total_amount_rmb")
    paid = payments.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_payments"), F.sum("amount_usd").alias("paid_usd"))
    rows = documents.join(totals.select("document_id", *(F.col(m).alias(f"stored_{m}") for m in metrics)), "document_id", "left").join(paid, "document_id", "left")
    either = {m: F.coalesce(F.col(f"stored_{m}").cast("double"), F.get_json_object(raw, f"$.footer_totals.{m}").try_cast("double")) for m in metrics}
    return rows.withColumns(either).drop(*(f"stored_{m}" for m in metrics))


def compiled_blocks(rows: DataFrame, key: str = "document_id", repacked: str = "repacked") -> DataFrame:
    """Normal rows, a divider, repacked rows, numbered through (place); the divider only stands between rows of both kinds."""
    block = rows.withColumn("block", F.when(F.col("section") == repacked, 2).otherwise(0))
    both = block.groupBy(key).agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low = 0 and high = 2")
    divider = both.select(key, F.lit(1).alias("block"), F.lit(T.DIVIDERS[0]).alias("sku"))
    placed = Window.partitionBy(key).orderBy("block", "line_no")
    return block.unionByName(divider, allowMissingColumns=True).withColumn("place", F.row_number().over(placed).cast("long")).drop("block")


def merged_products(manual: DataFrame, linked: DataFrame) -> DataFrame:
    """Products entered by hand and those of documents, oldest first."""
    return manual.unionByName(linked, allowMissingColumns=True).orderBy("created_at", "product_id")


# Labels of the printed table, the metric of each and what stands around it.
LABELLED = {
    "T.CTN": ("total_cartons", "", "CTNS"), "T.QTY": ("total_quantity", "", "pcs"), "UNIT CBM": ("unit_cbm", "", "CBM"), "T.CBM": ("total_cbm", "", "CBM"), "UNIT WEIGHT": ("unit_weight_kg", "", "KGS"), "T.WEIGHT": ("total_weight_kg", "", "KGS"),
    "U.PRICE (RMB)": ("unit_price_rmb", "¥", ""), "T.AMOUNT": ("total_amount_rmb", "¥", ""),
}


def labelled_rows(items: DataFrame, *keep: str) -> DataFrame:
    """Items as the printed table has them, units and all; rows kept for review go. `keep`: columns to carry along."""
    shown = lambda c: F.regexp_replace(F.col(c).cast("double").cast("string"), r"\.0$", "")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = {"MARKS": F.coalesce("marks", "item_code", F.lit("")), "SHOP#": blank("shop"), "ITEM NO.": blank("line_no"), "DESCRIPTION OF GOODS": blank("description"), "PACKING": blank("packaging")}
    metrics = {k: F.coalesce(F.concat(F.lit(a), shown(c), F.lit(b)), F.lit("")) for k, (c, a, b) in LABELLED.items()}
    tags = {"__section": F.coalesce("section", F.lit("shipped")), "__section_label": T.section_label(F.col("remarks")), "REMARKS": blank("remarks")}
    rows = items.where(~F.coalesce(F.col("item_code").isin(*SENTINELS), F.lit(False)))
    return rows.select(*keep, *(v.alias(k) for k, v in (texts | metrics | tags).items()))
