"""Order-dependent operators: each works along the lines of one document (or the versions of one item).

Windows partition by document, item or product; groups are as large as one document is."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.functions.numbers import half_up
from quaytally.operators.reports import SENTINELS

LINES = ("line_no", "item_id")


def lines(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*LINES)


def up_to_here(*keys: str) -> Window:
    return lines(*keys).rowsBetween(Window.unboundedPreceding, 0)


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def section_filled(rows: DataFrame) -> DataFrame:
    """The last section header at or above a row decides its section; before the first it is shipped."""
    return rows.withColumn("section", F.coalesce(F.last("header_section", ignorenulls=True).over(up_to_here("document_id")), F.lit("shipped")))


def marks_filled(rows: DataFrame) -> DataFrame:
    """Marks carried down inside a block; a header or subtotal (`is_reset`) starts a new one. Rows of anonymous parts
    (`is_anonymous`, where there is such a column) take none."""
    block = F.sum(F.col("is_reset").cast("int")).over(up_to_here("document_id"))
    keeps = F.col("is_reset") | F.coalesce("is_anonymous", F.lit(False)) if "is_anonymous" in rows.columns else F.col("is_reset")
    filled = F.last(F.nullif("marks", F.lit("")), ignorenulls=True).over(up_to_here("document_id", "block"))
    return rows.withColumn("block", block).withColumn("marks", F.when(keeps, F.col("marks")).otherwise(filled)).drop("block")


def same_line(a: Column, b: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


DUPLICATE_KEYS = ("marks", "item_code", "description", "shop", "total_cartons", "total_quantity", "unit_price_rmb", "total_amount_rmb", "total_cbm", "total_weight_kg")
#: Largest difference in volume of two quantity tiers of one carton.
TIER_CBM = 0.02


def cartons_deduplicated(items: DataFrame) -> DataFrame:
    """Shipped rows that repeat the row above have their cartons counted there: cartons 0 and a tag.

    A row is held against the row above as the pass has left it, so of a run of equal rows every second
    one is zeroed, and a row with 0 cartons that equals a zeroed row is tagged. Whether a row matches
    depends on the row above being zeroed or not: rows where it makes no difference settle the state,
    rows that match only an unzeroed row turn it round, and the others keep it. So the state is that of
    the last settling row, turned round once for each turning row since."""
    rows = items.withColumn("before", F.lag(F.struct("section", *DUPLICATE_KEYS)).over(lines("document_id")))
    before = F.col("before")
    shipped = (T.canonical_section(F.col("section")) == "shipped") & before.isNotNull() & (T.canonical_section(before["section"]) == "shipped")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    named = (T.text("marks") != "") | (T.text("item_code") != "")
    other_keys = tuple(k for k in DUPLICATE_KEYS if k != "total_cartons")
    same = named & same_line(before, F.struct(*other_keys), other_keys)
    shops = (T.text(before["shop"]) == "") | (T.text("shop") == "") | (T.text(before["shop"]) == T.text("shop"))
    cbm, cbm_before = number(F.col("total_cbm")), number(before["total_cbm"])
    near = F.abs(cbm - cbm_before) <= TIER_CBM
    described, described_before = T.text("description"), T.text(before["description"])
    unmarked = (described == "") | ((described_before != "") & ((described == described_before) | ((cbm > 0) & (cbm_before > 0) & near)))
    spanned = (T.text(before["marks"]) != "") & shops & F.when(T.text("marks") == "", unmarked).otherwise((T.text("marks") == T.text(before["marks"])) & (described == "") & (described_before != ""))
    tier_keys = ("marks", "item_code", "description", "shop")
    differs = F.coalesce(before["total_quantity"] != F.col("total_quantity"), F.lit(False)) | F.coalesce(before["total_amount_rmb"] != F.col("total_amount_rmb"), F.lit(False))
    tier = (T.text("marks") != "") & same_line(before, F.struct(*tier_keys), tier_keys) & near & differs
    both = (number(F.col("total_cartons")) > 0) & (number(before["total_cartons"]) > 0)
    if_left = F.coalesce(shipped & ((same & F.col("total_cartons").eqNullSafe(before["total_cartons"])) | (both & (spanned | tier))), F.lit(False))
    if_zeroed = F.coalesce(shipped & same & (F.col("total_cartons") == 0), F.lit(False))
    rows = rows.withColumns({"if_left": if_left, "if_zeroed": if_zeroed})
    rows = rows.withColumn("island", F.sum((F.col("if_left") == F.col("if_zeroed")).cast("int")).over(up_to_here("document_id")))
    settled = F.first("if_left").over(up_to_here("document_id", "island"))
    turns = F.sum((F.col("if_left") & ~F.col("if_zeroed")).cast("int")).over(up_to_here("document_id", "island"))
    zeroed = (settled.cast("int") + turns) % 2 == 1
    rows = rows.withColumn("zeroed", zeroed)
    return rows.withColumns(
        {
            "total_cartons": F.when(F.col("zeroed"), F.lit(0)).otherwise(F.col("total_cartons")).cast(dict(items.dtypes)["total_cartons"]),
            "remarks": F.when(F.col("zeroed"), T.with_remark(F.col("remarks"), "carton_dedup:secondary_row", " ")).otherwise(F.col("remarks")),
        }
    ).drop("before", "if_left", "if_zeroed", "island", "zeroed")


def first_seen(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Of rows that agree in the keys (null is a value), the first."""
    window = Window.partitionBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(window)).where("n = 1").drop("n")


def overflow_reconciled(items: DataFrame, footers: DataFrame, least_pieces: int = 24, least_reduction: int = 4) -> DataFrame:
    """Inflated carton counts are reduced while the document has more cartons than its footer.

    Candidates go by reduction and line, largest first; one that is larger than what is left is
    skipped, later ones may fit. footers: document_id, footer_cartons. Returns document_id, item_id, new_cartons."""
    cartons, qty, per = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("total_cartons", "total_quantity", "qty_per_carton"))
    share = qty / F.nullif(per, F.lit(0.0))
    whole = half_up(share).cast("double")
    good = (cartons > 0) & (qty > 0) & (per >= least_pieces) & (whole > 0) & (F.abs(share - whole) <= 0.02) & (cartons - whole >= least_reduction)
    rows = items.select("document_id", "item_id", "line_no", cartons.alias("cartons"), whole.alias("whole"), good.alias("good"))
    per_doc = rows.groupBy("document_id").agg(F.sum("cartons").alias("cartons")).join(footers, "document_id").where(F.col("footer_cartons") > 0)
    over = per_doc.select("document_id", (F.col("cartons") - F.col("footer_cartons")).alias("overflow")).where("overflow > 0")
    candidates = rows.where("good").withColumn("reduction", F.col("cartons") - F.col("whole")).join(over, "document_id").select("document_id", "item_id", "line_no", "whole", "reduction", "overflow")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of one document after another, in order: those that fit into what is left of its overflow."""
        document, left = None, 0.0
        for batch in batches:
            fits = []
            for own, reduction, overflow in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5))):
                if own != document:
                    document, left = own, overflow
                fits.append(reduction <= left)
                left -= reduction if reduction <= left else 0.0
            yield batch.select(["document_id", "item_id", "whole"]).filter(pa.array(fits, pa.bool_()))

    order = candidates.repartition("document_id").sortWithinPartitions("document_id", F.desc("reduction"), F.desc("line_no"), "item_id")
    types = dict(candidates.dtypes)
    return order.mapInArrow(take, f"document_id {types['document_id']}, item_id {types['item_id']}, whole double").withColumnRenamed("whole", "new_cartons")


#: Seconds of a product's movements that one task puts in order.
SLICE_SECONDS = 7 * 86_400


def running_stock(movements: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Quantity after each movement: in adds, out subtracts, an adjustment sets.

    A product's movements are cut into slices of time, so that a product with a great share of all is spread over
    tasks. A slice is summed up as what its last adjustment sets (if it has one) and what is added since; sums over
    slices, which start anew at those with an adjustment, say what a slice begins with."""
    at = F.coalesce(F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / slice_seconds), F.lit(-(1 << 62)))
    rows = movements.withColumn("__slice", at)
    here = Window.unboundedPreceding, Window.currentRow
    order = Window.partitionBy("product_id", "__slice").orderBy("created_at", "movement_id").rowsBetween(*here)
    signed = F.when(F.col("movement_type") == "out", -F.col("quantity")).otherwise(F.col("quantity"))
    rows = rows.withColumn("__segment", F.count(F.when(F.col("movement_type") == "adjustment", 1)).over(order))
    inside = Window.partitionBy("product_id", "__slice", "__segment").orderBy("created_at", "movement_id").rowsBetween(*here)
    rows = rows.withColumn("__own", F.sum(signed).over(inside))
    last = F.max_by(F.struct("__segment", "__own"), F.struct("created_at", "movement_id")).alias("last")
    slices = rows.groupBy("product_id", "__slice").agg(last)
    over = Window.partitionBy("product_id").orderBy("__slice")
    slices = slices.withColumn("__part", F.sum((F.col("last.__segment") > 0).cast("int")).over(over))
    total = F.sum("last.__own").over(Window.partitionBy("product_id", "__part").orderBy("__slice").rowsBetween(*here))
    slices = slices.withColumn("__total", total).select("product_id", "__slice", F.coalesce(F.lag("__total").over(over), F.lit(0)).alias("__before"))
    joined = rows.join(slices.withColumnsRenamed({"product_id": "__product", "__slice": "__at"}), F.col("product_id").eqNullSafe(F.col("__product")) & (F.col("__slice") == F.col("__at")))
    stock = F.col("__own") + F.when(F.col("__segment") == 0, F.col("__before")).otherwise(0)
    return joined.select(*movements.columns, stock.alias("stock"))


def version_changes(versions: DataFrame, key: str, watched: tuple[str, ...]) -> DataFrame:
    """A row per version that differs from the one before in a watched column or in being deleted.

    Actions: delete, restore, update; old and new values as maps of the watched columns that differ."""
    order = Window.partitionBy(key).orderBy("version")
    rows = versions.withColumn("before", F.lag(F.struct(*watched, "deleted")).over(order)).where("before is not null")
    differs = [~F.col(c).eqNullSafe(F.col(f"before.{c}")) for c in watched]
    action = F.when(F.col("deleted") & ~F.col("before.deleted"), "delete").when(~F.col("deleted") & F.col("before.deleted"), "restore").when(T.any_of(differs), "update")
    pairs = lambda prefix: F.map_from_entries(F.array_compact(F.array(*(F.when(d, F.struct(F.lit(c), F.col(prefix + c).cast("string"))) for c, d in zip(watched, differs)))))
    return rows.withColumn("action", action).where("action is not null").select(key, "version", "action", pairs("before.").alias("old_values"), pairs("").alias("new_values"))


def originals_frozen(versions: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    first = Window.partitionBy(key).orderBy("version").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return versions.withColumns({f"original_{c}": F.first(c, ignorenulls=True).over(first) for c in columns})


def note_target(changes: DataFrame, key: str) -> DataFrame:
    """The latest change without a note of each item."""
    return changes.where("note is null").groupBy(key).agg(F.max("change_id").alias("change_id"))


def latest(rows: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")


def until_boundary(rows: DataFrame) -> DataFrame:
    """Rows from the first repacked header of a document on go; goods-left headers go alone."""
    seen = F.max((F.col("header") == "repacked").cast("int")).over(up_to_here("document_id"))
    return rows.withColumn("seen", F.coalesce(seen, F.lit(0))).where("seen = 0 and (header is null or header <> 'goods_left')").drop("seen")


# The columns of a sales row that a continuation completes, and the remark that says so.
JOINED = ("description", "product_name_local")
NAMED = ("delivery_no", "customer_item_ref", "unit", "material")
KEPT = ("packaging", "barcode", "warehouse", "shop", "source_cells")
NUMBERS = ("qty_per_carton", "total_cartons", "total_quantity", "unit_price_rmb", "total_amount_rmb", "dim_l_cm", "dim_w_cm", "dim_h_cm", "unit_cbm", "total_cbm", "unit_weight_kg", "total_weight_kg")
MERGED_TAG = "repair:merged_continuation_row"
METRICS = ("total_quantity", "total_amount_rmb", "unit_price_rmb")


def item_key(code: Column) -> Column:
    """An item code without spaces and signs; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(T.text(code)), "[^A-Z0-9-]", ""), F.lit(""))


def _stripped(v) -> str:
    return "" if v is None or v != v else str(v).strip()


def _number(v) -> float:
    return 0.0 if v is None or v != v else float(v)


def _is_noise(text: str) -> bool:
    """Whether a description is a stray number or empty brackets."""
    return re.fullmatch(r"\d{1,15}|(?:\[\s*\]\s*)*", " ".join(text.split())) is not None


def continues(above: dict, row: dict) -> bool:
    """Whether a row of the same item goes on with the row above: it brings the title, or the numbers, that are missing there."""
    marks = {_stripped(above.get("marks")), _stripped(row.get("marks"))} - {""}
    if len(marks) > 1:
        return False
    title, more = _stripped(above["description"]), _stripped(row["description"])
    had, brings = (any(_number(r[c]) > 0 for c in METRICS) for r in (above, row))
    noise = _is_noise(more)
    if more and noise and brings:
        if all(_number(above[c]) > 0 for c in METRICS) and len(title) >= 4:
            return False
        if (len(title) >= 6 and not _is_noise(title)) or len(title) < 4 or not had:
            return True
    if len(title) < 4 and len(more) >= 6 and not noise:
        return True
    return len(title) >= 6 and not had and brings and (noise or len(more) < 4)


def completed(above: dict, row: dict) -> dict:
    """The row above with what the continuation adds."""
    out = dict(above)
    for c in set(JOINED) & set(row):
        a, b = _stripped(above[c]), _stripped(row[c])
        adds = b and not _is_noise(b) and b[:24] not in a
        out[c] = (" ".join(f"{a} {b}".split()) if a and adds else b if adds else a) or None
    for c in set(NAMED) & set(row):
        out[c] = _stripped(above[c]) or _stripped(row[c]) or None
    for c in set(KEPT) & set(row):
        out[c] = row[c] if above[c] is None else above[c]
    for c in set(NUMBERS) & set(row):
        first, second = above[c], row[c]
        out[c] = first if _number(first) > 0 or (_number(second) <= 0 and first == first and first is not None) else second
    code = next((x for r in (above, row) for x in (_stripped(next((r[c] for c in ("source_item_no", "item_code") if r.get(c) is not None), "")),) if x), None)
    out |= {c: code for c in ("item_code", "source_item_no") if c in row}
    old = above["remarks"] or row["remarks"]
    return out | {"remarks": f"{old};{MERGED_TAG}" if old else MERGED_TAG}


def continuations_merged(rows: DataFrame) -> DataFrame:
    """Fragments of an item that stand in the row below it are folded into it.

    Each fragment is held against the row as merged so far, so a stretch of rows of one item goes row by row;
    rows without a neighbour of their item pass as they are. Needs marks, item_code, description, remarks and the
    three metrics; the other columns of a sales row are completed where there are some."""
    source = F.col("source_item_no") if "source_item_no" in rows.columns else F.lit(None).cast("string")
    synthetic = F.coalesce(F.trim("item_code").isin(*SENTINELS), F.lit(False)) | T.text("remarks").contains("full_extract:")
    key = F.when(~synthetic, item_key(F.coalesce(source, "item_code")))
    doc = lines("document_id")
    keyed = rows.withColumns({c: F.col(c).cast("double") for c in NUMBERS if c in rows.columns}).withColumn("__key", key)
    keyed = keyed.withColumn("__new", ~F.coalesce(F.col("__key") == F.lag("__key").over(doc), F.lit(False)))
    keyed = keyed.withColumn("__some", ~F.col("__new") | ~F.coalesce(F.lead("__new").over(doc), F.lit(True)))
    names = rows.columns

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict | None = None
        for frame in frames:
            yield frame.loc[~frame["__some"], names]
            out = []
            for row in frame[frame["__some"]].to_dict("records"):
                if above is not None and not row["__new"] and continues(above, row):
                    above = completed(above, row)
                    continue
                if above is not None:
                    out.append(above)
                above = row
            yield pd.DataFrame(out, columns=[*names, "__new"])[names]
        if above is not None:
            yield pd.DataFrame([above])[names]

    placed = keyed.repartition("document_id").sortWithinPartitions("document_id", *LINES).drop("__key")
    return placed.mapInPandas(fold, keyed.select(*names).schema)
