"""Parsed rows whose columns moved: each rule sees a row as one value and works from it as it came.

A row is a struct of ROW_FIELDS. A rule says when it holds, its tag, and the new values. The rules run one after another, as a
parsed table's rows go through them; a row for which none holds as it came stays as it is, and goes through none."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.functions.columns import bound
from quaytally.functions.numbers import half_up

#: Strings, then doubles.
ROW_FIELDS = (
    "marks", "item_code", "section", "packaging", "description", "remarks",
    "qty_per_carton", "total_cartons", "total_quantity", "unit_price_rmb", "total_amount_rmb", "dim_l_cm", "dim_w_cm", "dim_h_cm", "unit_cbm", "total_cbm", "unit_weight_kg", "total_weight_kg",
)
TEXT_FIELDS = ROW_FIELDS[:6]

# Sizes that give a moved column away.
LEAST_MOVED_PRICE, LEAST_MOVED_CARTONS, DIMENSIONS, MOVED_CBM, MOVED_WEIGHT, BOX_LEAK = 500, 100, (20, 200), (5, 80), (20, 600), 20
PAIRED_CARTONS, PAIRED_DIMENSIONS, PAIRED_GAP = 80, (20, 220), 8
CARTON_ONLY, CARTON_ONLY_PRICE = 80, 1000
MOST_QUANTITY_IN_DIMENSION = 5000
PIECES = r"(?i)(\d+(?:\.\d+)?)\s*pcs/ctn"
CARRIED_OVER, CARRYOVER_IGNORED = "carryover:before_goods", "repair:before_goods_amount_carryover_ignored"


def tagged(remarks: Column, tag: str) -> Column:
    return F.concat(F.coalesce(F.concat(F.nullif(remarks, F.lit("")), F.lit(";")), F.lit("")), F.lit(tag))


Rule = tuple[Column, str, dict[str, Column]]


def applied(rule: Callable[[Column], Rule]) -> Callable[[Column], Column]:
    """A row with new values and the remark where the rule, worked out once, holds; else the row as it is."""

    def run(r: Column) -> Column:
        some, tag, new = rule(r)
        new = new | {"remarks": tagged(r["remarks"], tag)}
        types = {f: "string" if f in TEXT_FIELDS else "double" for f in ROW_FIELDS}
        return F.when(some, F.struct(*((new[f].cast(t) if f in new else r[f]).alias(f) for f, t in types.items()))).otherwise(r)

    return run


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def pieces_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(T.text(text), PIECES, 1), F.lit("")).cast("double")


#: The columns that hold another's value in a row that moved by one, from the carton count on.
MOVED = {
    "total_amount_rmb": "unit_price_rmb", "unit_price_rmb": "total_weight_kg", "total_weight_kg": "unit_weight_kg", "unit_weight_kg": "total_cbm", "total_cbm": "unit_cbm", "unit_cbm": "dim_l_cm",
    "dim_l_cm": "dim_w_cm", "dim_w_cm": "dim_h_cm", "dim_h_cm": "total_quantity", "total_quantity": "total_cartons",
}


def moved_by_one(r: Column) -> dict[str, Column]:
    return {to: r[source] for to, source in MOVED.items()}


def classic(r: Column) -> Rule:
    """Packing holds the cartons, the description ends with the packing, and all columns between moved by one."""
    packed = T.packing_cartons(T.text(r["packaging"]))
    cartons, qty, price, amount = (zero(r[c]) for c in ("total_cartons", "total_quantity", "unit_price_rmb", "total_amount_rmb"))
    leaks = amount.between(0, BOX_LEAK)
    compact = leaks & zero(r["total_cbm"]).between(*MOVED_CBM) & zero(r["total_weight_kg"]).between(*MOVED_WEIGHT)
    paired = (cartons <= PAIRED_CARTONS) & qty.between(*PAIRED_DIMENSIONS) & (F.abs(cartons - qty) <= PAIRED_GAP) & leaks & (zero(r["unit_cbm"]) > 0) & (zero(r["unit_cbm"]) <= 2) & zero(r["total_cbm"]).between(*MOVED_CBM)
    # numbers first, here and in the rules below: texts are read only in rows whose numbers allow the rule
    some = (cartons > 0) & (qty > 0) & (price >= LEAST_MOVED_PRICE)
    some = some & ((cartons >= LEAST_MOVED_CARTONS) | (cartons > qty * 2) | paired) & (qty.between(*DIMENSIONS) | compact) & (((zero(r["dim_l_cm"]) > 0) & (zero(r["dim_l_cm"]) < 2)) | compact)
    some = some & ~((amount >= 1000) & (amount < price * 0.1)) & packed.isNotNull() & pieces_of(r["description"]).isNotNull()
    trailing = T.trailing_packing(T.text(r["description"]))
    new = moved_by_one(r) | {
        "packaging": F.coalesce(trailing, r["packaging"]), "description": F.when(trailing.isNotNull(), T.without_trailing_packing(r["description"])).otherwise(r["description"]),
        "qty_per_carton": F.coalesce(F.when(trailing.isNotNull(), pieces_of(trailing)), r["qty_per_carton"]), "total_cartons": packed,
    }
    return some, "repair:shifted_manifest_columns", new


def parts(r: Column) -> Rule:
    """Parts without a price whose volume and weight moved."""
    packed, trailing = T.packing_cartons(T.text(r["packaging"])), T.trailing_packing(T.text(r["description"]))
    some = (zero(r["total_cbm"]) >= 5) & (zero(r["unit_cbm"]) > 0) & (zero(r["total_weight_kg"]) == 0) & packed.isNotNull() & trailing.isNotNull() & T.text(r["description"]).rlike(r"(?i)FOOD\s+WARMER\s+PARTS")
    counted = (packed > 0) & (pieces_of(trailing) > 0) & (zero(r["total_quantity"]) < 80)
    new = {
        "packaging": trailing, "description": F.coalesce(T.without_trailing_packing(r["description"]), r["description"]), "total_cartons": packed, "total_quantity": F.when(counted, packed * pieces_of(trailing)).otherwise(r["total_quantity"]),
        "total_cbm": r["unit_cbm"], "unit_cbm": F.coalesce(r["dim_l_cm"], r["unit_cbm"]), "unit_weight_kg": r["total_cbm"], "total_weight_kg": r["unit_weight_kg"], "unit_price_rmb": F.lit(None).cast("double"), "total_amount_rmb": F.lit(None).cast("double"),
    }
    return some, "repair:shifted_manifest_parts_row", new


def carton_only(r: Column) -> Rule:
    """Packing holds the cartons and the description no packing: pieces a carton come from the quantity."""
    packed = T.packing_cartons(T.text(r["packaging"]))
    some = (zero(r["total_cartons"]) >= CARTON_ONLY) & (zero(r["unit_price_rmb"]) >= CARTON_ONLY_PRICE) & (zero(r["total_amount_rmb"]) <= 0) & zero(r["total_quantity"]).between(*PAIRED_DIMENSIONS) & (packed > 0)
    per = half_up(r["total_cartons"] / F.nullif(packed, F.lit(0.0)))
    new = moved_by_one(r) | {"total_cartons": packed, "qty_per_carton": F.when(per > 0, per.cast("double")).otherwise(r["qty_per_carton"]), "packaging": F.when(per > 0, F.concat(per.cast("long"), F.lit("pcs/ctn"))).otherwise(r["packaging"])}
    return some, "repair:shifted_manifest_carton_only_row", new


def ctn_packed(r: Column) -> Rule:
    """As carton_only, for small counts with a unit volume among the dimensions."""
    packed = T.packing_cartons(T.text(r["packaging"]))
    length, unit = zero(r["dim_l_cm"]), zero(r["unit_cbm"])
    some = zero(r["total_quantity"]).between(*PAIRED_DIMENSIONS) & (length > 0) & (length < 1) & (unit > 0) & (unit <= 2) & (zero(r["total_cbm"]) >= 5) & (zero(r["unit_weight_kg"]) >= 5) & (zero(r["total_amount_rmb"]) <= 0) & (packed > 0)
    kept = {c: v for c, v in moved_by_one(r).items() if c not in ("total_amount_rmb", "unit_price_rmb")}
    price = F.when((zero(r["unit_price_rmb"]) <= 0) & (zero(r["total_weight_kg"]) > 0), r["total_weight_kg"]).otherwise(r["unit_price_rmb"])
    return some, "repair:ctn_packed_shifted_row", kept | {"total_cartons": packed, "unit_price_rmb": price}


def cartons_from_packing(r: Column) -> Rule:
    """The quantity stands in the carton column as well."""
    packed, per = T.packing_cartons(T.text(r["packaging"])), pieces_of(r["description"])
    some = (zero(r["total_cartons"]) > 0) & (zero(r["total_quantity"]) == zero(r["total_cartons"])) & (packed > 0) & (per > 0) & (zero(r["total_cartons"]) == packed * per)
    return some, "repair:cartons_from_pack_when_qty_correct", {"total_cartons": packed}


def quantity_in_dimension(r: Column) -> Rule:
    """A missing quantity that stands in the height column, as price and amount confirm."""
    height, price, amount = (zero(r[c]) for c in ("dim_h_cm", "unit_price_rmb", "total_amount_rmb"))
    implied = half_up(amount / F.nullif(price, F.lit(0.0))).cast("double")
    some = (zero(r["total_quantity"]) <= 0) & (height > 0) & (price > 0) & (amount > 0) & (height == half_up(height)) & (height <= MOST_QUANTITY_IN_DIMENSION) & (implied > 0) & (F.abs(height - implied) <= 1)
    return some, "repair:sparse_qty_in_dim", {"total_quantity": implied, "dim_h_cm": F.lit(None).cast("double")}


MANIFEST_RULES = (classic, parts, carton_only, ctn_packed, cartons_from_packing)


def parsed_rows_repaired(rows: DataFrame, rules=(*MANIFEST_RULES, quantity_in_dimension), only: Column | None = None) -> DataFrame:
    """rows after the rules; with `only`, those alone for which it holds."""
    row = F.struct(*(F.col(f).cast("string" if f in TEXT_FIELDS else "double").alias(f) for f in ROW_FIELDS))
    repaired = reduce(bound, map(applied, rules), row)
    rest = [c for c in rows.columns if c not in ROW_FIELDS]
    # told outside of lambdas, as what stands in one is never generated code
    some = T.any_of([rule(row)[0] for rule in rules])
    row = F.when(some if only is None else only & some, repaired).otherwise(row)
    return rows.select(*rest, row.alias("__repaired")).select(*rest, "__repaired.*")


def carryover_amounts_dropped(items: DataFrame, before_goods: Column) -> DataFrame:
    """Goods from before lose their amount if they are marked as carried over, or if a shipped row above them in the
    document has it too (same marks and code, amounts within a hundredth)."""
    amount = F.coalesce(F.col("total_amount_rmb").cast("double"), F.lit(0.0))
    marked = F.lower(T.text("remarks")).contains(CARRIED_OVER)
    same = Window.partitionBy("document_id", F.trim(T.text("marks")), F.trim(T.text("item_code"))).orderBy(half_up(amount * 1000).cast("long")).rangeBetween(-9, 9)
    first_shipped = F.min(F.when(F.coalesce("section", F.lit("shipped")) == "shipped", F.col("line_no"))).over(same)
    return amounts_dropped(items, before_goods & (amount > 0) & (marked | F.coalesce(first_shipped < F.col("line_no"), F.lit(False))))


def amounts_dropped(items: DataFrame, gone: Column) -> DataFrame:
    """items without the amounts that are gone, with a remark."""
    rows = items.withColumn("__gone", F.coalesce(gone, F.lit(False)))
    amounts = F.when(~F.col("__gone"), F.col("total_amount_rmb"))
    remarks = F.when(F.col("__gone"), tagged(F.col("remarks"), CARRYOVER_IGNORED)).otherwise(F.col("remarks"))
    return rows.withColumns({"total_amount_rmb": amounts, "remarks": remarks}).drop("__gone")
