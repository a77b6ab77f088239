"""Row rules over items: flags, caps and repairs. Each takes and returns a DataFrame of items.

A repair reads the row as it came; rules that follow see its result. Remarks gain one tag per repair."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.functions.columns import bound, compiled
from quaytally.functions.numbers import half_up, loose_or_null, weight
from quaytally.operators.reports import TOLERANCE_EXTRACT, TOLERANCE_GATE, TOLERANCE_REPAIR, physical_totals, zero

# Largest plausible quantity, pieces a carton, unit price, amount and cartons of a line.
MAX_QUANTITY, MAX_PER_CARTON, MAX_PRICE, MAX_AMOUNT, MAX_CARTONS = 500_000, 20_000, 50_000, 50_000_000, 50_000
SQL_MAX_PRICE = 500_000


def number(c: str) -> Column:
    return F.col(c).cast("double")


def blank(c: str) -> Column:
    return T.text(c) == ""


def row_flags(items: DataFrame) -> DataFrame:
    """Flags, confidence and need of review of each row (5% amount check)."""
    qty, price, amount = number("total_quantity"), number("unit_price_rmb"), number("total_amount_rmb")
    anonymous = blank("item_code") & blank("marks")
    flags = F.array_compact(
        F.array(
            F.when(blank("description"), "missing description"),
            F.when(anonymous, "missing item code"),
            F.when(price < 0, "negative unit price"),
            F.when(amount < 0, "negative total amount"),
            F.when(number("total_cbm") < 0, "negative CBM"),
            F.when(number("total_weight_kg") < 0, "negative weight"),
            F.when((qty > 0) & (price > 0) & (F.abs(qty * price - amount) / (qty * price) > 0.05), "amount cross-check failed"),
        )
    )
    minus = F.size("flags") * 15 + F.when(blank("description"), 20).otherwise(0) + F.when(anonymous, 20).otherwise(0) + F.when(F.col("total_cbm").isNull(), 10).otherwise(0) + F.when(F.col("unit_price_rmb").isNull(), 10).otherwise(0)
    return items.withColumn("flags", flags).withColumn("confidence", F.greatest(F.lit(0), 100 - minus)).withColumn("needs_review", (F.col("confidence") < 80) | (F.size("flags") > 0))


def import_flags(items: DataFrame, require_packing: bool = True) -> DataFrame:
    """The seven flags of the import check (tolerance 2%, 5 at least)."""
    cartons, qty, price, amount = (F.coalesce(number(c), F.lit(0.0)) for c in ("total_cartons", "total_quantity", "unit_price_rmb", "total_amount_rmb"))
    return items.withColumn(
        "flags",
        F.array_compact(
            F.array(
                F.when(blank("description"), "missing_name"),
                F.when(blank("packaging") & F.lit(require_packing), "missing_packing"),
                F.when((qty > 0) & (cartons <= 0), "qty_without_cartons"),
                F.when((cartons > 0) & (qty <= 0), "cartons_without_qty"),
                F.when((price <= 0) & (amount > 0), "price_missing_but_amount_present"),
                F.when((qty == 0) & (cartons == 0), "zero_qty_and_zero_cartons"),
                F.when((qty > 0) & (price > 0) & (amount > 0) & (F.abs(qty * price - amount) > F.greatest(F.lit(5.0), qty * price * 0.02)), "amount_mismatch"),
            )
        ),
    )


CRITICAL = ("missing_name", "missing_packing", "amount_mismatch")


def import_quality(flagged: DataFrame, key: str = "document_id", review: float = 0.1, fail: float = 0.45) -> DataFrame:
    """Flagged and critical rows of each import, its score and what follows from them."""
    critical = F.exists("flags", lambda f: f.isin(*CRITICAL))
    counts = flagged.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("flags") > 0).alias("n_flagged"), F.count_if(critical).alias("n_critical"))
    flagged_share, critical_share = F.col("n_flagged") / F.col("n_rows"), F.col("n_critical") / F.col("n_rows")
    score = F.greatest(F.lit(0), half_up(100 - flagged_share * 35 - critical_share * 65)).cast("long")
    return counts.withColumn("quality_score", score).withColumn("should_review", (flagged_share >= review) | (F.col("n_critical") > 0)).withColumn("should_fail", critical_share >= fail)


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n_rows"))


def capped(items: DataFrame, max_price: int = MAX_PRICE) -> DataFrame:
    """Physically impossible numbers become null, with a remark."""
    limits = {"total_quantity": MAX_QUANTITY, "qty_per_carton": MAX_PER_CARTON, "unit_price_rmb": max_price, "total_amount_rmb": MAX_AMOUNT, "total_cartons": MAX_CARTONS}
    bad = {c: F.coalesce((F.col(c) < 0) | (F.col(c) > m), F.lit(False)) for c, m in limits.items()}
    some = T.any_of(list(bad.values()))
    qty = F.when(~bad["total_quantity"], F.col("total_quantity"))
    cartons = F.when(~bad["total_cartons"], F.col("total_cartons"))
    lost = some & qty.isNull() & (cartons > 10_000)
    new = {c: F.when(~b, F.col(c)) for c, b in bad.items()} | {"total_cartons": F.when(~F.coalesce(lost, F.lit(False)), cartons)}
    return items.withColumns(new | {"remarks": F.when(some, T.with_remark(F.col("remarks"), "repair:capped_absurd_ocr")).otherwise(F.col("remarks"))})


def sales_repaired(items: DataFrame) -> DataFrame:
    """Packing from quantity and cartons, price from amount, amount from quantity and price, in this order."""
    cartons, qty, amount = (F.coalesce(number(c), F.lit(0.0)) for c in ("total_cartons", "total_quantity", "total_amount_rmb"))
    per = qty / F.nullif(cartons, F.lit(0.0))
    bad = (F.trim(T.text("packaging")) != "") & ~T.text("packaging").rlike(r"\d") & (cartons > 0) & (qty > 0)
    whole = bad & (half_up(per) > 0) & (F.abs(per - half_up(per)) <= 0.02)
    rows = items.withColumns(
        {
            "packaging": F.when(whole, F.concat(half_up(per).cast("long"), F.lit("pcs/ctn"))).when(bad, F.lit(None)).otherwise(F.col("packaging")),
            "remarks": F.when(whole, T.with_remark(F.col("remarks"), "repair:packing_from_qty_cartons")).when(bad, T.with_remark(F.col("remarks"), "repair:drop_non_numeric_packing")).otherwise(F.col("remarks")),
        }
    )
    inferred = half_up(amount / F.nullif(qty, F.lit(0.0)) * 10000) / 10000
    no_price = (F.coalesce(number("unit_price_rmb"), F.lit(0.0)) <= 0) & (amount > 0) & (qty > 0) & (inferred > 0)
    rows = rows.withColumns({"unit_price_rmb": F.when(no_price, inferred).otherwise(number("unit_price_rmb")), "remarks": F.when(no_price, T.with_remark(F.col("remarks"), "repair:price_from_amount")).otherwise(F.col("remarks"))})
    price = F.coalesce(F.col("unit_price_rmb"), F.lit(0.0))
    no_amount = (amount <= 0) & (qty > 0) & (price > 0)
    return rows.withColumns({"total_amount_rmb": F.when(no_amount, half_up(qty * price * 100) / 100).otherwise(number("total_amount_rmb")), "remarks": F.when(no_amount, T.with_remark(F.col("remarks"), "repair:amount_from_qty_price")).otherwise(F.col("remarks"))})


def coherent(items: DataFrame) -> DataFrame:
    """Quantity from amount and price, missing amounts, and amounts that were borrowed from weight or volume."""
    qty, price, amount, cartons, per = (F.coalesce(number(c), F.lit(0.0)) for c in ("total_quantity", "unit_price_rmb", "total_amount_rmb", "total_cartons", "qty_per_carton"))
    share = amount / F.nullif(price, F.lit(0.0))
    inferred = F.when((amount > 0) & (price > 0) & (half_up(share) > 0) & (F.abs(share - half_up(share)) <= 0.02), half_up(share).cast("double"))
    rows = items.withColumn("total_quantity", F.when(inferred.isNotNull() & ((qty <= 0) | (qty > inferred * 2)), inferred).otherwise(number("total_quantity")))
    # from here on qty is the repaired one, as columns are read from `rows`
    ratio = qty / F.nullif(cartons * per, F.lit(0.0))
    plausible = (qty > 0) & ~((cartons > 0) & (per > 0) & ~ratio.between(0.8, 1.25))
    rows = rows.withColumn("total_amount_rmb", F.when((qty > 0) & (price > 0) & (amount <= 0) & plausible, half_up(qty * price * 100) / 100).otherwise(number("total_amount_rmb")))
    borrowed = (amount > 0) & (F.coalesce(F.abs(amount - number("total_weight_kg")) <= 0.2, F.lit(False)) | F.coalesce(F.abs(amount - number("total_cbm")) <= 0.02, F.lit(False)))
    expected = half_up(qty * price * 100) / 100
    severe = F.abs(amount - expected) > F.greatest(F.lit(5.0), expected * 0.25)
    return rows.withColumn("total_amount_rmb", F.when((qty > 0) & (price > 0) & ((amount <= 0) | (severe & borrowed & plausible)), expected).otherwise(F.col("total_amount_rmb")))


def carton_garbage_repaired(items: DataFrame, footers: DataFrame) -> DataFrame:
    """Glued carton counts replaced by quantity over pieces a carton, or dropped. footers: document_id, footer_cartons."""
    rows = items.join(footers.select("document_id", F.col("footer_cartons").cast("double").alias("footer")), "document_id", "left")
    cartons, per, qty, footer = number("total_cartons"), number("qty_per_carton"), number("total_quantity"), F.col("footer")
    bad_qty = F.coalesce((qty > MAX_QUANTITY) | (qty < 0), F.lit(False))
    bad_per = F.coalesce((per > MAX_PER_CARTON) | (per < 0), F.lit(False))
    share = qty / F.nullif(per, F.lit(0.0))
    inferred = F.when((per > 0) & (per <= 8000) & (qty > 0) & (share < 1e6) & (F.abs(share - half_up(share)) <= 0.051) & (half_up(share) > 0), half_up(share).cast("double"))
    far = F.coalesce((footer > 0) & (cartons > footer * 50), F.lit(False))
    huge = cartons >= 100_000
    odd = F.coalesce(((cartons >= 500) & (cartons > inferred * 12)) | ((cartons >= 2500) & (F.abs(cartons - inferred) > F.greatest(F.lit(100.0), inferred * 6))), F.lit(False))
    counted = F.coalesce(cartons > 0, F.lit(False)) & ~bad_qty & ~bad_per
    use = counted & inferred.isNotNull() & (footer.isNull() | (inferred <= F.greatest(footer * 3, F.lit(8000.0)))) & (huge | far | odd)
    drop = counted & ~use & (huge | far)
    tag = lambda t: T.with_remark(F.col("remarks"), t)
    return rows.withColumns(
        {
            "total_quantity": F.when(~bad_qty, F.col("total_quantity")),
            "qty_per_carton": F.when(~bad_per, F.col("qty_per_carton")),
            "total_cartons": F.when(bad_qty | bad_per | drop, F.lit(None)).when(use, inferred).otherwise(cartons),
            "remarks": F.when(bad_qty | bad_per, tag("repair:insane_qty_qpc_cleared")).when(use, tag("repair:ctn_from_tqty_qpc")).when(drop, tag("repair:ctn_garbage_cleared")).otherwise(F.col("remarks")),
        }
    ).drop("footer")


def without_phantom_cartons(items: DataFrame, least: int = 20, least_volume: float = 1e-6) -> DataFrame:
    """Shipped rows of many cartons but no volume and no weight have their quantity in the carton column."""
    none = lambda c: F.abs(F.coalesce(number(c), F.lit(0.0))) < least_volume
    phantom = (T.canonical_section(F.col("section")) == "shipped") & (zero("total_cartons") >= least) & none("total_cbm") & none("total_weight_kg")
    return items.withColumns({"total_cartons": F.when(phantom, F.lit(0)).otherwise(F.col("total_cartons")).cast("decimal(18,3)"), "remarks": F.when(phantom, T.with_remark(F.col("remarks"), "carton_dedup:qty_misread_as_ctn", " ")).otherwise(F.col("remarks"))})


def sections_continued(items: DataFrame) -> DataFrame:
    """Repacked rows with a manifest mark belong to the goods left in the warehouse."""
    mark = T.text("marks").rlike(r"(?i)\bMS-\s*\d") | T.text("description").rlike(r"(?i)\bMS-\d")
    moved = (F.col("section") == "repacked") & mark & ~T.text("marks").rlike(r"(?i)\b\d+-T-\d")
    return items.withColumn("section", F.when(moved, "left_in_warehouse").otherwise(F.col("section")))


def warehouse_zeroed(items: DataFrame) -> DataFrame:
    """Goods left in the warehouse take no room: cartons, volume and weight are 0, amounts stay."""
    left = F.coalesce(F.col("section") == "left_in_warehouse", F.lit(False))
    some = left & T.any_of([zero(c) != 0 for c in ("total_cartons", "total_cbm", "total_weight_kg")])
    new = {c: F.when(some, F.lit(0)).otherwise(F.col(c)).cast(dict(items.dtypes)[c]) for c in ("total_cartons", "total_cbm", "total_weight_kg")}
    return items.withColumns(new | {"remarks": F.when(some, T.with_remark(F.col("remarks"), "warehouse:physical_zeroed", " ")).otherwise(F.col("remarks"))})


def cartons_adjusted(items: DataFrame, deltas: DataFrame) -> DataFrame:
    """Cartons changed by deltas (item_id, delta); quantity, amount, volume and weight follow."""
    rows = items.join(deltas, "item_id")
    cartons, qty = F.coalesce(number("total_cartons"), F.lit(0.0)), F.coalesce(number("total_quantity"), F.lit(0.0))
    after = F.greatest(F.lit(0.0), cartons + F.col("delta"))
    printed = F.nullif(F.regexp_extract(T.text("packaging"), r"(?i)(\d+(?:\.\d+)?)\s*(?:PCS|PC|PIECES)?\s*(?:/\s*CTN|CTN)?", 1), F.lit("")).cast("double")
    per = F.when((cartons > 0) & (qty > 0), qty / cartons).otherwise(F.when(printed > 0, printed))
    new_qty = F.when(after <= 0, 0.0).when(per.isNotNull(), F.greatest(F.lit(0.0), half_up(per * after).cast("double"))).otherwise(qty)
    share = lambda c: number(c) / F.nullif(cartons, F.lit(0.0))
    return rows.select("item_id", after.alias("total_cartons"), new_qty.alias("total_quantity"), (half_up(number("unit_price_rmb") * new_qty * 100) / 100).alias("total_amount_rmb"), (half_up(share("total_cbm") * after * 10000) / 10000).alias("total_cbm"))


#: The metrics that a document prints at its end, with the names of its printed values.
FOOTER_METRICS = {"cartons": "total_cartons", "cbm": "total_cbm", "weight": "total_weight_kg", "amount": "total_amount_rmb"}


def computed_totals(items: DataFrame, everything: tuple[str, ...] = ("amount",)) -> DataFrame:
    """Sums of each document's metrics; those not in `everything` leave out what stays in the warehouse."""
    physical = F.coalesce(F.col("section"), F.lit("shipped")) != "left_in_warehouse"
    publishable = physical & (F.coalesce(F.col("section"), F.lit("shipped")) != "repacked")
    sums = {m: F.sum(zero(c) if m in everything else F.when(physical, zero(c)).otherwise(0)).cast("double") for m, c in FOOTER_METRICS.items()}
    return items.groupBy("document_id").agg(*(v.alias(m) for m, v in sums.items()), F.count_if(publishable).alias("n_publishable"), F.count(F.lit(1)).alias("n_rows"))


# What a difference is called.
MISMATCHES = {"cbm": "CBM mismatch", "weight": "Weight mismatch", "amount": "Amount mismatch", "cartons": "Carton count mismatch"}


def extraction_validated(items: DataFrame, footers: DataFrame) -> DataFrame:
    """Sums of each document against its footer. footers: document_id and footer_ of each metric (null: not printed).

    Volume and weight are not held against the footer where no row has any."""
    rows = footers.join(computed_totals(items), "document_id")
    tolerance = dict(zip(FOOTER_METRICS, TOLERANCE_EXTRACT))
    for m in FOOTER_METRICS:
        unknown = (F.col(m) <= 0) & (F.col(f"footer_{m}") > 0) if m in ("cbm", "weight") else F.lit(False)
        rows = rows.withColumn(f"{m}_diff", F.when(~unknown, half_up(F.abs(F.col(m) - F.col(f"footer_{m}")), 2)))
    off = lambda m: F.col(f"{m}_diff").isNotNull() & (F.abs(F.col(m) - F.col(f"footer_{m}")) > tolerance[m])
    few = (F.when(F.col("n_publishable") == 0, "No products extracted"), F.when(F.col("n_publishable") < 5, "Suspiciously few rows"))
    flags = F.array_compact(F.array(*(F.when(off(m), name) for m, name in MISMATCHES.items()), *few))
    return rows.withColumn("flags", flags).withColumn("totals_match", F.size("flags") == 0)


def import_gate(items: DataFrame, footers: DataFrame) -> DataFrame:
    """The strict gate before an import is published: as many rows as were read, all four footers, and each metric near its footer.

    footers: document_id, footer_ of each metric, rows_read. A footer that is not printed makes no difference, but the gate needs all."""
    rows = footers.join(computed_totals(items, tuple(FOOTER_METRICS)), "document_id")
    printed = [F.col(f"footer_{m}").isNotNull() for m in FOOTER_METRICS]
    near = [F.coalesce(F.abs(F.col(m) - F.col(f"footer_{m}")) <= most, F.lit(True)) for m, most in zip(FOOTER_METRICS, TOLERANCE_GATE)]
    every = lambda conditions: F.forall(F.array(*conditions), lambda c: c)
    rows = rows.select("document_id", (F.col("n_rows") == F.col("rows_read")).alias("rows_ok"), every(printed).alias("footers_present"), (T.any_of(printed) & every(near)).alias("totals_match"))
    return rows.withColumn("passes", F.col("rows_ok") & F.col("footers_present") & F.col("totals_match"))


def physical_totals_matched(items: DataFrame, printed: DataFrame) -> DataFrame:
    """Stored totals after goods left were taken out of cartons, volume and weight; what is not printed counts as 0."""
    rows = printed.join(physical_totals(items), "document_id")
    off = {m: F.col(c).cast("double") - F.coalesce(F.col(f"footer_{m}"), F.lit(0.0)) for m, c in FOOTER_METRICS.items()}
    near = [F.abs(v) <= most for v, most in zip(off.values(), TOLERANCE_REPAIR)]
    diffs = [F.round(v, 4 if m == "cbm" else 2).alias(f"{m}_diff") for m, v in off.items()]
    return rows.select("document_id", *FOOTER_METRICS.values(), *diffs, F.forall(F.array(*near), lambda c: c).alias("totals_match"))


def section_against_bars(items: DataFrame, bars: DataFrame) -> DataFrame:
    """Sums by section against the last printed bar of the section; goods left compare by amount only."""
    last = bars.groupBy("document_id", "section").agg(F.max_by("bar_amount", "bar_order").cast("double").alias("bar_amount"), F.max_by("bar_cartons", "bar_order").cast("double").alias("bar_cartons"))
    computed = items.groupBy("document_id", "section").agg(F.sum(zero("total_amount_rmb")).cast("double").alias("amount"), F.sum(zero("total_cartons")).cast("double").alias("cartons"))
    near = F.abs(F.col("amount") - F.col("bar_amount")) <= TOLERANCE_REPAIR[3]
    same = F.abs(F.col("cartons") - F.col("bar_cartons")) <= TOLERANCE_REPAIR[0]
    return computed.join(last, ["document_id", "section"]).withColumn("matches", near & ((F.col("section") == "left_in_warehouse") | same))


SHIFT_TAG = "repair:shifted_manifest_columns"


def shown(c: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def kilograms(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(shown(c), F.lit("KGS")))


#: A manifest row: strings, then doubles.
MANIFEST_FIELDS = ("sku", "description", "packing", "unit_weight", "total_weight", "remarks", "cartons", "quantity", "dim_l_cm", "dim_w_cm", "dim_h_cm", "unit_cbm", "cbm", "cost_price", "total_amount_rmb")
TEXT_FIELDS = MANIFEST_FIELDS[:6]


#: When a rule holds, and a row's new values.
Rule = tuple[Column, dict[str, Column]]


def replaced(rule: Callable[[Column], Rule]) -> Callable[[Column], Column]:
    """A row with new values where the rule, worked out once, holds; else the row as it is."""

    def run(r: Column) -> Column:
        some, new = rule(r)
        types = {f: "string" if f in TEXT_FIELDS else "double" for f in MANIFEST_FIELDS}
        return F.when(some, F.struct(*((new[f].cast(t) if f in new else r[f]).alias(f) for f, t in types.items()))).otherwise(r)

    return run


def shift_repaired(r: Column) -> Rule:
    """Rows whose columns moved by one, as their packing and the size of their numbers show.

    A row (MANIFEST_FIELDS) is repaired from its values as they came."""
    zero_ = lambda c: F.coalesce(r[c], F.lit(0.0))
    cartons_in_packing, trailing = T.packing_cartons(T.text(r["packing"])), T.trailing_packing(T.text(r["description"]))
    classic = (
        ((r["cartons"] >= 100) | (r["cartons"] > r["quantity"] * 2)) & r["quantity"].between(20, 200) & (zero_("dim_l_cm") > 0) & (zero_("dim_l_cm") < 2) & (zero_("cost_price") >= 500)
        & (zero_("total_amount_rmb") >= 0) & (zero_("total_amount_rmb") < 1000)
    )
    parts = (zero_("total_amount_rmb") > 0) & (zero_("total_amount_rmb") < 1000) & ((zero_("cbm") >= 5) | F.coalesce(weight(r["unit_weight"]) >= 200, F.lit(False)))
    # numbers first, here and in the rules below: texts are read only in rows whose numbers allow the rule
    some = F.coalesce((zero_("cartons") > 0) & (zero_("quantity") > 0) & (classic | parts) & cartons_in_packing.isNotNull() & trailing.isNotNull(), F.lit(False))
    price = F.coalesce(loose_or_null(r["total_weight"]), F.lit(0.0))
    unpriced = (T.text(r["sku"]) == "") & T.text(r["description"]).rlike(r"(?i)FOOD\s+WARMER\s+PARTS")
    amount = F.when(unpriced | ((price <= 0) & (zero_("total_amount_rmb") > 0)), F.lit(None)).otherwise(r["cost_price"])
    new = {
        "description": T.without_trailing_packing(r["description"]), "packing": trailing, "cartons": cartons_in_packing, "quantity": r["cartons"], "dim_h_cm": r["quantity"], "dim_w_cm": r["dim_h_cm"], "dim_l_cm": r["dim_w_cm"],
        "unit_cbm": r["dim_l_cm"], "cbm": r["unit_cbm"], "unit_weight": kilograms(r["cbm"]), "total_weight": r["unit_weight"], "cost_price": F.when(unpriced, F.lit(0.0)).otherwise(price), "total_amount_rmb": amount, "remarks": T.with_remark(r["remarks"], SHIFT_TAG),
    }
    return some, new


def no_packing_repaired(r: Column) -> Rule:
    """Rows without packing whose quantity, price and amount each stand one column early."""
    price = F.coalesce(loose_or_null(r["total_weight"]), F.lit(0.0))
    some = F.coalesce((r["cartons"] > 0) & (r["quantity"] <= 0) & (r["cost_price"] >= 1000) & r["total_amount_rmb"].between(100, 500) & (F.trim(T.text(r["packing"])) == "") & price.between(50, 1000), F.lit(False))
    new = {"cartons": F.lit(None).cast("double"), "quantity": r["cartons"], "cost_price": price, "total_amount_rmb": r["cost_price"], "remarks": T.with_remark(r["remarks"], "repair:no_packing_amount_row")}
    return some, new


def compact_repaired(r: Column) -> Rule:
    """Rows that give packing as a carton count or pieces a carton, with quantity and volume one column early."""
    packed, pieces, trailing = T.packing_cartons(T.text(r["packing"])), T.packing_pieces(T.text(r["packing"])), T.trailing_packing(T.text(r["description"]))
    had, qty, unit, price = (F.coalesce(r[c], F.lit(0.0)) for c in ("cartons", "quantity", "unit_cbm", "cost_price"))
    total_weight, amount = loose_or_null(r["total_weight"]), r["total_amount_rmb"]
    compact = (had > 0) & (qty > 0) & (qty < 5) & r["unit_cbm"].isNull() & amount.isNull() & (price >= 100) & packed.isNotNull() & trailing.isNotNull()
    early = (
        (qty > 0) & (qty <= 200) & (unit > 0) & (unit <= 5) & (F.coalesce(amount, F.lit(0.0)) <= 100) & ((price >= 500) | F.coalesce(total_weight.between(20, 600), F.lit(False)))
        & (F.coalesce(had > F.greatest(F.lit(20.0), packed * 2), F.lit(False)) | ((had > 0) & (had <= 20) & pieces.isNotNull()))
    )
    cartons = F.coalesce(packed, r["cartons"])
    quantity = F.when(pieces.isNotNull() & (cartons > 0), half_up(cartons * pieces).cast("double")).otherwise(had)
    volume = F.when(early, unit).otherwise(qty)
    paid = F.when(price > 0, price)
    inferred = F.when(total_weight > 0, total_weight).otherwise(half_up(paid / F.nullif(quantity, F.lit(0.0)) * 10000) / 10000)
    even = F.when((cartons > 0) & (quantity > 0) & (quantity % F.nullif(cartons, F.lit(0.0)) == 0), F.concat(shown(quantity / F.nullif(cartons, F.lit(0.0))), F.lit("pcs/ctn")))
    new = {
        "description": F.when(trailing.isNotNull(), F.coalesce(T.without_trailing_packing(r["description"]), r["description"])).otherwise(r["description"]),
        "packing": F.coalesce(trailing, F.when(pieces.isNotNull(), F.concat(shown(pieces), F.lit("pcs/ctn"))), even, r["packing"]), "cartons": cartons, "quantity": quantity, "unit_cbm": F.when((cartons > 0) & (volume > 0), half_up(volume / F.nullif(cartons, F.lit(0.0)) * 1e6) / 1e6), "cbm": volume,
        "unit_weight": F.coalesce(kilograms(r["cbm"]), r["unit_weight"]), "total_weight": F.coalesce(r["unit_weight"], r["total_weight"]), "cost_price": F.when(inferred > 0, inferred).otherwise(r["cost_price"]), "total_amount_rmb": paid,
        "dim_h_cm": F.when(early, r["quantity"]).otherwise(r["dim_h_cm"]), "dim_w_cm": F.when(early, r["dim_h_cm"]).otherwise(r["dim_w_cm"]), "dim_l_cm": F.when(early, r["dim_w_cm"]).otherwise(r["dim_l_cm"]), "remarks": T.with_remark(r["remarks"], "repair:compact_packed_shift_row_v2"),
    }
    return compact | early, new


def outliers_repaired(r: Column) -> Rule:
    """Rows whose packing is a carton count and whose quantity went to the cartons, or to a dimension."""
    packed = T.packing_cartons(T.text(r["packing"]))
    cartons, qty, cbm, price = (F.coalesce(r[c], F.lit(0.0)) for c in ("cartons", "quantity", "cbm", "cost_price"))
    unit_weight, total_weight = loose_or_null(r["unit_weight"]), loose_or_null(r["total_weight"])
    base = qty.between(20, 220) & (cbm >= 5) & r["total_amount_rmb"].isNull()
    moved = F.coalesce(base & (price >= 500) & (packed > 0) & (cartons > F.greatest(F.lit(20.0), packed * 2)), F.lit(False))
    single = F.coalesce(base & (cartons > 0) & (cartons <= 6) & (price > 0) & (packed > 0) & (F.abs(total_weight - price) <= 0.01), F.lit(False))
    some = moved | single
    volume = F.coalesce(r["unit_cbm"], r["cbm"])
    new = {
        "cartons": packed, "quantity": F.when(moved, cartons).otherwise(packed), "unit_cbm": half_up(volume / packed * 1e6) / 1e6, "cbm": volume, "unit_weight": F.when(cbm > 0, kilograms(cbm)).otherwise(r["unit_weight"]),
        "total_weight": F.when(unit_weight > 0, kilograms(unit_weight)).otherwise(r["total_weight"]), "cost_price": F.when(total_weight > 0, total_weight).otherwise(r["cost_price"]), "total_amount_rmb": F.when(price > 0, price).otherwise(r["total_amount_rmb"]),
        "remarks": T.with_remark(r["remarks"], "repair:manifest_outlier_shift"),
    }
    return some, new


def manifest_repaired(rows: DataFrame) -> DataFrame:
    """The chain of shift rules, run twice as imports do.

    Each rule sees the row as one value, so that a rule's result is worked out once. A row for which none holds as it came
    stays as it is, and goes through none."""
    compiled(rows.sparkSession)
    row = F.struct(*(F.col(f).cast("string" if f in TEXT_FIELDS else "double").alias(f) for f in MANIFEST_FIELDS))
    rules = (shift_repaired, no_packing_repaired, compact_repaired, outliers_repaired)
    repaired = reduce(bound, map(replaced, rules * 2), row)
    # told outside of lambdas, as what stands in one is never generated code
    row = F.when(T.any_of([rule(row)[0] for rule in rules]), repaired).otherwise(row)
    rest = [c for c in rows.columns if c not in MANIFEST_FIELDS]
    return rows.select(*rest, row.alias("row")).select(*rest, "row.*")
