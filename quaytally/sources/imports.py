"""Imported rows as maps from header to cell, mapped to typed rows by tables of aliases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaytally.functions import numbers as N
from quaytally.functions import text as T
from quaytally.functions.columns import settled
from quaytally.operators import order, rules


@dataclass(frozen=True)
class Alias:
    """A field of a typed row: how its cell is read, and the keys that may hold it, in the order in which they count.

    `text`, `number` and `integer` read the first key that the row has. `first_number` goes on to the next key
    until one reads as a number. `otherwise` stands for a number that is missing."""

    kind: str
    keys: tuple[str, ...]
    otherwise: float | None = None


SALES, PACKING, PLAIN = "sales", "packing", "plain"

# What makes an import a packing list, and the keys of each layout's fields.
PACKING_KEYS = ("MARKS", "T.QTY", "U.PRICE (RMB)")
PRICE_KEYS = ("U.PRICE (RMB)", "U.PRICE(RMB)", "U.PRICE", "U/P", "UNIT PRICE", "UNIT_PRICE", "PRICE", "unit_price_rmb", "cost_price", "__col14", "__col13")
LAYOUTS: dict[str, dict[str, Alias]] = {
    SALES: {
        "sku": Alias("text", ("MARKS", "item_code", "SKU", "sku")), "source_item_no": Alias("text", ("ITEM NO.", "item_no", "NO.")), "name": Alias("text", ("DESCRIPTION OF GOODS", "description", "name", "Name")),
        "shop_name": Alias("text", ("SHOP#", "shop")), "packing": Alias("text", ("PACKING",)), "cartons": Alias("integer", ("T.CTN", "CTN", "total_cartons")), "quantity": Alias("integer", ("T.QTY", "QTY", "total_qty", "quantity"), 0),
        "unit_cbm": Alias("number", ("UNIT CBM", "unit_cbm")), "cbm": Alias("number", ("T.CBM", "CBM", "total_cbm")), "unit_weight": Alias("text", ("UNIT WEIGHT", "unit_weight")), "total_weight": Alias("text", ("T.WEIGHT", "total_weight")),
        "dim_l_cm": Alias("number", ("L", "l", "dim_l_cm")), "dim_w_cm": Alias("number", ("W", "w", "dim_w_cm")), "dim_h_cm": Alias("number", ("H", "h", "dim_h_cm")),
        "cost_price": Alias("first_number", PRICE_KEYS, 0), "total_amount_rmb": Alias("first_number", ("T.AMOUNT", "T.AMOUNT(RMB)", "AMOUNT", "total_amount_rmb", "__col15", "__col16", "__col14")),
        "warehouse": Alias("text", ("W.H.", "warehouse")), "remarks": Alias("text", ("REK", "remarks")), "barcode": Alias("text", ("CODE", "barcode")), "code": Alias("text", ("CODE", "code")), "photo": Alias("text", ("PHOTO", "photo")), "photo2": Alias("text", ("PHOTO2", "photo2")),
        "order_no": Alias("text", ("ORD NO.", "order_no")), "customer_no": Alias("text", ("CUS NO.", "customer_no")), "delivery_address": Alias("text", ("送货地址", "delivery_address")), "document_date": Alias("date", ("DATE", "date")),
        "section_label": Alias("text", ("__section_label",)), "selling_price": Alias("number", ("selling_price", "Selling Price"), 0), "reorder_level": Alias("integer", ("reorder_level", "Reorder Level"), 0),
    },
    PACKING: {
        "marks": Alias("text", ("MARKS",)), "goods": Alias("text", ("DESCRIPTION OF GOODS",)), "goods_too": Alias("text", ("__col6",)), "shop_name": Alias("text", ("SHOP#",)), "packing": Alias("text", ("PACKING",)),
        "cartons": Alias("integer", ("T.CTN",)), "quantity": Alias("integer", ("T.QTY",)), "unit_cbm": Alias("number", ("UNIT CBM",)), "cbm": Alias("number", ("T.CBM",)), "unit_weight": Alias("text", ("UNIT WEIGHT",)), "total_weight": Alias("text", ("T.WEIGHT",)),
        "cost_price": Alias("number", ("U.PRICE (RMB)", "U.PRICE(RMB)", "unit_price_rmb"), 0), "total_amount_rmb": Alias("number", ("T.AMOUNT",)), "moved_amount": Alias("number", ("T.AMOUNT", "__col15", "__col14")),
        "cartons_cell": Alias("text", ("T.CTN",)), "quantity_cell": Alias("text", ("T.QTY",)), "section_label": Alias("text", ("__section_label",)),
    },
    PLAIN: {
        "sku": Alias("text", ("sku", "SKU")), "name": Alias("text", ("name", "Name")), "description": Alias("text", ("description", "Description")), "unit": Alias("text", ("unit", "Unit")), "quantity": Alias("integer", ("quantity", "Quantity"), 0),
        "unit_cbm": Alias("number", ("unit_cbm", "Unit CBM")), "cost_price": Alias("number", ("cost_price", "Cost Price"), 0), "section_label": Alias("text", ("__section_label",)), "selling_price": Alias("number", ("selling_price", "Selling Price"), 0), "reorder_level": Alias("integer", ("reorder_level", "Reorder Level"), 0),
    },
}
SECTION_KEY = "__section"
STAGE, STAGE_TOTAL, STAGE_TITLE, STAGE_LENGTH = "__SECTION_STAGE__:", "__SECTION_STAGE_TOTAL__:", "GOODS STUFFED INTO THIS CONTAINER", (12, 180)
STANDARD_PACKING, CARTON_COUNT, PIECE_COUNT = r"(?i)\d+\s*[a-zA-Z]+\s*/\s*ctn", r"(?i)^\d+(?:\.\d+)?\s*CTNS?$", r"(?i)^\d+(?:\.\d+)?\s*PCS?$"
NAME_LIKE, HOLDS_CARTONS, PIECES_IN_NAME, PACKING_IN_NAME = r"[A-Za-z\x{4E00}-\x{9FFF}]", r"(?i)\d+(?:\.\d+)?\s*CTNS?", r"(?i)(\d+\s*pcs\s*/\s*ctn)", r"(?i)\b\d+\s*(?:pcs|set|sets|dec)\s*/\s*(?:ctn|box)\b"

#: A typed row: strings, numbers.
TEXTS = ("sku", "source_item_no", "name", "description", "shop_name", "unit", "packing", "unit_weight", "total_weight", "warehouse", "remarks", "barcode", "code", "photo", "photo2", "order_no", "customer_no", "delivery_address", "document_date", "section", "section_label")
NUMBERS = ("cartons", "quantity", "unit_cbm", "cbm", "dim_l_cm", "dim_w_cm", "dim_h_cm", "cost_price", "total_amount_rmb", "selling_price", "reorder_level")


def resolved(cells: Column, alias: Alias) -> Column:
    """A field's value out of a row's cells."""
    cell = lambda key: F.try_element_at(cells, F.lit(key))
    first = F.trim(F.coalesce(*map(cell, alias.keys)))
    number = lambda c: N.loose_or_null(F.trim(c))
    if alias.kind == "first_number":
        value = F.coalesce(*(number(cell(k)) for k in alias.keys))
    elif alias.kind == "integer":
        value = N.digits(first).cast("double")
    elif alias.kind == "number":
        value = number(first)
    elif alias.kind == "date":
        return N.iso_date(first)
    else:
        return F.nullif(first, F.lit(""))
    return value if alias.otherwise is None else F.coalesce(value, F.lit(float(alias.otherwise)))


def layouts(rows: DataFrame, is_sales: Column, key: str = "file") -> DataFrame:
    """rows (cells) with the layout of their import: sales where `is_sales`, packing where any row of it has a key of one."""
    packs = F.max(F.exists(F.map_keys("cells"), lambda k: k.isin(*PACKING_KEYS))).over(Window.partitionBy(key))
    return rows.withColumn("layout", F.when(is_sales, SALES).when(packs, PACKING).otherwise(PLAIN))


def _typed(rows: DataFrame, key: str, at: str) -> DataFrame:
    types = {c: "string" for c in TEXTS} | {c: "double" for c in NUMBERS}
    return rows.select(key, at, *((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()))


def _section() -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(F.try_element_at("cells", F.lit(SECTION_KEY)))), F.lit("")), F.lit("shipped"))


def _fields(rows: DataFrame, layout: str) -> DataFrame:
    return settled(rows, **{f: resolved(F.col("cells"), a) for f, a in LAYOUTS[layout].items()}, section=_section())


def _unit(packing: Column) -> Column:
    return F.coalesce(F.when(packing.isNotNull(), T.unit(packing)), F.lit("pcs"))


def _inferred_price(price: Column, amount: Column, quantity: Column, places: int) -> Column:
    inferred = N.half_up(amount / F.nullif(quantity, F.lit(0.0)), places)
    return F.when(~F.coalesce(price > 0, F.lit(False)) & (amount > 0) & (quantity > 0) & (inferred > 0), inferred).otherwise(price)


def sales_rows(rows: DataFrame, key: str, at: str) -> DataFrame:
    mapped = _fields(rows, SALES)
    mapped = mapped.withColumns({"packing": F.coalesce("packing", F.nullif(F.regexp_extract(T.text("name"), PACKING_IN_NAME, 0), F.lit(""))), "description": F.col("name")})
    mapped = mapped.withColumn("unit", _unit(F.col("packing"))).withColumnsRenamed({"packing": "packaging", "cartons": "total_cartons", "quantity": "total_quantity", "cost_price": "unit_price_rmb"})
    repaired = rules.sales_repaired(mapped)
    from_counts = T.text("remarks").contains("repair:packing_from_qty_cartons")
    repaired = repaired.withColumn("unit", F.when(from_counts, "pcs").otherwise(F.col("unit")))
    return _typed(repaired.withColumnsRenamed({"packaging": "packing", "total_cartons": "cartons", "total_quantity": "quantity", "unit_price_rmb": "cost_price"}), key, at)


def packing_rows(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of a packing list. Stage markers are rows of their own, unless a section's title is malformed; headers of goods left
    go, and all from the header of repacked goods on. A name that landed in the packing column is put back."""
    mapped = _fields(rows, PACKING)
    marks = T.text("marks")
    total = marks.startswith(STAGE_TOTAL)
    title = F.when(total, F.substring(marks, len(STAGE_TOTAL) + 1, 1 << 30)).when(marks.startswith(STAGE), F.substring(marks, len(STAGE) + 1, 1 << 30))
    plain_title = F.upper(T.squeezed(title))
    marker = total | (marks.startswith(STAGE) & F.length(plain_title).between(*STAGE_LENGTH) & plain_title.contains(STAGE_TITLE))
    mapped = settled(mapped, title=F.when(marker, title), header=F.when(~marker, T.header_kind(marks)))
    mapped = order.until_boundary(mapped.withColumns({"document_id": F.col(key), "line_no": F.col(at), "item_id": F.col(at)})).drop("document_id", "line_no", "item_id")
    packing = T.text("packing")
    name_like = packing.rlike(NAME_LIKE) & ~packing.rlike(HOLDS_CARTONS)
    only_name = name_like & T.text("cartons_cell").rlike(CARTON_COUNT) & (T.text("quantity_cell").rlike(PIECE_COUNT) | F.coalesce(F.col("quantity") > 0, F.lit(False)))
    mapped = settled(mapped, moved=(packing != "") & ~packing.rlike(STANDARD_PACKING) & ~packing.rlike(CARTON_COUNT) & name_like & ~only_name)
    moved, quantity = F.col("moved"), F.coalesce("quantity", F.lit(0.0))
    amount = F.when(moved, F.col("moved_amount")).otherwise(F.col("total_amount_rmb"))
    described = F.nullif(F.concat_ws(" – ", "goods", "goods_too"), F.lit(""))
    row = {
        "name": F.when(moved, F.col("packing")).otherwise(T.english_first(T.text("goods"), T.text("goods_too"))), "packing": F.when(moved, F.nullif(F.regexp_extract(packing, PIECES_IN_NAME, 1), F.lit(""))).otherwise(F.col("packing")),
        "description": described, "section": F.col("section"), "total_amount_rmb": amount, **{c: F.col(c) for c in ("shop_name", "unit_cbm", "cbm", "unit_weight", "total_weight", "section_label")},
    }
    numbers = {"cartons": F.when(moved, F.coalesce("cartons", "quantity")).otherwise(F.col("cartons")), "quantity": quantity, "cost_price": _inferred_price(F.col("cost_price"), amount, quantity, 2)}
    is_row = F.col("title").isNull()
    new = {c: F.when(is_row, v) for c, v in row.items()} | {c: F.when(is_row, v).otherwise(F.lit(0.0)) for c, v in numbers.items()}
    new |= {"name": F.coalesce("title", new["name"]), "sku": F.when(is_row, F.nullif(F.trim(F.substring_index(marks, "\n", 1)), F.lit(""))).otherwise(marks), "selling_price": F.lit(0.0), "reorder_level": F.lit(0.0)}
    return _typed(settled(mapped, **new).withColumn("unit", _unit(F.col("packing"))), key, at)


def plain_rows(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of an export; rows with neither name nor code go."""
    mapped = _fields(rows, PLAIN).where("name is not null or sku is not null")
    return _typed(mapped.withColumn("unit", F.coalesce("unit", F.lit("pcs"))), key, at)


def imported_rows(rows: DataFrame, is_sales: Column, key: str = "file", at: str = "record") -> DataFrame:
    """Typed rows (key, at, TEXTS, NUMBERS) of imports: rows are maps from header to cell (`cells`), as headed_rows gives them.

    The layout of an import decides how its rows are mapped; then the chain of shift rules runs over all, twice."""
    sold = F.coalesce(is_sales, F.lit(False))
    laid_out = layouts(rows.where(~sold), F.lit(False), key)  # sales rows need no look at their import
    parts = [sales_rows(rows.where(sold), key, at), *(f(laid_out.where(F.col("layout") == layout), key, at) for layout, f in ((PACKING, packing_rows), (PLAIN, plain_rows)))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rules.manifest_repaired(both).select(key, at, *TEXTS, *NUMBERS)


# The keys of what all rows of an order say about the order.
ORDER_KEYS = {"order_no": ("ORD NO.", "order_no"), "customer_no": ("CUS NO.", "customer_no"), "delivery_address": ("送货地址", "DELIVERY ADDRESS", "delivery_address"), "document_date": ("DATE", "date")}


def order_context(rows: DataFrame, key: str = "file", at: str = "record") -> DataFrame:
    """key and ORDER_KEYS of each import: the first value that is not blank, by row, then by the order of the keys; a date
    that is none is null."""
    cell = lambda k: F.nullif(F.trim(F.try_element_at("cells", F.lit(k))), F.lit(""))
    own = {c: F.coalesce(*map(cell, keys)) for c, keys in ORDER_KEYS.items()}
    found = rows.groupBy(key).agg(*(F.min_by(v, F.when(v.isNotNull(), F.col(at))).alias(c) for c, v in own.items()))
    return found.withColumn("document_date", N.iso_date(F.col("document_date")))
