"""Labels of columns and the fields that they name."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.functions.columns import bound

#: The field of a column that is known and not read.
SKIP = "skip"

# Labels of manifests and the fields that they name.
CONTAINER_LABELS = {
    "NO": "line_no", "NO.": "line_no", "序号": "line_no",
    "MARKS": "marks", "唛头": "marks",
    "SHOP": "shop", "SHOP#": "shop", "SUPPLIER": "shop", "SHOP/IMAGE": "shop",
    "ITEM NO": "item_code", "ITEM NO.": "item_code", "ITEM": "item_code",
    "DESCRIPTION": "description", "DESCRIPTION OF GOODS": "description", "品名": "description",
    "PACKING": "packaging", "QTY/CTN": "packaging", "PCS/CTN": "packaging", "QTY/CARTON": "packaging",
    "T.CTN": "total_cartons", "CTNS": "total_cartons", "T CTN": "total_cartons", "TOTAL CTNS": "total_cartons", "TOTAL CARTONS": "total_cartons",
    "T.QTY": "total_quantity", "TOTAL QTY": "total_quantity", "T QTY": "total_quantity", "TOTAL QUANTITY": "total_quantity",
    "L": "dim_l_cm", "L(CM)": "dim_l_cm", "LENGTH": "dim_l_cm",
    "W": "dim_w_cm", "W(CM)": "dim_w_cm", "WIDTH": "dim_w_cm",
    "H": "dim_h_cm", "H(CM)": "dim_h_cm", "HEIGHT": "dim_h_cm",
    "UNIT CBM": "unit_cbm", "U.CBM": "unit_cbm",
    "T.CBM": "total_cbm", "TOTAL CBM": "total_cbm", "T CBM": "total_cbm",
    "UNIT WEIGHT": "unit_weight_kg", "UNIT WEIGHT(KG)": "unit_weight_kg", "U.WEIGHT": "unit_weight_kg", "U.W": "unit_weight_kg",
    "T.WEIGHT": "total_weight_kg", "TOTAL WEIGHT": "total_weight_kg", "TOTAL WEIGHT(KG)": "total_weight_kg", "T.W": "total_weight_kg", "T WEIGHT": "total_weight_kg",
    "U/P": "unit_price_rmb", "UNIT PRICE": "unit_price_rmb", "U.PRICE": "unit_price_rmb", "U.PRICE (RMB)": "unit_price_rmb", "U.PRICE(RMB)": "unit_price_rmb", "UNIT PRICE(RMB)": "unit_price_rmb",
    "UNIT PRICE(¥)": "unit_price_rmb", "UNIT PRICE (RMB)": "unit_price_rmb", "UNIT PRICE (¥)": "unit_price_rmb", "PRICE (RMB)": "unit_price_rmb", "U PRICE (RMB)": "unit_price_rmb",
    "T.AMOUNT": "total_amount_rmb", "TOTAL AMOUNT": "total_amount_rmb", "T.AMOUNT(¥)": "total_amount_rmb", "T.AMOUNT(RMB)": "total_amount_rmb", "TOTAL AMOUNT(¥)": "total_amount_rmb", "AMOUNT": "total_amount_rmb",
    "BOX NO": "box_no_start", "BOX NO.": "box_no_start", "BOX .NO": "box_no_start", "BOX": "box_no_start",
    "BARCODE": "barcode", "WAREHOUSE": "warehouse", "REMARKS": "remarks", "IMAGE": SKIP,
}

# Labels of sales orders, each with what may stand before or after it, and the fields that they name.
SALES_LABELS = {
    "line_no": ("序号", "NO", "NO.", "NO. 序号"),
    SKIP: ("DATE", "订单日期", "DATE 订单日期", "PHOTO", "PHOTO2", "图片1"),
    "marks": ("ORD NO", "ORD NO.", "销售单号", "ORD NO. 销售单号"),
    "delivery_no": ("DEL NO", "DEL NO.", "送货单号", "DEL NO. 送货单号"),
    "customer_item_ref": ("CUS NO", "CUS NO.", "客户货号", "CUS NO. 客户货号"),
    "item_code": ("ITEM NO", "ITEM NO.", "ITEM NO. 产品货号", "产品货号", "ITEM CODE", "SKU"),
    "description": ("DES", "DES.", "DESCRIPTION", "DES. 描述", "描述"),
    "total_cartons": ("CTN", "总箱数", "TOTAL CARTONS", "CTNS", "CTN 总箱数"),
    "packaging": ("QTY", "每箱数量", "QTY/CTN", "QTY 每箱数量"),
    "total_quantity": ("T.QTY", "总数量", "TOTAL QTY", "T.QTY 总数量"),
    "unit_price_rmb": ("U/P", "单价", "UNIT PRICE", "U/P 单价"),
    "total_amount_rmb": ("金额", "AMOUNT", "AMOUNT 金额"),
    "dim_l_cm": ("长", "L", "L(CM)", "L 长"),
    "dim_w_cm": ("宽", "W", "W(CM)", "W 宽"),
    "dim_h_cm": ("高", "H", "H(CM)", "H 高"),
    "unit_cbm": ("CBM", "体积", "UNIT CBM", "CBM 体积"),
    "total_cbm": ("T.T.CBM", "总体积", "TOTAL CBM", "T.T.CBM 总体积", "TTL CBM"),
    "unit_weight_kg": ("G.W", "重量", "UNIT WEIGHT", "UNIT WEIGHT(KG)", "G.W. 重量"),
    "total_weight_kg": ("T.T.KGS", "总重量", "TOTAL WEIGHT", "TOTAL WEIGHT(KG)", "T.T.KGS 总重量", "TTL KGS", "TTL KGS 总重量"),
    "barcode": ("CODE", "条形码", "BARCODE", "CODE 条形码"),
    "warehouse": ("W.H", "仓位", "WAREHOUSE", "W.H. 仓位"),
    "unit": ("UNIT", "UNIT 单位", "单位"),
    "product_name_local": ("ITEM 品名", "品名"),
    "material": ("MATERIAL", "MATERIAL 材质", "材质"),
    "remarks": ("REK", "备注", "REMARKS", "REK 备注"),
}

# Patterns that a sales label without an entry above may hold, in the order in which they are tried.
SALES_PATTERNS = (
    ("line_no", r"序号|^NO\.?$|^NO "),
    ("delivery_no", "DEL NO|送货单号"),
    ("marks", "ORD NO|销售单号"),
    ("customer_item_ref", "CUS NO|客户货号"),
    ("item_code", "ITEM NO|产品货号|ITEM CODE"),
    ("product_name_local", "ITEM.*品名|品名.*ITEM"),
    ("material", "MATERIAL|材质"),
    ("unit", "UNIT.*单位|单位.*UNIT|UNIT$"),
    ("description", "DES|描述"),
    ("total_cartons", "CTN|总箱数"),
    ("packaging", r"^(?!.*T\.QTY).*QTY|每箱数量"),
    ("total_quantity", r"T\.QTY|总数量|TOTAL QTY"),
    ("unit_price_rmb", "U/P|单价|UNIT PRICE"),
    ("total_amount_rmb", "AMOUNT|金额"),
    ("dim_l_cm", r"^L(?:\s|$)| 长"),
    ("dim_w_cm", r"^W(?:\s|$)| 宽"),
    ("dim_h_cm", r"^H(?:\s|$)| 高"),
    ("total_cbm", r"T\.T\.CBM|TTL CBM|总体积|TOTAL CBM"),
    ("unit_cbm", "CBM|体积"),
    ("total_weight_kg", r"T\.T\.KGS|TTL KGS|总重量|TOTAL WEIGHT"),
    ("unit_weight_kg", r"G\.W|重量|UNIT WEIGHT"),
    ("barcode", "^(?!.*(?:ITEM|CUS|DEL)).*(?:CODE|条形码)"),
    ("warehouse", r"仓位|W\.H|WAREHOUSE"),
    ("remarks", "REK|备注|REMARKS"),
    (SKIP, "PHOTO|图片|DATE"),
)

# How labels are written apart or glued, and their usual form.
SPELLINGS = (
    (r"(?<!\w)([A-Z])\.\s+([A-Z])", "$1.$2"),
    (r"(?<!\w)U\.PRICE\s*\(", "U.PRICE ("),
    (r"(?<!\w)UNIT\s+PRICE\s*\(", "UNIT PRICE ("),
    (r"(?<!\w)T\.AMOUNT\s*\(", "T.AMOUNT ("),
    *((rf"(?<!\w){word}\s*NO(?:\.(?=\w)|(?!\w))", f"{word} NO") for word in ("ORD", "DEL", "CUS", "ITEM")),
    (r"(?<!\w)G\.W(?:\.(?=\w)|(?!\w))", "G.W"),
    (r"(?<!\w)W\.H(?:\.(?=\w)|(?!\w))", "W.H"),
)


def normal_label(label: Column) -> Column:
    """A label in capitals, with single spaces, plain brackets and its usual spelling."""
    spaced = F.regexp_replace(T.squeezed(F.upper(label)), "[:：]", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(spaced, "[（(]", "("), "[）)]", ")"))
    return T.squeezed(reduce(lambda c, s: F.regexp_replace(c, *map(F.lit, s)), SPELLINGS, plain))


def _entry(key: Column, labels: dict[str, str]) -> Column:
    by_field: dict[str, list[str]] = {}
    for label, field in labels.items():
        by_field.setdefault(field, []).append(label)
    return F.coalesce(*(F.when(key.isin(own), field) for field, own in by_field.items()))


def field_of_label(label: Column, sales: bool) -> Column:
    """The field that a label names (SKIP for a column that is not read), or null."""
    if not sales:
        return bound(normal_label(label), lambda key: _entry(key, CONTAINER_LABELS))
    entries = {label: field for field, own in SALES_LABELS.items() for label in own}
    return bound(normal_label(label), lambda key: F.coalesce(_entry(key, entries), *(F.when(key.rlike(pattern), field) for field, pattern in SALES_PATTERNS)))


_SPACES = re.compile("[ \t\n\x0b\f\r\xa0\u3000]+")
_SPELLINGS = tuple((re.compile(p, re.A), usual.replace("$", "\\")) for p, usual in SPELLINGS)
_SALES_FIELDS = {label: field for field, own in SALES_LABELS.items() for label in own}
_SALES_PATTERNS = tuple((field, re.compile(p, re.A)) for field, p in SALES_PATTERNS)
#: Labels that a task keeps with their fields, and the longest of these.
KEPT_LABELS, LONGEST_KEPT = 50_000, 80


def _named(label: str, sales: bool) -> str | None:
    key = _SPACES.sub(" ", label.upper()).strip(" ").replace(":", " ").replace("：", " ")
    key = key.replace("（", "(").replace("）", ")").strip(" ")
    for pattern, usual in _SPELLINGS:
        key = pattern.sub(usual, key)
    key = _SPACES.sub(" ", key).strip(" ")
    if not sales:
        return CONTAINER_LABELS.get(key)
    return _SALES_FIELDS.get(key) or next((field for field, pattern in _SALES_PATTERNS if pattern.search(key)), None)


_kept = lru_cache(KEPT_LABELS)(_named)
_DIGIT = re.compile("[0-9]")


def field_named(label: str, sales: bool) -> str | None:
    """As field_of_label, inside a task: labels come again and again, so a task keeps what they name."""
    if not sales and _DIGIT.search(label):  # no label of a manifest has a digit, and no spelling takes one away
        return None
    return (_kept if len(label) <= LONGEST_KEPT else _named)(label, sales)


def fields_named(row: list[str | None], sales: bool) -> list[str | None]:
    """field_named of each cell of a row."""
    return [field_named(c, sales) if c else None for c in row]
