"""Sales rows without a header: cells by position from the barcode column, rows flattened into one text, and numbers that went into the description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.functions.columns import bound, settled
from quaytally.functions.numbers import half_up, prefix_number
from quaytally.operators.rules import MAX_AMOUNT, MAX_CARTONS, MAX_PER_CARTON, MAX_QUANTITY, SQL_MAX_PRICE
from quaytally.sources.lines import TAIL

# What cells of a sales row look like, and the largest numbers of a row.
BARCODE, LINE_NUMBER, DATE, ORDER_REF, PRODUCT = r"^\d{12,15}$", r"^\d{1,4}$", r"^\d{4}-\d{2}-\d{2}$", r"^[A-Z]\d{2}-\d{4}$", r"(?i)^[A-Z0-9][A-Z0-9._/-]+$"
PARTIAL_DATES = r"^\d{4}-\d{2}-\d{2}$|^20\d{2}[-/]\d{2}|^\d{2}-\d{2}-?$"
WAREHOUSE, UNIT, TWO_NUMBERS = r"(?i)仓|WAREHOUSE", r"(?i)^(PCS|SET|DCS|PS|PCS/SE)$", r"^(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)$"
WAREHOUSE_IN_TEXT = r"(?i)((?:浙江|东阳|浦江)\s*仓(?:\s*(?:PCS|SET|DCS|PCS/SE|PS))?|\d+\s*仓|刀叉勺)"
NUMBER, FLAT_ROW = r"(\d+(?:\.\d+)?)", r"(?i)^(\d{1,4})\s+([A-Z0-9]+(?:\s*-\s*[A-Z0-9]+)+)\s+([A-Z0-9]{2,}[-/A-Z0-9]*)\s+(.+)$"
MOST_QUANTITY, MOST_PRICE, MOST_AMOUNT, MOST_PER_CARTON = 500_000, 50_000, 50_000_000, 200
FIRST_PASS_CARTONS, SECOND_PASS_CARTONS = 400, 600
COLLAPSED_TAG, CONTINUATION_TAG, FLAT_TAG = "repair:collapsed_sales_metrics", "repair:continuation_sales_metrics", "full_extract:flattened_sales_order_row"


def number(c: Column) -> Column:
    """A cell's number without currency signs and unit words."""
    bare = F.regexp_replace(F.regexp_replace(c, "[¥￥%,]", ""), r"(?i)\b(?:PCS|CTN|CTNS|KGS|KG|CBM|CM|MM)\b", "")
    return prefix_number(F.trim(bare))


def _last(cells: Column, low: Column, high: Column, pattern: str) -> Column:
    """The last place from low to high (from 0) whose cell fits."""
    return F.array_max(F.filter(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: (i >= low) & (i <= high) & F.get(cells, i).rlike(pattern)))


def _merged(c: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, TWO_NUMBERS, i), F.lit("")).cast("double")


def positional_rows(rows: DataFrame) -> DataFrame:
    """Sales rows (`cells`, of 18 or more, the first a line number) read from the barcode column to the left.

    The column is that of a barcode, or two before the warehouse, or six from the end. A compact layout has no
    total weight (or no remark, so that the weight stands in the barcode column). Neighbouring numbers in one
    cell are taken apart. Cartons that contradict quantity, volume or weight are worked out from these."""
    c = F.col("cells")
    n = F.size(c)
    rows = settled(rows, cells=F.transform("cells", lambda x: F.trim(T.text(x)))).where((n >= 18) & F.get(c, F.lit(0)).rlike(LINE_NUMBER))
    stored = F.filter(F.sequence(F.greatest(F.lit(4), n - 12), n - 1), lambda i: F.get(c, i).rlike(WAREHOUSE) & (i >= 12))
    wide = n.between(22, 28) & (F.get(c, n - 3).rlike(UNIT) | F.get(c, n - 4).rlike(WAREHOUSE))
    anchor = F.coalesce(_last(c, F.greatest(F.lit(10), n - 16), F.least(n - 1, F.lit(22)), BARCODE), F.array_max(stored) - 2, F.when(wide, n - 6))
    rows = settled(rows, k=anchor).where("k >= 10")
    k = F.col("k")
    at = lambda back: F.coalesce(F.get(c, k - back), F.lit(""))
    left, next_left = number(at(1)), number(at(2))
    rows = settled(rows, compact=F.coalesce((left > 0) & (left < 10) & (next_left > left), F.lit(False)))
    compact = F.col("compact")
    # how much nearer the columns of a compact row stand
    off = F.when(compact, 1).otherwise(0)
    volume, weight = at(F.lit(2) - off), at(F.lit(3) - off)
    lone = (weight == "") & ~volume.rlike(TWO_NUMBERS) & F.coalesce(number(volume) > 5, F.lit(False))
    both = (weight == "") & volume.rlike(TWO_NUMBERS)
    high, wide_ = at(F.lit(5) - off), at(F.lit(6) - off)
    wh, lw = high.rlike(TWO_NUMBERS), wide_.rlike(TWO_NUMBERS)
    rows = settled(
        rows,
        **{
            "unit_weight_kg": F.when(both, _merged(volume, 1)).when(lone, number(volume)).otherwise(number(weight)),
            "total_cbm": F.when(both, _merged(volume, 2)).when(~lone, number(volume)),
            "lone": lone,
            "unit_cbm": number(at(F.lit(4) - off)),
            "total_weight_kg": F.when(~compact, number(at(1))).otherwise(number(at(0))),
            "dim_h_cm": F.when(wh, _merged(high, 2)).otherwise(number(high)),
            "dim_w_cm": F.when(wh, _merged(high, 1)).when(lw, _merged(wide_, 2)).otherwise(number(wide_)),
            "dim_l_cm": F.when(wh, number(wide_)).when(lw, _merged(wide_, 1)).otherwise(number(at(F.lit(7) - off))),
            "l": k - 7 + off + F.when(wh | lw, 1).otherwise(0),
        },
    ).where("l >= 7")
    l = F.col("l")  # noqa: E741
    by = lambda back: F.coalesce(F.get(c, l - back), F.lit(""))
    quantity, amount, price = number(by(3)), number(by(1)), number(by(2))
    inferred = half_up(amount / F.nullif(quantity, F.lit(0.0)) * 100) / 100
    des = l - 6
    full = F.coalesce(des >= 4, F.lit(False))
    own = lambda i: F.coalesce(F.get(c, F.lit(i)), F.lit(""))
    item = F.when(full & ~own(3).rlike(rf"{LINE_NUMBER}|{DATE}|{ORDER_REF}") & (F.length(own(3)) < 64) & (own(3) != ""), own(3))
    other = F.try_element_at(F.filter(F.transform(F.sequence(F.lit(1), des - 1), lambda i: F.when(full & (i <= 2), "").otherwise(F.get(c, i))), lambda x: (x != "") & ~(x.rlike(LINE_NUMBER) & (x == own(0))) & ~x.rlike(PARTIAL_DATES) & ~x.rlike(ORDER_REF)), F.lit(1))
    delivery = F.when(full & (own(1) != "") & ~own(1).rlike(rf"{LINE_NUMBER}|{ORDER_REF}"), own(1))
    rows = settled(
        rows,
        **{
            "delivery_no": delivery, "customer_item_ref": F.when(full & (own(2) != "") & ~own(2).rlike(LINE_NUMBER) & (F.length(own(2)) < 120), own(2)), "item": F.coalesce(item, other), "description": by(6),
            "qty_per_carton": number(by(4)), "total_quantity": quantity, "total_amount_rmb": amount, "unit_price_rmb": F.when((F.coalesce(price, F.lit(0.0)) <= 0) & (quantity > 0) & (inferred > 0), inferred).otherwise(price), "cartons": number(by(5)),
        },
    )
    rows = settled(rows, item_code=F.when(full & (des >= 5), manufacturer_number(F.col("item"), c, des, F.col("delivery_no"))).otherwise(F.col("item")))
    per, printed = F.col("qty_per_carton"), F.col("cartons")
    by_pieces = F.when((F.col("total_quantity") > 0) & (per > 0), half_up(F.col("total_quantity") / per).cast("double"))
    by_volume = half_up(F.col("total_cbm") / F.when(F.col("unit_cbm") > 0, F.col("unit_cbm"))).cast("double")
    by_weight = half_up(F.col("total_weight_kg") / F.when(F.col("unit_weight_kg") > 0, F.col("unit_weight_kg"))).cast("double")
    checked = lambda found, times: F.when((found > 0) & (printed.isNull() | (printed > found * times) | (printed * times < found)), found).otherwise(printed)
    cartons = F.when(by_pieces > 0, checked(by_pieces, 3)).when(compact, checked(by_volume, 5)).otherwise(checked(by_weight, 5))
    rows = settled(rows, total_cartons=cartons)
    stored_at = F.coalesce(F.get(c, k + 2), F.lit("")), F.when(n >= 20, F.get(c, n - 4)), F.get(c, _last(c, n - 8, n - 1, WAREHOUSE))
    end = lambda back: F.when((n >= 22) & (F.get(c, n - back) != ""), F.get(c, n - back))
    remark = at(-1)
    some = T.any_of([F.coalesce(F.col(x) > 0, F.lit(False)) for x in ("total_quantity", "total_cartons", "total_amount_rmb", "unit_price_rmb")])
    rows = settled(
        rows,
        **{
            "total_weight_kg": F.when(compact & F.col("total_weight_kg").isNull(), F.col("total_cartons") * F.col("unit_weight_kg")).otherwise(F.col("total_weight_kg")),
            "total_cbm": F.when(F.col("lone"), half_up(F.col("total_cartons") * F.col("unit_cbm") * 1000) / 1000).otherwise(F.col("total_cbm")),
            "barcode": F.when(at(0).rlike(BARCODE), at(0)),
            "remarks": F.when((remark != "") & ~remark.rlike(rf"{BARCODE}|^[\s\[\]]*$") & (F.length(remark) < 120), remark),
            "warehouse": F.coalesce(*(F.when(x.rlike(WAREHOUSE), T.squeezed(x)) for x in stored_at)),
            "unit": F.when(end(3).rlike(UNIT), end(3)),
            "product_name_local": F.when(~end(2).rlike(BARCODE) & (F.length(end(2)) < 200), T.squeezed(end(2))),
            "material": F.when(~end(1).rlike(WAREHOUSE) & (F.length(end(1)) < 200), T.squeezed(end(1))),
            "description": F.nullif("description", F.lit("")),
        },
    )
    return rows.where(some & (F.col("description").isNotNull() | F.col("item_code").isNotNull())).drop("cells", "k", "l", "compact", "lone", "item", "cartons")


def manufacturer_number(item: Column, cells: Column, description_at: Column, delivery: Column) -> Column:
    """An item code that is a delivery or order reference gives way to a product's code among the cells before the
    description, or to the description's first word if it has a digit."""
    plain = lambda x: F.regexp_replace(x, r"\s+", "")
    refers = T.delivery_ref(item) | item.rlike(ORDER_REF)
    fits = lambda x: x.rlike(PRODUCT) & (F.length(x) > 2) & (F.length(x) <= 28) & ~x.rlike(rf"{DATE}|{ORDER_REF}") & ~T.delivery_ref(x)
    before = F.slice(cells, F.lit(4), F.greatest(F.least(description_at, F.lit(7)) - 3, F.lit(0)))
    found = F.try_element_at(F.filter(before, lambda x: fits(x) & ~x.rlike(LINE_NUMBER) & (plain(x) != plain(F.coalesce(delivery, item)))), F.lit(1))
    word = F.regexp_extract(T.text(F.get(cells, description_at)), r"^(\S+)", 1)
    better = F.coalesce(found, F.when(fits(word) & word.rlike(r"\d"), word))
    return F.when(refers, F.coalesce(better, F.when(T.delivery_ref(item), item))).otherwise(item)


def flattened_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows that are one text: line number, order reference, item code, and the rest as description.

    A barcode at the end goes; numbers in the rest are recovered."""
    flat = F.col("__flat")
    rows = settled(rows, __flat=T.squeezed(T.text(text)))
    part = lambda i: F.regexp_extract(flat, FLAT_ROW, i)
    rest = F.trim(F.regexp_replace(part(4), r"\s+\d{8,}\s*[\x{4e00}-\x{9fff}A-Za-z]{0,12}\s*$", ""))
    found = settled(rows.where(flat.rlike(FLAT_ROW)), marks=F.regexp_replace(part(2), r"\s*-\s*", "-"), item_code=part(3), description=rest).drop("__flat")
    empty = {c: F.lit(None).cast("double") for c in TAIL} | {"packaging": F.lit(None).cast("string"), "warehouse": F.lit(None).cast("string"), "remarks": F.lit(FLAT_TAG)}
    return continuation_metrics(collapsed_metrics(found.where("description <> ''").withColumns(empty)))


def _tail(nums: Column, most_cartons: int, strict: bool) -> Column:
    """struct(first, values): the twelve numbers of a row among the numbers of a text; missing ones at the beginning are null."""
    # w(k) is a number of the row, read where it stands: a slice for each of them costs more than the row
    sizes = lambda w: reduce_and([(w(i) > 0) & (w(i) < m) for i, m in ((5, 300), (6, 300), (7, 300), (8, 5), (9, 500), (10, 30), (11, 5000))])
    money = lambda w: (w(2) > 0) & (w(3) > 0) & (w(4) > 0) & (w(2) <= MOST_QUANTITY) & (w(3) <= MOST_PRICE) & (w(4) <= MOST_AMOUNT)
    off = lambda w: F.abs(w(2) * w(3) - w(4))
    agrees = lambda w: off(w) <= F.greatest(F.lit(2.0), w(4) * 0.06)
    packed = lambda w: (w(1) > 0) & (w(1) <= MOST_PER_CARTON)
    n = F.size(nums)

    def scored(i: Column) -> Column:
        w = lambda k: F.get(nums, i + (k - 1))
        score = lambda share: 1000 - off(w) * 10 - F.abs(w(0) - share) * 20 - F.abs(share - half_up(share)) * 5 - (i - 1) * 0.1
        fits = money(w) & packed(w) & (w(0) > 0) & (w(0) <= most_cartons) & sizes(w) & agrees(w)
        return F.when(fits, F.struct(bound(w(2) / F.nullif(w(1), F.lit(0.0)), score).alias("score"), (-i).alias("i")))

    best = F.array_max(F.transform(F.when(n >= 12, F.sequence(F.lit(1), n - 11)), scored))

    def last(many: int, condition) -> Column:
        w = lambda k: F.get(nums, n + (k - 12)) if k >= 12 - many else F.lit(None).cast("double")
        exact = n >= many if strict or many == 12 else n == many
        values = F.concat(F.array(*([F.lit(None).cast("double")] * (12 - many))), F.slice(nums, F.greatest(n - many + 1, F.lit(1)), many))
        return F.when(F.coalesce(exact & condition(w), F.lit(False)), F.struct((n - many).alias("first"), values.alias("values")))

    found = bound(best, lambda b: F.when(b.isNotNull(), F.struct((-b["i"] - 1).alias("first"), F.slice(nums, -b["i"], 12).alias("values"))))
    if strict:
        return F.coalesce(found, last(11, lambda w: money(w) & packed(w) & sizes(w) & agrees(w)), last(10, lambda w: money(w) & sizes(w) & agrees(w)))
    return F.coalesce(found, last(12, money), last(11, lambda w: money(w) & packed(w)), last(10, money))


def reduce_and(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _unswapped(nums: Column) -> Column:
    """The first quantity, amount, price that agree become quantity, price, amount."""
    n = F.size(nums)
    agree = lambda i: (F.get(nums, i) > 0) & (F.get(nums, i) <= 100_000) & (F.get(nums, i + 2) > 0) & (F.get(nums, i + 2) < 500) & (F.get(nums, i + 1) > 0) & (F.get(nums, i + 1) < 10_000_000) & (F.abs(F.get(nums, i) * F.get(nums, i + 2) - F.get(nums, i + 1)) <= F.greatest(F.lit(2.0), F.get(nums, i + 1) * 0.06))
    first = F.array_min(F.filter(F.when(n >= 3, F.sequence(F.lit(0), n - 3)), agree))
    # the place is found once, not once for each number
    return bound(first, lambda at: F.when(at.isNull(), nums).otherwise(F.transform(nums, lambda v, i: F.when(i == at + 1, F.get(nums, i + 1)).when(i == at + 2, F.get(nums, i - 1)).otherwise(v))))


def _recovered(rows: DataFrame, text: Column, some: Column, most_cartons: int, strict: bool, tag: str) -> DataFrame:
    """Rows whose missing numbers are taken out of `text`, where `some` holds and the text has a row's numbers."""
    columns = rows.columns
    rows = settled(rows, t=F.when(some, text))
    rows = settled(rows, raw=F.regexp_extract_all("t", F.lit(NUMBER), 1))
    rows = settled(rows, plain=F.transform("raw", lambda x: x.cast("double")))
    rows = settled(rows, nums=_unswapped(F.col("plain")))
    rows = settled(rows, tail=_tail(F.col("nums"), most_cartons, strict))
    v = lambda i: F.col("tail.values")[i]
    use = F.coalesce((F.size("nums") >= 10) & F.col("tail").isNotNull() & ~F.coalesce(v(2) < v(0), F.lit(False)), F.lit(False))
    rows = settled(rows, use=use)
    gaps = F.split("t", NUMBER)
    # only of rows that take numbers over
    before = F.array_join(F.transform(F.slice(gaps, F.lit(1), F.col("tail.first") + 1), lambda g, i: F.concat(g, F.when(i < F.col("tail.first"), F.get(F.col("raw"), i)).otherwise(""))), "")
    token = F.nullif(T.squeezed(F.regexp_extract(T.squeezed(T.text("description")), WAREHOUSE_IN_TEXT, 1)), F.lit(""))
    new = {}
    for i, c in enumerate(TAIL):
        missing = F.col(c).isNull()
        if c == "total_cartons":
            missing = missing | F.coalesce((F.col("total_quantity") > 0) & (F.col(c) > F.col("total_quantity")), F.lit(False))
        if c == "unit_cbm" and not strict:
            missing = F.lit(True)
        new[c] = F.when(F.col("use") & missing & (v(i) > 0), v(i)).otherwise(F.col(c))
    old = F.nullif("remarks", F.lit(""))
    new |= {
        "packaging": F.when(F.col("use") & F.col("packaging").isNull() & (v(1) > 0), F.concat(F.regexp_replace(v(1).cast("string"), r"\.0$", ""), F.lit("pcs"))).otherwise(F.col("packaging")),
        "description": F.when(F.col("use"), F.coalesce(F.nullif(F.trim(before), F.lit("")), F.col("description"))).otherwise(F.col("description")),
        "warehouse": F.when(F.col("use"), F.coalesce("warehouse", token)).otherwise(F.col("warehouse")),
        "remarks": F.when(F.col("use"), F.concat(F.coalesce(F.concat(old, F.lit(";")), F.lit("")), F.lit(tag))).otherwise(F.col("remarks")),
    }
    return settled(rows, **new).select(columns)


def collapsed_metrics(rows: DataFrame) -> DataFrame:
    """First pass: numbers before the warehouse in the description, for rows that lack four values or say so there."""
    columns = rows.columns
    rows = settled(rows, __text=T.squeezed(T.text("description")))
    text = F.col("__text")
    stored = text.rlike(WAREHOUSE_IN_TEXT)
    before = F.trim(F.split(text, WAREHOUSE_IN_TEXT, 2)[0])
    checked = [F.col(c).isNull().cast("int") for c in TAIL if c not in ("unit_cbm", "unit_weight_kg")] + [T.text("warehouse").isin("").cast("int")]
    lacking = sum(checked, F.lit(0)) >= 4
    return _recovered(rows, before, lacking | stored, FIRST_PASS_CARTONS, False, COLLAPSED_TAG).select(columns)


def continuation_metrics(rows: DataFrame) -> DataFrame:
    """Second pass: numbers anywhere in the description, for rows that still lack quantity or amount."""
    return _recovered(rows, T.squeezed(T.text("description")), F.col("total_quantity").isNull() | F.col("total_amount_rmb").isNull(), SECOND_PASS_CARTONS, True, CONTINUATION_TAG)


# What the normaliser of stored sales rows takes for order codes, warehouses and sound numbers.
CODE_AS_MARKS = r"(?i)^SAN[0-9A-Z-]+$|^[0-9]{2}[A-Z][0-9]{3}-[0-9A-Z]+$|^[A-Z][0-9]{2}-[0-9]{4,}$"
STORED_UNIT, STORED_WAREHOUSE = r"(?i)\s+(PCS|SET|DCS|PS|PCS/SE)\s*$", "(?i)(浦江仓|浙江仓|东阳仓|[0-9]+仓|刀叉勺)"
AMOUNT_SHARE, AMOUNT_LEAST = 0.06, 2
BELOW = {"dim_l_cm": 300, "dim_w_cm": 300, "dim_h_cm": 300, "unit_cbm": 5, "total_cbm": 30, "total_weight_kg": 5000}
BELOW_TOO, UP_TO_TOO = {"unit_weight_kg": 500}, {"qty_per_carton": 200, "total_cartons": 600}


def _last_twelve(c: Column) -> Column:
    """The last twelve numbers of a text, taken apart at anything but digits and dots; null for what is no number."""
    parts = F.split(F.trim(F.regexp_replace(c, "[^0-9.]+", " ")), r"\s+")
    number = lambda t: F.when(t.rlike(r"^(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))
    return F.when(F.size(parts) >= len(TAIL), F.transform(F.slice(parts, -len(TAIL), len(TAIL)), number))


def stored_rows_normalised(rows: DataFrame, is_sales: Column) -> DataFrame:
    """Rows of sales orders as they are stored: absurd numbers go, an order code is marks too, the unit leaves the
    warehouse, and missing numbers come out of the description, by the last twelve numbers before the warehouse, then by
    the last twelve of all. Cartons that are missing, or more than the pieces, are pieces by pieces a carton."""
    fields = (*TAIL, "marks", "item_code", "warehouse", "description")
    own = settled(rows.withColumn("__sales", F.coalesce(is_sales, F.lit(False))), **{c: F.col(c).cast("double") for c in TAIL})
    capped_ = {c: F.when(F.col(c).between(0, most), F.col(c)) for c, most in {"total_quantity": MAX_QUANTITY, "qty_per_carton": MAX_PER_CARTON, "unit_price_rmb": SQL_MAX_PRICE, "total_amount_rmb": MAX_AMOUNT, "total_cartons": MAX_CARTONS}.items()}
    marks = F.when((T.text(F.trim("marks")) == "") & F.col("item_code").rlike(CODE_AS_MARKS), F.upper("item_code")).otherwise(F.col("marks"))
    unitless = F.when(T.text(F.trim("warehouse")) != "", F.regexp_replace(F.regexp_replace("warehouse", r"\s+", " "), STORED_UNIT, "")).otherwise(F.col("warehouse"))
    new = settled(own.where("__sales"), **capped_, marks=marks, warehouse=unitless)
    text = T.text("description")
    found = F.nullif(F.regexp_extract(text, STORED_WAREHOUSE, 1), F.lit(""))
    lacking = T.any_of([F.col(c).isNull() for c in (*TAIL, "warehouse") if c not in ("unit_price_rmb", "unit_cbm", "unit_weight_kg")]) & (text != "")
    before = F.regexp_replace(text, "(?is)" + STORED_WAREHOUSE[4:] + ".*$", "")
    new = settled(new, __found=found, __lacking=lacking, __n=F.when(lacking & found.isNotNull(), _last_twelve(before)), __all=F.when(lacking, _last_twelve(text)))

    def sound(n: Column, strict: bool) -> Column:
        v = {c: n[i] for i, c in enumerate(TAIL)}
        fits = [F.abs(v["total_quantity"] * v["unit_price_rmb"] - v["total_amount_rmb"]) <= F.greatest(F.lit(AMOUNT_LEAST), v["total_amount_rmb"] * AMOUNT_SHARE)]
        fits += [v[c] > 0 for c in ("total_quantity", "unit_price_rmb", "total_amount_rmb")]
        fits += [(v[c] > 0) & (v[c] < most) for c, most in (BELOW | (BELOW_TOO if strict else {})).items()]
        fits += [(v[c] > 0) & (v[c] <= most) for c, most in UP_TO_TOO.items()] if strict else []
        return F.coalesce(reduce_and(fits), F.lit(False))

    new = settled(new, __good=sound(F.col("__n"), False))
    taken = lambda n, i, c: F.when(n[i] > 0, n[i]) if c in UP_TO_TOO else n[i]
    first = {c: F.coalesce(F.col(c), F.when(F.col("__good"), taken(F.col("__n"), i, c))) for i, c in enumerate(TAIL)}
    new = settled(new, **first, warehouse=F.coalesce("warehouse", F.when(F.col("__good"), F.col("__found"))))
    again = F.col("__lacking") & (F.col("total_quantity").isNull() | F.col("total_amount_rmb").isNull()) & (F.trim(text) != "")
    new = settled(new, __good=again & sound(F.col("__all"), True))
    second = {c: F.coalesce(F.col(c), F.when(F.col("__good"), F.col("__all")[i])) for i, c in enumerate(TAIL)}
    new = settled(new, **second, warehouse=F.coalesce("warehouse", F.when(F.col("__good"), F.col("__found"))))
    ratio = F.round(F.col("total_quantity") / F.col("qty_per_carton"), 3)
    short = (F.col("qty_per_carton") > 0) & F.col("total_quantity").isNotNull() & (F.col("total_cartons").isNull() | (F.col("total_cartons") > F.col("total_quantity")))
    new = settled(new, total_cartons=F.when(short, ratio).otherwise(F.col("total_cartons")))
    others = [c for c in rows.columns if c not in fields]
    return new.select(*others, *fields).unionByName(own.where("not __sales").select(*others, *fields))
