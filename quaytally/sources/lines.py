"""Documents as text lines (document_id, line_no, text) to rows: blocks, sections, subtotals and tails of numbers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.functions.columns import bound, joined_in_order, settled
from quaytally.functions.numbers import finite, integer, prefix_number

def marks_token(c: Column) -> Column:
    t = F.trim(T.text(c))
    # words such as TOTAL or CTN have neither digits nor hyphens
    return (F.length(t) >= 3) & ~t.contains(" ") & (t.contains("-") | t.rlike(r"\d")) & t.rlike("[A-Za-z]")


def blocks(lines: DataFrame, starts: Column) -> DataFrame:
    """document_id, block, first_line, text: the lines from each start to the next, joined by spaces."""
    window = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("block", F.sum(starts.cast("int")).over(window)).where("block > 0")
    text = joined_in_order("line_no", F.col("text"), " ")
    return numbered.groupBy("document_id", "block").agg(F.min("line_no").alias("first_line"), T.squeezed(text).alias("text"))


def number_before(c: Column, unit: str, nth: int = 1) -> Column:
    """The nth number before a unit word."""
    return prefix_number(F.try_element_at(F.regexp_extract_all(c, F.lit(rf"(?i)(\d+(?:\.\d+)?)\s*{unit}\b"), 1), F.lit(nth)))


def manifest_rows(lines: DataFrame) -> DataFrame:
    """Manifest rows out of text lines: a row goes from its marks to the next, on one line or many."""
    found = settled(blocks(lines, marks_token(F.col("text"))), rest=F.regexp_replace("text", r"^\S+\s+(?:SANCARGO\s+)?", ""))
    c = F.col("rest")
    packing = F.lower(F.regexp_replace(F.regexp_extract(c, r"(?i)\d+\s*[a-z]+\s*/\s*ctn", 0), r"\s", ""))
    amounts = F.regexp_extract_all(c, F.lit(r"[¥￥]\s*([\d,]+(?:\.\d+)?)"), 1)
    money = lambda i: prefix_number(F.replace(F.try_element_at(amounts, F.lit(i)), F.lit(","), F.lit("")))
    two = number_before(c, "CBM", 2)
    return found.select(
        "document_id", "first_line", F.regexp_extract("text", r"^(\S+)", 1).alias("marks"), packing.alias("packaging"), number_before(c, "CTNS?").alias("total_cartons"), number_before(F.regexp_replace(c, r"(?i)\d+\s*[a-z]+\s*/\s*ctn", ""), "pcs").alias("total_quantity"),
        F.coalesce(two, number_before(c, "CBM")).alias("total_cbm"), money(1).alias("unit_price_rmb"), money(2).alias("total_amount_rmb"),
    )


def flat_manifest_rows(texts: DataFrame) -> DataFrame:
    """Flattened manifests (document_id, text) split at each mark before SANCARGO; text from TOTAL on goes.

    One volume is the total, two are unit and total; a volume over ten times the cartons is dropped."""
    body = F.regexp_replace("text", r"(?is)\bTOTAL\s+(?:WEIGHT|CBM|CARTON|COST).*$", "")
    rows = texts.select("document_id", F.posexplode(F.split(body, r"(?<![A-Z0-9-])(?=[A-Z0-9]+(?:-[A-Z0-9]+)+\s+SANCARGO\b)")).alias("n", "row")).where(F.col("row").contains("SANCARGO"))
    cartons = number_before(F.col("row"), "CTNS?")
    volumes = F.filter(F.transform(F.regexp_extract_all("row", F.lit(r"(?i)(\d+(?:\.\d+)?)\s*CBM"), 1), lambda v: v.cast("double")), lambda v: v <= F.coalesce(cartons, F.lit(1e9)) * 10)
    return rows.select("document_id", "n", F.regexp_extract("row", r"^(\S+)", 1).alias("marks"), cartons.alias("total_cartons"), F.try_element_at(volumes, F.least(F.size(volumes), F.lit(2))).alias("total_cbm"))


# The order of the twelve numbers at the end of a sales row.
TAIL = ("total_cartons", "qty_per_carton", "total_quantity", "unit_price_rmb", "total_amount_rmb", "dim_l_cm", "dim_w_cm", "dim_h_cm", "unit_cbm", "unit_weight_kg", "total_cbm", "total_weight_kg")


# Forms of the cells of a manifest row, each with its unit as it is mostly written.
CELL_FORMS = {"packing": ("/ctn", r"(?i)^\d+\s*[a-z]+\s*/\s*ctn$"), "weight": ("KGS", r"(?i)^[\d.]+\s*KGS?$"), "volume": ("CBM", r"(?i)^[\d.]+\s*CBM$"), "cartons": ("CTNS", r"(?i)^\d+\s*CTNS?$"), "pieces": ("pcs", r"(?i)^\d+\s*pcs$")}


def cell_form(c: Column) -> Column:
    """The form of a trimmed cell, which has one at most. Patterns cost the most: that of the unit in it comes first."""
    found = F.when(c.startswith("¥") | c.startswith("￥"), "money").when((c < ".") | (c >= ":"), None)
    for form, (unit, pattern) in CELL_FORMS.items():
        found = found.when(c.contains(unit) & c.rlike(pattern), form)
    for form, (_, pattern) in CELL_FORMS.items():
        found = found.when(c.rlike(pattern), form)
    return found


def pattern_rows(rows: DataFrame) -> DataFrame:
    """Manifest rows out of `cells` that moved: each field is found by the form of its cells."""
    # told once for each cell, not again for each field
    rows = settled(rows, cells=F.col("cells"), forms=F.transform(F.transform("cells", lambda c: F.trim(c)), cell_form))
    first = lambda form: F.array_position("forms", form)
    second = lambda form: F.array_position(F.slice("forms", first(form) + 1, F.size("forms")), form)
    places = {
        "packaging": first("packing"), "total_cartons": first("cartons"), "total_quantity": first("pieces"), "total_cbm": first("volume") + second("volume"), "total_weight_kg": first("weight") + second("weight"),
        "unit_price_rmb": first("money"), "total_amount_rmb": F.when(second("money") > 0, first("money") + second("money")),
    }
    rows = settled(rows, **{c: F.get("cells", at - 1) for c, at in places.items()}).drop("cells", "forms")
    # other forms start with their number
    bare = lambda c: reduce(lambda x, sign: F.replace(x, F.lit(sign), F.lit("")), "¥￥ ,", F.col(c)) if c.endswith("_rmb") else F.trim(c)
    return rows.select(*(prefix_number(bare(c)).alias(c) if c in places and c != "packaging" else c for c in rows.columns))


# Forms of the cells of a manifest row, and of a cell that holds number, name and detail.
PACKING_TOKEN, PACKING_CELL = r"(?i)\d+\s*[A-Za-z]+\s*/\s*ctn", r"(?i)^\s*\d+\s*[A-Za-z]+\s*/\s*ctn\s*$"
DATA_CELL = r"(?i)^\s*(?:\d+\s*CTNS?|\d+\s*pcs|[\d.]+\s*(?:CBM|KGS)|[¥￥]\s*[\d,]+(?:\.\d+)?)\s*$"
ENGLISH_CELL, MERGED_CELL = r"^[A-Za-z][A-Za-z0-9\s.()/-]*$", r"(?s)^(\d+)?\s*([A-Za-z][A-Za-z0-9\s.()/-]*?)?\s*([\x{4e00}-\x{9fff}].*)?$"


def merged_cells(rows: DataFrame) -> DataFrame:
    """item_no, description and detail of manifest rows (`cells`) out of the cells before their data, and packing.

    A packing cell of several lines gives its other lines to these. A cell may hold number, English name and
    Chinese detail in one; each is taken the first time, further detail is joined."""
    rows = settled(rows, cells=F.transform("cells", lambda c: F.trim(T.text(c))))
    places = F.sequence(F.lit(2), F.size("cells") - 1)
    at = lambda i: F.get(F.col("cells"), i)
    packing = F.array_min(F.filter(places, lambda i: at(i).rlike(PACKING_TOKEN)))
    rows = settled(rows, packing_at=packing, data_at=F.coalesce(F.array_min(F.filter(places, lambda i: at(i).rlike(DATA_CELL) | at(i).rlike(PACKING_TOKEN))), F.size("cells")))
    blob = F.coalesce(F.get("cells", "packing_at"), F.lit(""))
    lines = F.filter(F.transform(F.split(blob, r"[\n\r]+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = settled(rows, blob=blob, lines=lines)
    own = F.coalesce(F.try_element_at(F.filter("lines", lambda x: x.rlike(PACKING_TOKEN)), F.lit(1)), F.lit(""))
    rows = settled(rows, own=own, mixed=(F.col("blob") != "") & ~F.col("blob").rlike(PACKING_CELL))
    prefix = F.trim(F.regexp_replace("own", PACKING_TOKEN, ""))
    more = F.when(F.col("mixed"), F.concat(F.filter("lines", lambda x: x != F.col("own")), F.filter(F.array(prefix), lambda x: x != ""))).otherwise(F.array().cast("array<string>"))
    before = F.filter(F.slice("cells", F.lit(3), F.greatest(F.col("data_at") - 2, F.lit(0))), lambda c: c != "")
    start = F.struct(F.lit("").alias("item_no"), F.lit("").alias("description"), F.lit("").alias("detail"))
    joined = lambda a, c: F.when(a == "", c).otherwise(F.concat_ws(" ", a, c))

    # what a cell may be is told once, not again for each use in a lambda
    told = lambda c: F.struct(c.alias("text"), c.rlike(r"^\s*\d+\s*$").alias("number"), c.rlike(ENGLISH_CELL).alias("name"), *(F.trim(F.regexp_extract(c, MERGED_CELL, i)).alias(f"part{i}") for i in (1, 2, 3)))

    def take(acc: Column, cell: Column) -> Column:
        c, parts = cell["text"], [cell[f"part{i}"] for i in (1, 2, 3)]
        number = (acc["item_no"] == "") & cell["number"]
        name = ~number & (acc["description"] == "") & cell["name"]
        several = ~number & ~name & (sum(((p != "").cast("int") for p in parts), F.lit(0)) >= 2)
        kept = lambda old, part: F.when(several & (old == "") & (part != ""), part).otherwise(old)
        return F.struct(
            F.when(number, F.trim(c)).otherwise(kept(acc["item_no"], parts[0])).alias("item_no"),
            F.when(name, c).otherwise(kept(acc["description"], parts[1])).alias("description"),
            F.when(number | name | (several & (parts[2] == "")), acc["detail"]).when(several, joined(acc["detail"], parts[2])).otherwise(joined(acc["detail"], c)).alias("detail"),
        )

    token = F.regexp_replace(F.regexp_extract("own", PACKING_TOKEN, 0), r"\s+", "")
    rows = settled(rows, packing=F.when(F.col("mixed"), token).otherwise(F.col("blob")), found=F.aggregate(F.transform(F.concat(before, more), told), start, take))
    return rows.select(*(c for c in rows.columns if c not in ("cells", "packing_at", "data_at", "blob", "lines", "own", "mixed", "found")), "found.*")


def subtotal_bars(lines: DataFrame) -> DataFrame:
    """Lines of the form nCTN nCBM nKGS ¥n, as subtotals."""
    bar = F.regexp_replace("text", ",", "")
    forms = {"cartons": r"(?i)(\d+)\s*CTNS?\b", "cbm": r"(?i)(\d+(?:\.\d+)?)\s*CBM\b", "kg": r"(?i)(\d+(?:\.\d+)?)\s*KGS?\b", "rmb": r"[¥￥]\s*(\d+(?:\.\d+)?)"}
    found = lines.select("document_id", "line_no", "text", *(prefix_number(F.regexp_extract(bar, p, 1)).alias(k) for k, p in forms.items()))
    some = sum((F.col(k).isNotNull().cast("int") for k in forms), F.lit(0))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w.rlike("^[A-Za-z]{3,}$")))
    return found.where((some >= 3) & (words < 5) & ~F.col("text").rlike(r"(?i)pcs\s*/\s*ctn"))


# A section's printed total, the banner of stuffed goods, and words of lines that are no totals.
STAGE_TOTAL = r"(?i)(\d+\s*CTNS?).*?([\d.]+\s*CBM).*?([\d.]+\s*KGS)(?:.*?([¥￥]\s*[\d,]+(?:\.\d+)?))?"
STUFFED_BANNER = r"(?i)GOODS\s+STUFFED\s+INTO\s+THIS\s+CONTAINER"
LABELLED_LINES = ("MARKS", "DESCRIPTION OF GOODS", "CLIENT DETAILS", "CONTAINER NO", "CUSTOMER CARE", "COMPLAINTS LINE", "NEW ORDER", "GOODS LEFT IN SANCARGO", "GOODS BALANCE", "TOTAL WEIGHT", "TOTAL CBM", "TOTAL CARTON", "TOTAL COST", "BALANCE PAYMENT", "PAGE:", "PAYMENT", "USD", "RMB", "EXCHANGE RATE")


def stage_lines(lines: DataFrame) -> DataFrame:
    """Lines (document_id, line_no, text) of the goods shipped, with stage_total where a line, or it and the next one,
    prints a section's total.

    The banner of stuffed goods or the header of goods left, which may go on in the next line, ends them."""
    order = Window.partitionBy("document_id").orderBy("line_no")
    rows = lines.withColumn("after", T.squeezed(F.concat_ws(" ", "text", F.lead("text").over(order))))
    left = lambda c: F.coalesce(T.opens_goods_left(c), F.lit(False))
    ends = F.col("text").rlike(STUFFED_BANNER) | left(F.col("text")) | left(F.col("after"))
    rows = settled(rows, ends=ends).withColumn("past", F.max(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("past = 0")
    part = lambda c, i: F.regexp_replace(F.regexp_extract(c, STAGE_TOTAL, i), r"\s+", "")
    total = lambda c: F.when(c.rlike(STAGE_TOTAL), F.concat_ws(" ", *(F.upper(part(c, i)) for i in (1, 2, 3)), F.nullif(part(c, 4), F.lit(""))))
    open_ = ~F.col("text").rlike(r"(?i)\bSANCARGO\b") & ~T.any_of([F.upper("text").contains(w) for w in LABELLED_LINES])
    return rows.withColumn("stage_total", F.when(open_, F.coalesce(total(F.col("text")), total(F.col("after"))))).drop("after", "ends", "past")


# How lines begin that open a row.
ROW_ANCHORS = r"(?i)^MS-\d{2,4}-\d{1,4}\b|^\d{1,4}[.)]\s|^ITEM\s*NO\.?|^[A-Z0-9]{2,6}-[A-Z0-9]{1,6}-\d{1,5}\b"


def chunks(lines: DataFrame, rows: int = 120, most: int = 1400, overlap: int = 40) -> DataFrame:
    """Pieces of a document's lines that are not blank. A piece ends before a row anchor once it has `rows` anchors,
    and before any line once it has `most` lines; the next one repeats its last `overlap` lines, anchors included.

    Where a piece ends depends on the piece before, so each document is cut line by line, many documents a batch."""

    def ends(anchors: list[bool]) -> list[tuple[int, int]]:
        before = [0, *accumulate(anchors)]
        out, begin = [], 0
        for i, anchor in enumerate(anchors):
            if anchor and i > begin and (before[i] - before[begin] >= rows or i - begin >= most):
                out.append((begin, i))
                begin = max(begin, i - overlap)
            if i - begin >= most:
                out.append((begin, i))
                begin = max(begin, i - overlap)
        return [*out, (begin, len(anchors))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for document, numbers, anchors, texts in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(document, n, numbers[a], numbers[b - 1], "\n".join(texts[a:b])) for n, (a, b) in enumerate(ends(anchors))]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["document_id", "chunk", "first_line", "last_line", "text"])

    text = F.trim("text")
    own = lines.where(text != "").select(F.col("document_id").cast("long"), F.struct(F.col("line_no").cast("long").alias("line_no"), text.rlike(ROW_ANCHORS).alias("is_anchor"), text.alias("text")).alias("line"))
    documents = own.groupBy("document_id").agg(F.sort_array(F.collect_list("line")).alias("l")).select("document_id", *(F.col("l")[c].alias(c) for c in ("line_no", "is_anchor", "text")))
    return documents.mapInArrow(cut, "document_id long, chunk int, first_line long, last_line long, text string")


def fragments_to_lines(fragments: DataFrame, bucket: float = 4.0) -> DataFrame:
    """Positional fragments (document_id, page, x, y, text) to lines, left to right: document_id, page, row, text.

    y grows upwards, so a page's first line is the one with the largest row."""
    row = F.floor(F.col("y") / bucket + 0.5).cast("long")
    # one shuffle by document serves the lines and all that is done along a document's lines
    fragments = fragments.repartition("document_id")
    text = joined_in_order("x", F.trim("text"), " ")
    return fragments.where(F.trim("text") != "").groupBy("document_id", "page", row.alias("row")).agg(T.squeezed(text).alias("text"))


PACKED = r"(?i)\d+\s*[A-Za-z]+\s*/\s*ctn"


def manifest_lines_joined(lines: DataFrame) -> DataFrame:
    """Lines (document_id, page, row, text) whose parts stood at slightly different heights, as one line.

    A line of marks alone joins the SANCARGO line after it, also over a page's end. A SANCARGO line without
    packing then takes the next line of its page, if that is no row of its own."""
    shipped = lambda c: F.coalesce(c.rlike(r"(?i)\bSANCARGO\b"), F.lit(False))
    starts = lambda c: F.coalesce(c.rlike(r"(?i)^\s*SANCARGO\b"), F.lit(False))
    marks = lambda c: F.coalesce(T.valid_marks(c), F.lit(False))
    order = Window.partitionBy("document_id").orderBy("page", F.desc("row"))
    before, text = F.lag("text").over(order), F.col("text")
    opens = lambda c: marks(c) & ~shipped(c)
    rows = lines.withColumn("before", before).withColumn("after", F.lead("text").over(order))
    rows = rows.where(~(opens(text) & starts(F.col("after"))))
    rows = rows.withColumn("text", F.when(opens(F.col("before")) & starts(text), F.concat_ws(" ", "before", "text")).otherwise(text)).drop("before", "after")
    page = Window.partitionBy("document_id", "page").orderBy(F.desc("row"))
    rows = rows.withColumn("before", F.lag("text").over(page)).withColumn("after", F.lead("text").over(page))
    short = lambda c: shipped(c) & ~c.rlike(PACKED)
    loose = lambda c: F.coalesce(~marks(F.regexp_extract(c, r"^\s*(\S*)", 1)) & ~shipped(c), F.lit(False))
    taken = short(F.col("before")) & loose(text)
    extended = F.when(short(text) & loose(F.col("after")), F.concat_ws(" ", "text", "after")).otherwise(text)
    return rows.withColumn("gone", taken).withColumn("text", extended).where("not gone").drop("before", "after", "gone")


#: Twelve numbers, a barcode and a warehouse at the end of a sales row.
SALES_TAIL = r"^(.*?)((?:\s+\d+(?:\.\d+)?){12})\s+(\S+)\s+(\S+)$"


def sales_rows(lines: DataFrame) -> DataFrame:
    """Sales rows out of text lines: a row goes from "n yyyy-mm-dd" to the next."""
    found = blocks(lines, F.col("text").rlike(r"^\d{1,4}\s+\d{4}-\d{2}-\d{2}$"))
    # one match gives all parts, apart by line breaks: a squeezed text has none
    found = settled(found, parts=F.split(F.regexp_replace(F.regexp_replace("text", r"^(\d+)\s+\S+\s+", ""), SALES_TAIL, "$1\n$2\n$3\n$4"), "\n"))
    part = lambda i: F.when(F.size("parts") == 4, F.col("parts")[i - 1]).otherwise("")
    found = settled(found, head=part(1), numbers=F.split(F.trim(part(2)), r"\s+"))
    head = F.regexp_extract("head", r"^(\S+)\s+(\S+)\s*(.*)$", 2), F.regexp_extract("head", r"^(\S+)\s+(\S+)\s*(.*)$", 3)
    return found.select(
        "document_id", F.regexp_extract("text", r"^(\d+)", 1).cast("long").alias("line_no"), F.regexp_extract("head", r"^(\S+)", 1).alias("delivery_no"), head[0].alias("item_code"), head[1].alias("description"),
        *(F.try_element_at("numbers", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(TAIL)), part(3).alias("barcode"), part(4).alias("warehouse"),
    )


# What an extractor's JSON says of a product and of a document.
PRODUCT_TEXTS = ("marks", "shop", "description", "packaging", "barcode", "warehouse", "remarks", "delivery_no", "customer_item_ref", "unit", "product_name_local", "material")
PRODUCT_NUMBERS = ("qty_per_carton", "total_cartons", "total_qty", "unit_price_rmb", "total_amount_rmb", "dim_l_cm", "dim_w_cm", "dim_h_cm", "unit_cbm", "total_cbm", "unit_weight_kg", "total_weight_kg")
PRODUCT_INTEGERS = ("line_no", "box_no_start", "box_no_end")
DOCUMENT_TEXTS = ("doc_number", "client_id", "container_no", "document_date")
DOCUMENT_NUMBERS = ("total_cartons", "total_cbm", "total_weight_kg", "total_amount_rmb", "total_amount_usd", "exchange_rate", "goods_balance_usd", "freight_usd", "total_balance_usd")
DOCUMENT_TYPES = {"sales_order": "sales_order", "container_manifest": "container_manifest", "packing_list": "container_manifest"}
PAYMENT_TYPES = ("deposit", "balance", "freight", "credit", "other")


def _number(c: Column) -> Column:
    return finite(F.regexp_replace(c, "[¥￥,%]", ""))


def extracted(rows: DataFrame, body: str) -> DataFrame:
    """A product's extractor JSON (all values read as text) as typed columns; empty, null and odd values are null."""
    names = (*PRODUCT_TEXTS, *PRODUCT_NUMBERS, *PRODUCT_INTEGERS, "source_item_no", "item_code", "section")
    parsed = rows.withColumn("p", F.from_json(body, ", ".join(f"{f} string" for f in names) + ", source_cells map<string,string>"))
    text = {c: T.clean(F.col(f"p.{c}")) for c in PRODUCT_TEXTS}
    number = {"total_quantity" if c == "total_qty" else c: _number(F.col(f"p.{c}")) for c in PRODUCT_NUMBERS}
    whole = {c: integer(F.col(f"p.{c}")) for c in PRODUCT_INTEGERS}
    sku = T.sku_fields(T.clean(F.col("p.source_item_no")), T.clean(F.col("p.item_code")))
    cells = F.map_filter(F.transform_values("p.source_cells", lambda k, v: T.clean(v)), lambda k, v: v.isNotNull())
    other = {"item_code": sku["item_code"], "source_item_no": sku["source_item_no"], "section": F.coalesce(T.clean(F.col("p.section")), F.lit("shipped")), "source_cells": F.when(F.size(cells) > 0, cells)}
    return parsed.withColumns(text | number | whole | other).drop("p", body)


def extracted_documents(rows: DataFrame, body: str) -> DataFrame:
    """A document's extractor JSON as typed columns, printed totals among them, and its payments as an array; payments without an amount go."""
    totals = ", ".join(f"{f}: string" for f in DOCUMENT_NUMBERS)
    schema = ", ".join(f"{f} string" for f in (*DOCUMENT_TEXTS, "document_type")) + f", footer_totals struct<{totals}>, payments array<struct<payment_date: string, amount_usd: string, payment_type: string>>"
    parsed = rows.withColumn("p", F.from_json(body, schema))
    kind = F.coalesce(*(F.when(F.col("p.document_type") == k, v) for k, v in DOCUMENT_TYPES.items()), F.lit("unknown"))
    payment = lambda x: F.struct(T.clean(x["payment_date"]).alias("payment_date"), _number(x["amount_usd"]).alias("amount_usd"), F.when(x["payment_type"].isin(*PAYMENT_TYPES), x["payment_type"]).otherwise("other").alias("payment_type"))
    payments = F.filter(F.transform(F.coalesce("p.payments", F.array()), payment), lambda x: x["amount_usd"].isNotNull())
    columns = {c: T.clean(F.col(f"p.{c}")) for c in DOCUMENT_TEXTS} | {"document_type": kind} | {c: _number(F.col(f"p.footer_totals.{c}")) for c in DOCUMENT_NUMBERS} | {"payments": payments}
    return parsed.withColumns(columns).drop("p", body)


# A priced row in a manifest's flat text, and the marks of such rows.
PRICED_ROW = r"(?i)(MAG-512-\d+)\s+SANCARGO\s+(.+?)\s+(\d+)\s+(Food\s+warmer\s+[A-Z0-9-]+)\s+(\d+)\s*pcs[\s\S]{0,80}?[¥￥]\s*([\d,]+(?:\.\d+)?)\s+[¥￥]\s*([\d,]+(?:\.\d+)?)"
PRICED_MARKS = r"(?i)^MAG-512-\d+\b"


def priced_rows(texts: DataFrame, text: str = "text") -> DataFrame:
    """Priced rows in documents' flat texts: document_id, n, marks, shop, item_code, description, total_quantity, unit_price_rmb, total_amount_rmb."""
    flat = T.squeezed(T.text(text))
    parts = F.arrays_zip(*(F.regexp_extract_all(flat, F.lit(PRICED_ROW), i).alias(f"g{i}") for i in range(1, 8)))
    rows = texts.select("document_id", F.posexplode(parts).alias("n", "p"))
    number = lambda i: prefix_number(F.replace(F.col(f"p.g{i}"), F.lit(","), F.lit("")))
    name = lambda i: F.nullif(F.trim(f"p.g{i}"), F.lit(""))
    return rows.select("document_id", "n", F.concat("p.g1", F.lit(" SANCARGO")).alias("marks"), name(2).alias("shop"), name(3).alias("item_code"), name(4).alias("description"), number(5).alias("total_quantity"), number(6).alias("unit_price_rmb"), number(7).alias("total_amount_rmb")).where("total_quantity > 0")


# Where a document's text names its facts; of several forms the first that is found counts.
NAMES = {
    "container_no": (r"(?i)CONTAINER\s+NO\.?\s*[:\s]+([A-Z]{4}\d{7,})", r"(?i)CONT(?:AINER)?\s*#?\s*[:\s]+([A-Z0-9]{9,})"),
    "client_id": (r"(?i)CLIENT\s+DETAILS\s*[:\s]+([^\n\r]{2,80}?)(?:\s+CONTAINER|\s{2,}|$)", r"(?i)CLIENT\s*(?:DETAILS|ID|NAME|NO)?\.?\s*[:\s]+([^\n\r,]{2,80})", r"客户[：:]\s*([^\s,，]{2,40})"),
    "doc_number": (r"(?i)(?:ORDER\s*NO|MANIFEST\s*NO|REF\s*NO|DOC\s*NO)\.?\s*[:\s]+([A-Z0-9-]+)", r"\bNO[:\s]+([A-Z][A-Z0-9]*\d+-\d+)\b"),
    "document_date": (r"(?i)DATE\s*[:\s]+(\d{4}[-/]\d{1,2}[-/]\d{1,2})", r"销售日期[：:]\s*(\d{4}-\d{2}-\d{2})", r"(\d{4}[-/]\d{2}[-/]\d{2})"),
}
SALES_TOTALS = r"(?i)TOTAL[:\s]+(\d+)\s+(\d+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)"
#: Forms in the whole text, the form in the line of totals, and the place among the five numbers of a sales order.
TOTALS = {
    "total_cartons": ((r"(?i)TOTAL\s+CARTONS?\s*[:\s]*([\d,]+)",), r"(?i)(\d+(?:\.\d+)?)\s*CTNS?", 1),
    "total_cbm": ((r"(?i)TOTAL\s+CBM\s*[:\s]*([\d.]+)",), r"(?i)(\d+(?:\.\d+)?)\s*CBM", 4),
    "total_weight_kg": ((r"(?i)TOTAL\s+WEIGHT\s*[:\s]*([\d,]+)",), r"(?i)(\d+(?:\.\d+)?)\s*KGS?", 5),
    "total_amount_rmb": ((r"(?i)TOTAL\s+COST\s*[:\s]*RMB\s*([\d,]+)", r"(?i)TOTAL\s+COST[^\d]{0,24}([\d,]{4,})"), r"[¥￥]([\d.]+)", 3),
}
AMOUNTS = {
    "exchange_rate": r"(?i)(?:EXCHANGE\s+RATE|RATE)\s*[:\s]+([\d.]+)",
    "freight_usd": r"(?i)FREIGHT.*?USD\s+([\d.]+)",
    "total_balance_usd": r"(?i)(?:TOTAL\s+BALANCE|BALANCE\s+TOTAL).*?USD\s+([\d.]+)",
}
DOLLARS = r"(?i)\$\s*([\d.]+)|USD\s*[:-]?\s*([\d.]+)"
FREIGHT_PAYMENT, LATER_PAYMENT = r"(?i)\b(?:FREIGHT\s+PAYMENT|PAYMENT\s+FOR\s+FREIGHT|PAYMENT[^\n]{0,32}FREIGHT)\b", r"(?i)BALANCE|SECOND|REMAINING"
FLAT_PAYMENT = r"(?i)(\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\s*PAYMENT[\s\S]{0,60}?\$\s*([\d,]+(?:\.\d+)?)"
LEAST_TOTAL_USD = 1000


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(_part(c, pattern, group), F.lit(""))


def _part(c: Column, pattern: str, group: int = 1) -> Column:
    return F.trim(F.regexp_extract(c, pattern, group))


def _amount(c: Column) -> Column:
    return prefix_number(F.replace(c, F.lit(","), F.lit("")))


def dollars_near(c: Column, anchor: str, reach: int) -> Column:
    """The first amount of dollars within `reach` characters from the anchor on."""
    near = bound(F.locate(anchor, F.upper(c)), lambda at: F.replace(F.when(at > 0, F.substring(c, at, F.lit(reach))), F.lit(","), F.lit("")))
    amount = bound(near, lambda x: F.coalesce(_amount(_part(x, DOLLARS)), _amount(_part(x, DOLLARS, 2))))
    return bound(amount, lambda x: F.when(x > 0, x))


def printed_date(c: Column) -> Column:
    """yyyy-mm-dd of a date in a text: year first or day first, of this century, with a possible month and day."""
    forms = ((r"\b(\d{4})[/-](\d{1,2})[/-](\d{1,2})\b", (1, 2, 3)), (r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", (3, 2, 1)))

    def one(pattern: str, order: tuple[int, int, int]) -> Column:
        y, m, d = (_found(c, pattern, i).cast("int") for i in order)
        return F.when((y >= 2000) & m.between(1, 12) & d.between(1, 31), F.format_string("%d-%02d-%02d", y, m, d))

    return F.coalesce(*(one(*f) for f in forms))


def document_parts(chunks: DataFrame, html: str = "html") -> DataFrame:
    """document_id, header (the texts above the first table), footer (those below it) and text (header, footer, then all
    chunks without tags, tables too) of documents (document_id, chunk, html), a line for each chunk."""
    plain = T.squeezed(F.regexp_replace(T.text(html), "<[^>]+>", " "))
    rows = settled(chunks.select("document_id", "chunk", html), plain=plain, is_table=F.coalesce(F.col(html).rlike(r"(?i)<table[\s>]"), F.lit(False)))
    found = rows.where("plain <> '' or is_table").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "plain", "is_table"))).alias("parts"), F.min(F.when(F.col("is_table"), F.col("chunk"))).alias("first"))
    joined = lambda keep: F.array_join(F.transform(F.filter("parts", lambda p: keep(p) & (p["plain"] != "")), lambda p: p["plain"]), "\n")
    above = lambda p: F.coalesce(p["chunk"] < F.col("first"), F.lit(True))
    found = found.select("document_id", joined(lambda p: ~p["is_table"] & above(p)).alias("header"), joined(lambda p: ~p["is_table"] & ~above(p)).alias("footer"), joined(lambda p: F.lit(True)).alias("all"))
    return found.select("document_id", "header", "footer", F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in ("header", "footer", "all"))).alias("text"))


def document_facts(documents: DataFrame, text: str, header: str | None = None, footer: str | None = None) -> DataFrame:
    """What a document's text says about the document: names, printed totals, amounts in dollars.

    Where the document is in parts (see document_parts), its labelled date comes from the header and its line of totals from the footer."""
    parts = {"flat": T.squeezed(T.text(text)), "lines": F.split(T.text(text), "\n"), "last_lines": F.split(T.text(footer or text), "\n"), "head": T.text(header or text)}
    # a file's rows are dealt over all tasks: texts cost much more than their shuffle
    rows = settled(documents.select("document_id", *dict.fromkeys((text, header or text, footer or text))).repartition("document_id"), **parts).select("document_id", *parts)
    flat, lines, last_lines = F.col("flat"), F.col("lines"), F.col("last_lines")
    metric = lambda x: x.rlike("(?i)CTN|CBM|KGS")
    totals_line = F.coalesce(F.try_element_at(F.filter(last_lines, lambda x: x.rlike("(?i)TOTAL") & metric(x)), F.lit(1)), F.try_element_at(F.filter(last_lines, metric), F.lit(1)), F.lit(""))
    rows = settled(rows, clean=F.replace(flat, F.lit(","), F.lit("")), totals_line=totals_line)
    rows = settled(rows, totals_clean=F.replace("totals_line", F.lit(","), F.lit("")))
    clean, own_line = F.col("clean"), lambda c: F.col("totals_clean" if c == "total_amount_rmb" else "totals_line")
    names = {c: F.coalesce(*(_found(flat, p) for p in patterns)) for c, patterns in NAMES.items()}
    if header:
        labelled, *others = NAMES["document_date"]
        names["document_date"] = F.coalesce(_found(F.col("head"), labelled), *(_found(flat, p) for p in others))
    names["document_date"] = F.replace(names["document_date"], F.lit("/"), F.lit("-"))
    totals = {
        c: F.coalesce(*(_amount(_part(clean if c == "total_amount_rmb" else flat, p)) for p in patterns), _amount(_part(own_line(c), own)), bound(_amount(_part(clean, SALES_TOTALS, i)), lambda x: F.when(x != 0, x)))
        for c, (patterns, own, i) in TOTALS.items()
    }
    near = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(r"(?i)TOTAL\s+COST") & x.rlike("(?i)USD")), lambda x: dollars_near(F.replace(x, F.lit(","), F.lit(" ")), "TOTAL COST", 90)), lambda v: v >= LEAST_TOTAL_USD)
    anywhere = bound(dollars_near(flat, "TOTAL COST", 140), lambda x: F.when(x >= LEAST_TOTAL_USD, x))
    dollars = {"total_amount_usd": F.coalesce(F.try_element_at(near, F.lit(1)), anywhere)}
    amounts = {c: _amount(_part(flat if c == "exchange_rate" else clean, p)) for c, p in AMOUNTS.items()}
    return rows.select("document_id", *(v.alias(c) for c, v in (names | totals | dollars | amounts).items()))


def document_payments(documents: DataFrame, text: str) -> DataFrame:
    """document_id, n, payment_date, amount_usd, payment_type: lines that tell of a payment; where none does, dated payments anywhere."""
    entry = lambda date, amount, kind: F.struct(date.alias("payment_date"), amount.alias("amount_usd"), kind.alias("payment_type"))
    kind = lambda x: F.when(x.rlike(FREIGHT_PAYMENT), "freight").when(x.rlike(LATER_PAYMENT), "balance").otherwise("deposit")
    paid = lambda rows: F.filter(rows, lambda r: r["amount_usd"] > 0)
    lines = F.filter(F.split(T.text(text), "\n"), lambda x: x.rlike(r"(?i)\bPAYMENT\b"))
    by_line = paid(F.transform(lines, lambda x: entry(printed_date(x), dollars_near(x, "PAYMENT", 60), kind(x))))
    flat = T.squeezed(T.text(text))
    dated = F.arrays_zip(F.regexp_extract_all(flat, F.lit(FLAT_PAYMENT), 1).alias("d"), F.regexp_extract_all(flat, F.lit(FLAT_PAYMENT), 2).alias("a"))
    anywhere = paid(F.transform(dated, lambda z: entry(printed_date(z["d"]), _amount(z["a"]), F.lit("deposit"))))
    rows = documents.select("document_id", by_line.alias("lines"), anywhere.alias("anywhere"))
    return rows.select("document_id", F.posexplode(F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.col("anywhere"))).alias("n", "p")).select("document_id", "n", "p.*")
