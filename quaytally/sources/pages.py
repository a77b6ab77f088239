"""From pages to products: one walk over all grids of a document, as windows over its rows.

A document is a sequence of chunks (page texts or HTML). Rows of its tables are classified one by one; what carries
over (section, label, carried-over flag, marks, line numbers) are running values over the document, a table or a block of
a table. Nothing is partitioned by more than a document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaytally.functions import numbers as N
from quaytally.functions import text as T
from quaytally.functions.columns import bound, compiled, settled
from quaytally.functions.headers import CONTAINER_LABELS, SALES_LABELS, SKIP
from quaytally.operators import order, rules, shifts
from quaytally.sources import grids, sales as X

TEXT_FIELDS = ("marks", "shop", "item_code", "source_item_no", "delivery_no", "customer_item_ref", "unit", "product_name_local", "material", "description", "packaging", "barcode", "warehouse", "remarks")
NUMBER_FIELDS = ("qty_per_carton", "total_cartons", "total_quantity", "unit_price_rmb", "total_amount_rmb", "dim_l_cm", "dim_w_cm", "dim_h_cm", "unit_cbm", "total_cbm", "unit_weight_kg", "total_weight_kg")
PRODUCT = ("document_id", "line_no", "section", *TEXT_FIELDS, *NUMBER_FIELDS, "box_no_start", "box_no_end")
FIELDS = tuple(dict.fromkeys(f for f in (*CONTAINER_LABELS.values(), *SALES_LABELS) if f != SKIP and f != "line_no"))
LEAST_SCORE = 3

# Codes and remarks of rows kept for review, by kind of row, and the section that a header opens.
EXTRACT_CODE, SUBTOTAL_CODE, FOOTER_CODE = "__FULL_EXTRACT__", "__SECTION_SUBTOTAL__", "__FOOTER__"
REMARKS = {"new_order": "new_order", "before_goods": "before_goods", "goods_left": "goods_left", "repacked": "repacked", "stuffed": "stuffed_container", "unknown": "unknown_section_banner", "total": "total_label", "noise": "new_order_cells", "text": "text_block", "unmapped": "unmapped_table_row"}
SECTIONS = {"new_order": "shipped", "before_goods": "left_in_warehouse", "goods_left": "left_in_warehouse", "repacked": "repacked", "stuffed": "shipped"}
BEFORE_GOODS_REMARK = "carryover:before_goods"
TOTAL_LABELS = r"(?i)^(GRAND\s+)?TOTAL\s*[:\s]*$", "^(小计|合计|总计)"
HEADLESS_CELLS, HEADLESS_CELL = 8, re.compile(r"\bSANCARGO\b|\bRGO\b|\bMS-[A-Z0-9-]+\b|\b[0-9]+-T-[A-Z0-9-]+\b", re.I)
HEADER_ROWS = 8
# Marks that stand in another cell, and what a cell with marks never holds.
MARKS_ALONE = r"(?i)\bMS-[A-Z0-9]+(?:-[A-Z0-9]+)+\s+SANCARGO\b|\b\d+-T-[A-Z0-9]+-\d+\s+SANCARGO\b|^VICHAS$|^M\s+DUSS\b"
MARKS_NAMED, CARTONS_IN_CELL = r"(?i)^\s*MOSES\b", r"(?i)\d+\s*CTNS?\b"
MARKS_SHORT, NO_MARKS_IN_CELL, MOST_MARKS, MOST_SHORT_MARKS = r"(?i)\bSANCARGO\b", r"(?i)\d+\s*pcs|\bCTNS?\b", 160, 88
#: A row with marks in another cell holds one of these.
MARKS_WORDS = ("SANCARGO", "VICHAS", "DUSS", "MOSES")
PRODUCT_LIKE_LABEL = 82


def inferred_marks(cells: Column) -> Column:
    """The first cell that looks like marks."""
    named = lambda c: c.rlike(MARKS_NAMED) & ~c.rlike(CARTONS_IN_CELL)
    short = lambda c: c.rlike(MARKS_SHORT) & (F.length(c) < MOST_SHORT_MARKS) & ~c.rlike(NO_MARKS_IN_CELL)
    return F.get(F.filter(cells, lambda c: (c != "") & (F.length(c) <= MOST_MARKS) & (c.rlike(MARKS_ALONE) | named(c) | short(c))), F.lit(0))


def section_key(label: Column) -> Column:
    """The section that an unknown banner opens: its letters and digits, joined by underscores."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("shipped"))


def product_like(label: Column) -> Column:
    """Whether a cleaned label is a product row that was taken for a banner, and no remark."""
    yen = label.rlike("[¥￥]")
    priced = yen & (label.rlike(r"(?i)\bCBM\b|\bKGS\b") | label.rlike(r"\d+\s*-\s*\d+\s*$"))
    coded = label.rlike(r"(?i)MAG-\d{3}-\d+|MS-\d{3}-\d+") & (yen | label.rlike(r"(?i)\b\d+\.?\d*\s*CBM\b"))
    return priced | (F.length(label) >= PRODUCT_LIKE_LABEL) | coded


def _last_runs(columns: list[str | None]) -> dict[str, list[int]]:
    """Where columns name each field: places of the last stretch that no other field interrupts; unnamed columns don't."""
    runs: dict[str, list[int]] = {}
    before = None
    for i, field in enumerate(columns):
        if field is not None:
            runs[field] = [*runs[field], i] if field == before else [i]
            before = field
    return runs


def _joined(cells: list[str]) -> str:
    """Neighbouring cells of one field as one text; a cell equal to what stands before it counts once."""
    if len(cells) == 1:
        return cells[0].strip()
    whole = ""
    for c in map(str.strip, cells):
        whole = f"{whole} {c}" if c and whole and c != whole else whole or c
    return whole


ROWS = [pa.field("piece", pa.int32()), pa.field("row", pa.int32()), pa.field("cells", pa.list_(pa.string())), pa.field("mapped", pa.bool_()), pa.field("line", pa.string()), pa.field("alone", pa.bool_()), *(pa.field(f"r_{f}", pa.string()) for f in FIELDS)]
NO_FIELDS, PLACES = (None,) * len(FIELDS), {f: i for i, f in enumerate(FIELDS)}
#: Rows of a batch, about.
BATCH_ROWS = 10_000


def _more_rows(grid: list[list[str]]) -> bool:
    """Whether a table without a header looks like more rows of the table before it."""
    top = grid[0] if grid else []
    return sum(c != "" for c in top) >= HEADLESS_CELLS and any(map(HEADLESS_CELL.search, top))


def _rows_of_chunk(html: str | None, sales: bool) -> Iterator[tuple]:
    """ROWS of a chunk: its texts, and the rows of its tables that are not blank, with r_<field> (see table_rows)."""
    pieces = grids.pieces_of(html)
    alone = all(grid is None for _, grid in pieces)
    before = None
    for piece, (text, grid) in enumerate(pieces):
        if grid is None:
            yield piece, -1, None, None, text, alone, *NO_FIELDS
            continue
        score, _, first, own, names = grids.header_of(grid, sales, HEADER_ROWS)
        if score >= LEAST_SCORE:
            before = own
        else:
            first, names = 0, before if _more_rows(grid) else None
            if len(grid) < 2 and names is None:
                continue
        if len(grid) < 2 and score >= LEAST_SCORE:
            continue
        runs = [(PLACES[f], at) for f, at in _last_runs(names or []).items() if f in PLACES]
        known = [i for i, f in enumerate(names or []) if f is not None]
        fits = not known or len(grid[0]) == known[-1] + 1  # rows of a table are equally long
        for row, cells in enumerate(grid[first:], first):
            line = " ".join(filter(None, cells))
            if line.strip():
                fields, aligned = [*NO_FIELDS], cells if fits else grids.aligned(cells, names, sales)
                for place, at in runs:
                    fields[place] = _joined([aligned[k] for k in at if k < len(aligned)])
                yield piece, row, cells, names is not None, line, None, *fields


def table_rows(chunks: DataFrame, sales: bool, html: str = "html") -> DataFrame:
    """document_id, chunk, piece, row, cells (as printed), r_<field> (null where the table has no such column), line (a row's cells in one
    line, or a piece that is no table), alone (whether the chunk has no table), mapped (whether the table's columns are known, null
    for a piece that is no table).

    A table without a header takes the columns of the one before it in its chunk, if it looks like more of its rows.
    A chunk is read in one go, so no row is shuffled here."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            for i, page in enumerate(batch.column(2)):
                found = list(_rows_of_chunk(page.as_py(), sales))
                at += [i] * len(found)
                out += found
                if len(out) >= BATCH_ROWS or i + 1 == batch.num_rows:
                    own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(2)]
                    new = [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(ROWS), ROWS)]
                    yield pa.RecordBatch.from_arrays([*own, *new], names=["document_id", "chunk", *(f.name for f in ROWS)])
                    at, out = [], []

    types = dict(chunks.dtypes)
    schema = f"document_id {types['document_id']}, chunk {types['chunk']}, piece int, row int, cells array<string>, mapped boolean, line string, alone boolean, " + ", ".join(f"r_{f} string" for f in FIELDS)
    return chunks.select("document_id", "chunk", html).mapInArrow(read, schema)


def _kinds(rows: DataFrame) -> DataFrame:
    """rows with upper (the line in capitals) and kind: that of a section header, total, subtotal, footer, noise, text, unmapped or product.

    Texts of a row's fields are parts of its line, so a pattern that needs a word is tried where the line has the word."""
    r, line, upper = lambda f: F.col(f"r_{f}"), F.col("line"), F.col("upper")
    # columns that the next step reads more than once stay a projection of their own
    rows = rows.withColumn("upper", F.upper("line")).withColumn("header", T.kind_of_line(line, upper))
    first = F.trim(T.text(F.get(F.col("cells"), F.lit(0))))
    number = lambda f: N.cell(r(f))
    blob = T.may_hold_totals(upper) & T.totals_blob(line, r("description"), r("marks"), r("item_code"), r("shop"))
    subtotal = T.subtotal_text(line, upper) | T.subtotal_fields(r("description"), r("item_code"), number("total_cartons"), number("total_quantity"), number("total_amount_rmb")) | blob
    footer = T.may_be_footer(upper) & _footer(F.concat_ws(" ", r("marks"), r("description"), r("item_code"), r("shop"), line))
    kind = (
        F.when(F.col("mapped").isNull(), "text").when(~F.col("mapped"), "unmapped").when(F.col("header").isNotNull(), F.col("header")).when(first.rlike(TOTAL_LABELS[0]) | first.rlike(TOTAL_LABELS[1]), "total")
        .when(subtotal, "subtotal").when(footer, "footer").when(T.banner_noise(r("shop"), r("item_code"), r("description"), r("packaging")), "noise").otherwise("product")
    )
    return rows.withColumn("kind", kind)


def _footer(c: Column) -> Column:
    """Whether a table's row is a line of the document's footer: as for printed lines, but a date makes none."""
    paid = lambda upper: upper.contains("PAYMENT") & upper.rlike(r"\bPAYMENT\b") & upper.contains("USD") & ~upper.rlike(r"\bPCS/CTN\b")
    return bound(F.upper(T.squeezed(c)), lambda upper: T.any_of([upper.rlike(p) for p in T.FOOTER_PATTERNS]) | paid(upper))


def walked(chunks: DataFrame, sales: bool = False, html: str = "html") -> DataFrame:
    """The rows of all tables and texts of each document (document_id, chunk, html) with kind, section, label, carried (in
    a block of goods from before) and carried_marks.

    The last header at or above a row decides its section, over tables and chunks; an unknown banner opens a
    section of its own. Label and carried-over flag end with their table. Marks go down inside a block; headers and
    subtotals end it. The first block of a table starts with the marks that the last table with open marks ended with."""
    compiled(chunks.sparkSession)
    # all windows below are by document or finer, and in the order of its rows: one shuffle and one sort serve them
    rows = _kinds(table_rows(chunks, sales, html).repartition("document_id"))
    doc = Window.partitionBy("document_id").orderBy("chunk", "piece", "row")
    here = Window.unboundedPreceding, Window.currentRow
    table = Window.partitionBy("document_id", "chunk", "piece").orderBy("row").rowsBetween(*here)
    header = F.when(F.col("kind").isin(*SECTIONS, "unknown"), F.col("kind"))
    opened = F.when(F.col("kind") == "unknown", section_key(F.col("line"))).otherwise(_section(header))
    in_text = F.when(F.col("kind") == "text", _section(F.when((F.col("header") != "stuffed") | ~F.col("alone"), F.col("header"))))
    inferred = F.when(T.any_of([F.col("upper").contains(w) for w in MARKS_WORDS]), inferred_marks(F.col("cells")))
    own = F.when(F.col("kind") == "product", F.coalesce(F.nullif("r_marks", F.lit("")), inferred))
    rows = rows.withColumns({"opened": F.coalesce(opened, in_text), "reset": header.isNotNull() | (F.col("kind") == "subtotal"), "marks": own}).drop("upper", "header")
    section = F.coalesce(F.last("opened", ignorenulls=True).over(doc.rowsBetween(*here)), F.lit("shipped"))
    label = F.last(F.when(header.isNotNull(), F.col("line")), ignorenulls=True).over(table)
    carried = F.coalesce(F.last(F.when(F.col("kind").isin(*SECTIONS), F.col("kind") == "before_goods"), ignorenulls=True).over(table), F.lit(False))
    # a row that ends a block has no marks, so the last row with marks or such an end tells them
    open_marks = F.last(F.when(F.col("reset") | F.col("marks").isNotNull(), F.struct("marks")), ignorenulls=True).over(table)["marks"]
    ends = F.coalesce(~F.lead(F.struct("chunk", "piece")).over(doc).eqNullSafe(F.struct("chunk", "piece")), F.lit(True))
    rows = rows.withColumns({"section": section, "label": label, "carried": carried, "first_block": ~F.max("reset").over(table), "open_marks": open_marks, "ends": ends})
    rows = rows.withColumn("left_marks", F.when(F.col("ends"), F.col("open_marks")))
    inherited = F.last("left_marks", ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("carried_marks", F.coalesce("open_marks", F.when(F.col("first_block"), inherited))).drop("opened", "reset", "first_block", "open_marks", "ends", "left_marks")


def _section(header: Column) -> Column:
    return F.coalesce(*(F.when(header == k, s) for k, s in SECTIONS.items()))


def section_subtotals(rows: DataFrame) -> DataFrame:
    """The printed subtotal bars of walked rows: document_id, section, total_cartons, total_cbm, total_weight_kg, total_amount_rmb.

    Numbers are those before their unit in the line, else the mapped ones. Bars of goods from before are left
    out, as these stand among the goods left too, and so are bars with neither cartons nor an amount."""
    line = F.regexp_replace("line", ",", "")
    printed = lambda p, f: F.coalesce(N.prefix_number(F.regexp_extract(line, p, 1)), N.cell(F.col(f"r_{f}"))).alias(f)
    bars = rows.where((F.col("kind") == "subtotal") & ~F.col("carried")).select(
        "document_id", "chunk", "piece", "row", "section",
        printed(r"(?i)(\d+(?:\.\d+)?)\s*CTNS?\b", "total_cartons"), printed(r"(?i)(\d+(?:\.\d+)?)\s*CBM\b", "total_cbm"), printed(r"(?i)(\d+(?:\.\d+)?)\s*KGS?\b", "total_weight_kg"), printed(r"[¥￥]\s*([\d.]+)", "total_amount_rmb"),
    )
    return bars.where("total_cartons is not null or total_amount_rmb is not null")


def _mapped(rows: DataFrame) -> DataFrame:
    """The columns of a product out of r_<field>: texts, numbers, box range, inferred price, item code and delivery number."""
    r = lambda f: F.nullif(F.trim(T.text(f"r_{f}")), F.lit("")) if f in FIELDS else F.lit(None).cast("string")
    texts = {f: r(f) for f in TEXT_FIELDS if f != "marks"}
    numbers = {f: N.cell(r(f)) for f in NUMBER_FIELDS if f != "qty_per_carton"}
    numbers["qty_per_carton"] = F.nullif(F.regexp_extract(T.text("r_packaging"), r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    rows = rows.withColumns(texts | numbers)
    box = lambda i: F.nullif(F.regexp_extract(T.text("r_box_no_start"), r"(\d+)(?:\s*[-–~]\s*(\d+))?", i), F.lit("")).try_cast("int")
    implied = N.half_up(F.col("total_amount_rmb") / F.col("total_quantity"), 2)
    price = F.when(F.coalesce(F.col("unit_price_rmb") <= 0, F.lit(True)) & (F.col("total_amount_rmb") > 0) & (F.col("total_quantity") > 0) & (implied > 0), implied).otherwise(F.col("unit_price_rmb"))
    sku = T.sku_fields(F.col("source_item_no"), F.col("item_code"))
    delivery = F.coalesce("delivery_no", F.when(T.delivery_ref(F.col("product_marks")), F.col("product_marks")))
    return rows.withColumns({"unit_price_rmb": price, "item_code": sku["item_code"], "source_item_no": sku["source_item_no"], "delivery_no": delivery, "box_no_start": box(1), "box_no_end": F.coalesce(box(2), box(1))})


def products(rows: DataFrame, sales: bool = False, full: bool = False) -> DataFrame:
    """The product rows of walked rows (columns PRODUCT), repaired row by row; with `full`, also every banner, total,
    subtotal, footer, text and unmapped row under the code of its kind, for review.

    Rows of anonymous parts take no marks from above. Goods from before are goods left, with a remark; their label
    is a remark too, unless it is a product row that was taken for a banner."""
    kept = F.col("kind") == "product"
    if full:
        kept = (F.col("kind") != "text") | F.col("alone")
    doc = Window.partitionBy("document_id").orderBy("chunk", "piece", "row")
    rows = rows.where(kept).withColumn("line_no", F.row_number().over(doc))
    anonymous = T.anonymous_parts(F.col("r_marks"), F.col("r_item_code"), F.col("r_shop"), F.col("r_description"))
    is_product = F.col("kind") == "product"
    marks = F.when(is_product & anonymous, F.col("marks")).when(is_product, F.coalesce("marks", "carried_marks")).otherwise(F.nullif(F.trim("r_marks"), F.lit("")))
    rows = _mapped(rows.withColumn("product_marks", marks)).withColumn("marks", F.col("product_marks"))
    if sales:
        repaired = _finished_row(_sales_repaired(rows.where(is_product)), is_product).select(*PRODUCT)
        return repaired.unionByName(_sentinels(rows.where(~is_product)).select(*PRODUCT)) if full else repaired
    repaired = _finished_row(shifts.parsed_rows_repaired(rows, only=is_product), is_product)
    return (_sentinels(repaired) if full else repaired).select(*PRODUCT)


def _finished_row(rows: DataFrame, is_product: Column) -> DataFrame:
    """Product rows with what their block says of them; others as they are."""
    label, carried = F.col("label"), is_product & F.col("carried")
    rows = rows.withColumn("label", F.when(is_product & label.isNotNull(), T.clean_label(label)))
    rows = rows.withColumn("tag", F.when((label != "") & ~product_like(label), T.section_label_tag(label)))
    added = lambda c, tag: F.when(tag.isNull() | F.coalesce(c.contains(tag), F.lit(False)), c).otherwise(F.concat(F.coalesce(F.concat(F.nullif(c, F.lit("")), F.lit(";")), F.lit("")), tag))
    rows = rows.withColumns({"section": F.when(carried, "left_in_warehouse").otherwise(F.col("section")), "remarks": F.when(carried, shifts.tagged(F.col("remarks"), BEFORE_GOODS_REMARK)).otherwise(F.col("remarks"))})
    # the remark says of each that it is carried over, so no row above needs to have the amount too
    rows = shifts.amounts_dropped(rows, carried & (F.col("total_amount_rmb") > 0))
    return rows.withColumn("remarks", added(F.col("remarks"), F.col("tag")))


def _sentinels(rows: DataFrame) -> DataFrame:
    """Rows that are no products as rows for review: subtotals and footers with their numbers, the others with their text alone."""
    is_product, numbered = F.col("kind") == "product", F.col("kind").isin("product", "subtotal", "footer")
    noise = F.array_join(F.filter(F.array("r_shop", "r_item_code", "r_description", "r_packaging"), lambda c: T.text(c) != ""), " · ")
    text = F.when(F.col("kind") == "noise", F.coalesce(F.nullif(noise, F.lit("")), F.col("line"))).otherwise(F.col("line"))
    code = F.when(is_product, F.col("item_code")).when(F.col("kind") == "subtotal", SUBTOTAL_CODE).when(F.col("kind") == "footer", FOOTER_CODE).otherwise(EXTRACT_CODE)
    remark = F.coalesce(*(F.when(F.col("kind") == k, f"full_extract:{v}") for k, v in REMARKS.items()))
    types = dict(rows.dtypes)
    none = {c: F.when(numbered, F.col(c)).cast(types[c]) for c in PRODUCT if c not in ("document_id", "line_no", "section")}
    # what is asked of the code is asked of the result, and not of all that the code is made of
    return settled(rows, **(none | {"item_code": code, "description": F.when(numbered, F.col("description")).otherwise(F.nullif(F.trim(text), F.lit(""))), "remarks": F.when(numbered, F.col("remarks")).otherwise(remark)}))


def _sales_repaired(rows: DataFrame) -> DataFrame:
    """Rows whose numbers don't cohere are read by position, where they have a row's cells; then numbers out of descriptions."""
    keys = ["document_id", "chunk", "piece", "row"]
    lacking = T.any_of([F.coalesce(F.col(c) <= 0, F.lit(True)) for c in ("total_quantity", "unit_price_rmb", "total_amount_rmb")])
    found = X.positional_rows(rows.where(lacking).select(*keys, "cells"))
    names = [c for c in PRODUCT if c in found.columns and c not in ("marks", "remarks")]
    read = found.select(*keys, F.struct("remarks", *names).alias("read"))
    rows = rows.join(read, keys, "left")
    new = {c: F.when(F.col("read").isNotNull(), F.coalesce(F.col(f"read.{c}"), F.col(c)) if c == "shop" else F.col(f"read.{c}")).otherwise(F.col(c)) for c in names}
    new["remarks"] = F.when(F.col("read").isNotNull(), shifts.tagged(F.col("remarks"), "repair:positional_row_override")).otherwise(F.col("remarks"))
    return X.continuation_metrics(X.collapsed_metrics(settled(rows, **new).drop("read")))


def finished(rows: DataFrame, sales: bool = False) -> DataFrame:
    """Products of whole documents: sections continued, cartons of repeated rows counted once, and (sales) rows merged
    with their continuations."""
    own = rows.withColumn("item_id", F.col("line_no"))
    own = order.cartons_deduplicated(rules.sections_continued(own))
    return (order.continuations_merged(own) if sales else own).drop("item_id")


def parsed_products(chunks: DataFrame, sales: bool = False, full: bool = False, html: str = "html") -> DataFrame:
    """The products of documents (document_id, chunk, html), in one call."""
    return finished(products(walked(chunks, sales, html), sales, full), sales)
