"""Names, sections, packings and documents' kinds out of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaytally.functions.columns import bound

#: White space as the rules know it, with the no-break and the ideographic space.
SPACE = r"[\s\x{00A0}\x{3000}]"


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeezed(c: Column) -> Column:
    # a space alone is left as it is, as to replace each would cost the most
    return F.trim(F.regexp_replace(c, rf"[\t\n\x0B\f\r\x{{00A0}}\x{{3000}}]{SPACE}*| {SPACE}+", " "))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def clean(c: Column) -> Column:
    """Trimmed; '', 'null' and 'undefined' are null."""
    t = F.trim(c)
    return F.when(~t.isin("", "null", "undefined"), t)


def base_name(name: Column) -> Column:
    """Words before the first with a digit, the first in capitals, or (after a word) the first in Chinese."""
    words = F.split(squeezed(name), " ")
    stops = F.transform(words, lambda w, i: w.rlike(r"\d") | w.rlike("^[A-Z]{2,}") | ((i > 0) & w.rlike(r"[⺀-鿿]")))
    first = F.coalesce(F.array_position(stops, True), F.lit(0)).cast("int")
    kept = F.when(first == 0, words).when(first == 1, F.slice(words, 1, 1)).otherwise(F.slice(words, F.lit(1), first - 1))
    return F.array_join(kept, " ")


def english_first(a: Column, b: Column) -> Column:
    return F.when(a.rlike("^[A-Za-z]"), a).when(b.rlike("^[A-Za-z]"), b).otherwise(F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))


def unit(packing: Column) -> Column:
    found = F.lower(F.regexp_extract(packing, r"(?i)\d+\s*([a-z]+)\s*/\s*ctn", 1))
    return F.when(found == "", "pcs").otherwise(found)


def packing_cartons(packing: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(packing), r"(?i)^(\d+(?:\.\d+)?)\s*CTNS?$", 1), F.lit("")).cast("double")


def packing_pieces(packing: Column) -> Column:
    found = F.nullif(F.regexp_extract(F.trim(packing), r"(?i)^(\d+(?:\.\d+)?)\s*pcs/ctn$", 1), F.lit("")).cast("double")
    return F.when(found > 0, found)


TRAILING = r"(?is)^(.*?)(\d+(?:\.\d+)?\s*pcs/ctn)\s*$"


def trailing_packing(description: Column) -> Column:
    """Packing at the end of a description."""
    return F.nullif(F.regexp_extract(F.trim(description), TRAILING, 2), F.lit(""))


def without_trailing_packing(description: Column) -> Column:
    t = F.trim(description)
    return F.nullif(F.when(trailing_packing(t).isNull(), t).otherwise(F.trim(F.regexp_extract(t, TRAILING, 1))), F.lit(""))


def canonical_section(section: Column) -> Column:
    return F.when(section.isin("left_in_warehouse", "repacked", "other"), section).otherwise("shipped")


def section_label(remarks: Column) -> Column:
    """The label in remarks, percent-decoded."""
    tags = F.filter(F.transform(F.split(text(remarks), ";"), lambda s: F.trim(s)), lambda s: s.startswith("section_label:"))
    # a label without a percent sign is as it is
    plain = lambda encoded: F.when(encoded.contains("%"), F.coalesce(F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), encoded)).otherwise(encoded)
    label = bound(F.substring_index(F.try_element_at(tags, F.lit(1)), "section_label:", -1), plain)
    return bound(F.trim(label), lambda found: F.when(found != "", found))


def section_label_tag(label: Column) -> Column:
    """The remark that keeps a label; a space is %20."""
    return F.concat(F.lit("section_label:"), F.replace(F.url_encode(label), F.lit("+"), F.lit("%20")))


def storage_section(section: Column, remarks: Column) -> Column:
    s = F.lower(F.trim(text(section)))
    label = F.lower(F.concat(text(section_label(remarks)), F.lit(" "), text(remarks)))
    return (
        F.when(s.isin("shipped", "left_in_warehouse", "repacked", "other"), s)
        .when(label.contains("before goods") | label.contains("goods left") | label.contains("warehouse"), "left_in_warehouse")
        .when(label.contains("repacked") | label.contains("stuffed into this container"), "repacked")
        .otherwise("shipped")
    )


def stuffed_header(raw: Column) -> Column:
    return bound(F.upper(raw), _stuffed)


def _stuffed(upper: Column) -> Column:
    # fixed values: the banner's words as printed and as glued together; all of the latter hold the letters of GOODS, which few lines do
    glued = lambda compact: any_of([compact.contains(x) for x in ("GOODSHASBEENSTUFFEDINTOTHISCO", "GOODSLOADINTHISCONTAINER", "GOODSLOADINTHISCONTANIER", "MMBGOODSLOAD")])
    goods = upper.rlike("[^A-Z0-9]*".join("GOODS"))
    return any_of([upper.contains("STUFFED INTO THIS CO"), upper.contains("LOAD") & upper.rlike(r"\bGOODS\s+LOAD\s+IN\s+THIS\s+CONTAI?NIER?\b"), goods & bound(F.regexp_replace(upper, "[^A-Z0-9]+", ""), glued)])


def header_kind(raw: Column) -> Column:
    """new_order, before_goods, goods_left, repacked, stuffed, unknown, or null for no section header."""
    return bound(squeezed(text(raw)), lambda line: bound(F.upper(line), lambda upper: kind_of_line(line, upper)))


def goods_left(line: Column, upper: Column) -> Column:
    apart = upper.contains("LEFT") & ((line.rlike(r"\bGOODS\s+LEFT\b") & upper.rlike(r"\bSANCARGO\b")) | upper.rlike(r"\bLEFT\s+IN\s+WAREHOUSE\b"))
    return F.replace(upper, F.lit(" "), F.lit("")).contains("GOODSLEFTINSANCARGO") | apart


def opens_goods_left(raw: Column) -> Column:
    """Whether header_kind is goods_left, for many lines that are no headers."""

    def kind(line: Column, upper: Column) -> Column:
        return upper.contains("LEFT") & goods_left(line, upper) & (kind_of_line(line, upper) == "goods_left")

    return bound(squeezed(text(raw)), lambda line: bound(F.upper(line), lambda upper: kind(line, upper)))


def kind_of_line(line: Column, upper: Column) -> Column:
    """header_kind of a squeezed line, which is no null, and the line in capitals.

    A plain word is looked for before each pattern that needs it: most lines are no headers and hold none."""
    new_order = upper.contains("NEW") & upper.rlike(r"\bNEW\s+ORDERS?\b") & (F.regexp_replace(F.regexp_replace(upper, r"\bNEW\s+ORDERS?\b", ""), r"[\s.:—_-]", "") == "")
    before = upper.contains("BEFORE") & upper.rlike(r"\bBEFORE\s+GOODS\b")
    repacked = upper.rlike(r"REPACKAGED GOODS|REPACKED GOODS|\bREPACK(?:ED|AGED)?\b")
    yen = line.rlike("[¥￥]")
    priced = yen & (upper.rlike(r"\b(?:CBM|KGS)\b") | line.rlike(r"\d+\s*-\s*\d+\s*$"))
    coded = upper.rlike(r"MAG-\d{3}-\d+|MS-\d{3}-\d+") & (yen | upper.rlike(r"\b(?:CBM|KGS)\b"))
    numbered = upper.rlike(r"^\d{1,4}\s") & upper.rlike(r"(?:^|\s)(?:\d+(?:\.\d+)?\s+){2}\d+(?:\.\d+)?$")
    words = F.size(F.split(upper, " "))
    metric = upper.rlike(r"\b(?:PCS/CTN|CTNS?|CBM|KGS?|USD|RMB)\b")
    banner = ~metric & words.between(2, 18) & ~numbered & upper.rlike("[A-Z一-鿿]") & ~coded & ~priced
    stuffed = F.when(repacked, "repacked").otherwise("stuffed")
    return F.when(new_order, "new_order").when(before, "before_goods").when(goods_left(line, upper), "goods_left").when(_stuffed(upper), stuffed).when(banner, "unknown")


# Words that a mark never holds.
NO_MARKS = ("MARKS", "PACKING", "ITEM", "SHOP", "CLIENT DETAILS", "CONTAINER NO", "NEW ORDER", "GOODS LEFT", "GOODS BALANCE", "TOTAL ", "PCS", "CTN", "CBM", "KGS")


def valid_marks(raw: Column) -> Column:
    free = lambda first: bound(F.upper(first), lambda upper: ~any_of([upper.contains(w) for w in NO_MARKS]))
    return bound(F.trim(F.substring_index(text(raw), "\n", 1)), lambda first: (F.length(first) >= 3) & ~first.rlike(rf"{SPACE}|[¥￥\\/]") & free(first))


# Patterns of printed footer lines.
FOOTER_PATTERNS = (
    r"\bTOTAL\s+(?:WEIGHT|CBM|CARTON|COST|BALANCE)\b",
    r"\b(?:GOODS\s+BALANCE|CREDIT\s+SUPPORT|PIVOC|EXCHANGE\s+RATE)\b",
    r"YIWU.{0,10}MOMBASA.{0,10}FREIGHT",
    r"IF\s+OUTSTANDING\s+BALANCE\s+IS\s+NOT\s+PAID",
    r"PAYMENT\s+DELAY\s+SURCHARGE",
    r"VESSEL\s+ARRIVAL\s+MOMBASA",
    r"BALANCE\s+PAYMENT\s+TERMS",
    r"REDUCE\s+DETAILS",
    r"REDUCE\s+\d+\s*CTN",
)


#: Each line of a footer holds one of these.
FOOTER_WORDS = ("TOTAL", "BALANCE", "CREDIT", "PIVOC", "EXCHANGE", "YIWU", "PAYMENT", "VESSEL", "REDUCE")


def may_be_footer(upper: Column) -> Column:
    return any_of([upper.contains(w) for w in FOOTER_WORDS])


def footer_like(*columns: Column) -> Column:
    combined = F.upper(F.concat_ws(" ", *(text(c) for c in columns)))
    payment = combined.rlike(r"\bPAYMENT\b")
    dated = payment & combined.rlike(r"\d{1,2}/\d{1,2}/\d{4}")
    dollars = payment & combined.contains("USD") & ~combined.rlike(r"\bPCS/CTN\b")
    return any_of([*(combined.rlike(p) for p in FOOTER_PATTERNS), dated, dollars])


def delivery_ref(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "").rlike(r"(?i)^(?:\d{2}C\d{3}-\d+[A-Z0-9-]*|26C\d{3}-[0-9A-Z-]+)$")


def sku_fields(source_item_no: Column, item_code: Column) -> Column:
    """struct(item_code, source_item_no) with the manufacturer's number as item code."""
    both = source_item_no.isNotNull() & item_code.isNotNull()
    swapped = both & delivery_ref(item_code) & ~delivery_ref(source_item_no)
    row_number = both & source_item_no.rlike(r"^\d{1,4}$") & ~item_code.rlike(r"^\d{1,4}$")
    code = F.when(swapped, source_item_no).when(row_number, item_code).otherwise(F.coalesce(source_item_no, item_code))
    return F.struct(code.alias("item_code"), F.coalesce(source_item_no, item_code).alias("source_item_no"))


def with_remark(existing: Column, tag: str, separator: str = ";") -> Column:
    old = F.trim(text(existing))
    return F.when(old == "", F.lit(tag)).when(old.contains(tag), old).otherwise(F.concat(old, F.lit(separator + tag)))


def stock_status(quantity: Column, reorder: Column) -> Column:
    return F.when(quantity <= 0, "out").when(quantity <= reorder, "low").otherwise("ok")


def box_range(label: Column) -> Column:
    """'170-278' as struct(start, end); one number is both."""
    part = lambda i: F.nullif(F.regexp_extract(label, r"^\s*(\d+)(?:\s*-\s*(\d+))?\s*$", i), F.lit("")).try_cast("int")
    return F.struct(part(1).alias("start"), F.coalesce(part(2), part(1)).alias("end"))


def document_kind(header: Column) -> Column:
    """sales_order, container_manifest or unknown from the first lines of a document."""
    upper = F.upper(header)
    sales = any_of(
        [
            header.rlike("销售单|送货单|仓位|送货地址|订货地址"),
            upper.contains("DEL NO") & upper.contains("CUS NO"),
            upper.contains("U/P") & upper.contains("AMOUNT") & upper.contains("W.H"),
            upper.contains("ITEM NO") & upper.contains("TTL CBM") & upper.contains("TTL KGS"),
        ]
    )
    manifest = upper.contains("CONTAINER NO") | upper.contains("CLIENT DETAILS") | upper.contains("SANCARGO")
    return F.when(sales, "sales_order").when(manifest, "container_manifest").otherwise("unknown")


def file_kind(name: Column) -> Column:
    base = F.element_at(F.split(F.lower(name), r"[/\\]"), -1)
    sales = base.rlike(r"销售单|送货单|\bsales[_-]?order\b|\bsales[_-]?(?:note|invoice|delivery)\b")
    return F.when(sales, "sales_order").when(base.contains("sales") & ~base.rlike(r"\b(?:manifest|container|ms[-_]?\d)"), "unknown").otherwise("container_manifest")


def resolved_kind(body: Column, name: Column) -> Column:
    """A clear container text overrides a sales file name; a clear text overrides other names."""
    blob = F.upper(F.substring(squeezed(body), 1, 24_000))
    container = blob.contains("CONTAINER NO") & (blob.contains("CLIENT DETAILS") | blob.contains("SANCARGO"))
    lines = F.slice(F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 120)
    by_text, by_name = document_kind(F.array_join(lines, " ")), file_kind(name)
    return (
        F.when((by_name == "sales_order") & container, "container_manifest")
        .when(by_name == "sales_order", "sales_order")
        .when(by_text != "unknown", by_text)
        .when(by_name != "unknown", by_name)
        .otherwise("container_manifest")
    )


def without_repeats(label: Column) -> Column:
    """A label whose words are one phrase of two words or more, again and again, is that phrase; else equal words in a row are one."""
    return bound(squeezed(label), lambda line: bound(F.split(line, " "), lambda words: _phrase(line, words)))


def _phrase(line: Column, words: Column) -> Column:
    n = F.size(words)
    same = lambda p: F.forall(F.sequence(F.lit(1), n), lambda i: F.try_element_at(words, i) == F.try_element_at(words, F.pmod(i - 1, p) + 1))
    period = F.array_min(F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(n / 2).cast("int"))), lambda p: (p * 2 <= n) & (n % p == 0) & same(p)))
    once = F.filter(words, lambda w, i: (i == 0) | (w != F.try_element_at(words, F.greatest(i, F.lit(1)))))
    repeated = bound(period, lambda p: F.when(p.isNotNull(), F.array_join(F.slice(words, F.lit(1), p), " ")).otherwise(F.array_join(once, " ")))
    return F.when(n < 6, line).otherwise(repeated)


def clean_label(label: Column) -> Column:
    """A section's label under its usual name, without repeats."""
    return bound(squeezed(text(label)), lambda line: bound(F.upper(line), lambda upper: _clean_line(line, upper)))


def _clean_line(line: Column, upper: Column) -> Column:
    counted = F.regexp_extract(line, r"(?i)([A-Z0-9-]+\s+\d+\s*CTN\S*)\s+GOODS\s+STUFFED\s+INTO\s+THIS\s+CO", 1)
    return (
        F.when(upper.rlike(r"\bNEW\s+ORDERS?\b"), "NEW ORDERS")
        .when(upper.rlike(r"\bGOODS\s+LEFT\s+IN\s+SANCARGO\b"), "GOODS LEFT IN SANCARGO WAREHOUSE")
        .when(upper.rlike(r"\bBEFORE\s+GOODS\b"), F.regexp_extract(upper, r"BEFORE GOODS(?: [A-Z0-9-]+)?", 0))
        .when(upper.rlike(r"\bGOODS\s+STUFFED\s+INTO\s+THIS\s+CO(?:NTAINER)?\b"), F.trim(F.concat(counted, F.lit(" GOODS STUFFED INTO THIS CONTAINER"))))
        .otherwise(without_repeats(line))
    )


def spurious_label(label: Column) -> Column:
    """Whether a label is a product row that was taken for a banner."""
    return bound(squeezed(text(label)), lambda line: bound(F.upper(line), lambda upper: _product_line(line, upper)))


def _product_line(line: Column, upper: Column) -> Column:
    known = upper.rlike(r"\bNEW\s+ORDERS?\b|\bBEFORE\s+GOODS\b|\bGOODS\s+(?:LEFT|STUFFED|LOAD)\b|\bSTUFFED\s+INTO\s+THIS\s+CO|\bLOAD\s+IN\s+THIS\s+CONTA|\bREPACK|^SHEET\s*\d+\b")
    yen = line.rlike("[¥￥]")
    heading = F.size(F.split(line, " ")).between(2, 14) & ~yen & ~line.rlike(r"\d+\.\d{2,}")
    priced = yen & (upper.rlike(r"\b(?:CBM|KGS|CTNS?)\b") | line.rlike(r"\d+\s*-\s*\d+\s*$"))
    coded = upper.rlike(r"MAG-\d{3}-\d+|MS-\d{3}-\d+") & (yen | upper.rlike(r"\b\d+\.?\d*\s*CBM\b"))
    return (line != "") & ~known & ~heading & ((F.length(line) >= 82) | priced | coded)


def shown_label(section: Column, remarks: Column) -> Column:
    return bound(section_label(remarks), lambda own: _shown(section, own))


def _shown(section: Column, own: Column) -> Column:
    return F.when(own.isNotNull() & ~spurious_label(own), clean_label(own)).when(section == "shipped", "Shipped").when(section == "left_in_warehouse", "Left in Warehouse").when(section == "repacked", "Repacked").otherwise(F.replace(section, F.lit("_"), F.lit(" ")))


# Words of products that a total never holds, and signs of printed totals.
PRODUCT_WORDS = r"(?i)machine|parts|oven|grill|bra|sleepwear|shapewear|tape|mixer|dispenser"
TOTAL_SIGNS = (r"(?i)\b\d+\s*CTNS?\b", r"(?i)\d+\.?\d*\s*CBM\b", r"[¥￥]\s*[\d,]+", r"(?i)\d+\.?\d*\s*KGS?\b|\d+\.?\d*GS\b")
DIVIDERS = ("__SECTION_REPACKAGED__", "__SECTION_STAGE__:", "__SECTION_STAGE_TOTAL__:")
NEW_ORDER = "NEW ORDER"


def rolled_totals(line: Column) -> Column:
    """Three of cartons, volume, weight and amount in a line with few words and without packing."""
    few = F.size(F.filter(F.split(F.regexp_replace(line, r"[\d.,¥￥\s/:%_-]", " "), " "), lambda w: w.rlike("^[A-Za-z]{3,}"))) < 5
    cartons, volume, amount, weight = (line.rlike(p) for p in TOTAL_SIGNS)
    # most lines have neither of the first two, and need no more patterns
    three = (cartons | volume) & ((cartons & volume & (amount | weight)) | (amount & weight))
    return three & few & ~line.rlike(r"(?i)\d+\s*pcs/ctn")


def subtotal_line(cells: Column) -> Column:
    """Whether a row of cells is a section's subtotal bar."""
    return bound(squeezed(F.array_join(F.filter(cells, lambda c: text(c) != ""), " ")), lambda line: bound(F.upper(line), lambda upper: subtotal_text(line, upper)))


def subtotal_text(line: Column, upper: Column) -> Column:
    """subtotal_line of a row's squeezed text, and that text in capitals."""
    return (line != "") & ((upper.contains("TOTAL") & line.rlike(r"(?i)\bSUB\s*TOTAL\b|\bSECTION\s+TOTAL\b")) | (may_hold_totals(upper) & rolled_totals(line)))


def may_hold_totals(upper: Column) -> Column:
    """Whether a line in capitals holds what printed totals need; most lines don't, and need no more patterns."""
    return (upper.contains("CTN") | upper.contains("CBM")) & upper.rlike("[¥￥]|KG|GS")


def subtotal_fields(description: Column, item_code: Column, cartons: Column, quantity: Column, amount: Column) -> Column:
    """Whether a mapped row is a rolled total: large numbers without a product's name."""
    d, i = F.trim(text(description)), F.trim(text(item_code))
    named = ((F.length(d) > 2) | (F.length(i) > 2)) & d.rlike(PRODUCT_WORDS)
    # lengths before numbers: a row with a description needs none of its numbers
    many = (F.length(d) <= 1) & (F.length(i) <= 1) & (cartons >= 40) & (amount >= 3000)
    much = (d == "") & (quantity >= 200) & (amount >= 10_000)
    return (F.coalesce(many, F.lit(False)) | F.coalesce(much, F.lit(False))) & ~named


def totals_blob(row_text: Column, *fields: Column) -> Column:
    """Whether a printed total went into the text fields of a mapped row."""
    return bound(squeezed(F.concat_ws(" ", row_text, *fields)), lambda line: (F.length(line) >= 12) & rolled_totals(line))


def banner_noise(*fields: Column) -> Column:
    """Whether shop, item code, description and packing all say NEW ORDER."""
    return reduce(lambda a, b: a & b, (F.upper(F.trim(text(c))) == NEW_ORDER for c in fields))


def anonymous_parts(marks: Column, item_code: Column, shop: Column, description: Column) -> Column:
    empty = reduce(lambda a, b: a & b, (F.trim(text(c)) == "" for c in (marks, item_code, shop)))
    return empty & text(description).rlike(r"(?i)FOOD\s+WARMER\s+PARTS")


def stuffed_banner(text_: Column, *metrics: Column) -> Column:
    """Whether a row is the banner of stuffed goods: its text, and no positive number."""
    return ~any_of([F.coalesce(m > 0, F.lit(False)) for m in metrics]) & stuffed_header(text(text_))


def section_divider(sku: Column) -> Column:
    s = text(sku)
    return (s == DIVIDERS[0]) | any_of([s.startswith(d) for d in DIVIDERS[1:]])


def document_number(client: Column, file_name: Column) -> Column:
    """The first word like AB-12 of the client's details, else of the file's name."""
    found = lambda c: F.nullif(F.regexp_extract(text(c), r"(?i)\b([A-Z]{1,5}-\d{1,6})\b", 1), F.lit(""))
    return F.coalesce(found(client), found(file_name))


def client_id(details: Column) -> Column:
    return F.try_element_at(F.filter(F.split(F.trim(text(details)), r"[.\s]+"), lambda t: t != ""), F.lit(1))


def usd(amount: Column) -> Column:
    """An amount as money text."""
    return F.concat(F.lit("$"), F.format_number(amount.cast("double"), 2), F.lit(" USD"))
