"""Joins, filters, orders and set operations over items and their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaytally.functions import text as T
from quaytally.functions.numbers import half_up
from quaytally.sources.shared import written

#: Rows of a dimension that is sent to every task at most; a larger one is joined by shuffle.
MAX_DIMENSION = 200_000


def escaped(term: str) -> str:
    """A search term as part of a LIKE pattern."""
    return "".join(f"\\{c}" if c in "%_\\" else c for c in term)


def searched(items: DataFrame, term: str, columns: tuple[str, ...]) -> DataFrame:
    pattern = f"%{escaped(term)}%"
    return items.where(T.any_of([F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns]))


def row_matches(columns: tuple[str, ...], term: str) -> Column:
    """Whether one of the columns contains the term; a match cannot span two columns."""
    return F.exists(F.array(*(F.lower(T.text(c)) for c in columns)), lambda c: c.contains(term.lower()))


def with_document(items: DataFrame, documents: DataFrame, how: str = "left") -> DataFrame:
    return items.join(documents, "document_id", how)


def with_dimension(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join; the dimension goes to every task only if a count shows that it is small."""
    small = dimension.limit(MAX_DIMENSION + 1).count() <= MAX_DIMENSION
    return facts.join(F.broadcast(dimension) if small else dimension, key, "left")


def referenced(documents: DataFrame, items: DataFrame, key: str) -> DataFrame:
    return documents.join(items.select(key), key, "left_semi")


def without(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return children.join(gone.select(key), key, "left_anti")


def reading_order(items: DataFrame) -> DataFrame:
    """Newest document first, then document, line (none: last) and item."""
    return items.orderBy(F.desc("created_at"), "document_id", F.coalesce("line_no", F.lit(999_999)), "item_id")


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    return ordered.offset((number - 1) * size).limit(size)


def latest_per_file(documents: DataFrame) -> DataFrame:
    """The newest document of each file name; unnamed documents stay each for itself."""
    name = F.lower(F.trim(T.text("source_file_name")))
    key = F.when(name == "", F.concat(F.lit("id:"), F.col("document_id"))).otherwise(name)
    newest = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("document_id"))
    return documents.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")


def publishable(items: DataFrame) -> DataFrame:
    return items.where(~F.lower(F.coalesce("section", F.lit("shipped"))).isin("left_in_warehouse", "repacked"))


def with_totals_row(rows: DataFrame, label: str, sums: tuple[str, ...], kind: str) -> DataFrame:
    totals = rows.agg(*(F.sum(c).alias(c) for c in sums)).withColumn(label, F.lit("TOTALS")).withColumn(kind, F.lit("totals"))
    return rows.unionByName(totals)


def without_carryovers(items: DataFrame) -> DataFrame:
    """Carried-over rows go where a genuine row of goods left has the same marks in the document."""
    carried = F.lower(T.text("remarks")).contains("carryover:before_goods")
    rows = items.withColumn("mark_key", F.upper(F.trim(T.text("marks"))))
    genuine = rows.where((F.col("section") == "left_in_warehouse") & ~carried & (F.col("mark_key") != "")).select("document_id", "mark_key").distinct()
    return rows.where(~carried).unionByName(rows.where(carried).join(genuine, ["document_id", "mark_key"], "left_anti").select(rows.columns)).drop("mark_key")


def code_stem(code: Column) -> Column:
    c = F.regexp_replace(F.upper(T.text(code)), "[^A-Z0-9-]", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(c, "-[A-Z0-9]+$", ""), 1, 5), F.lit("")), F.substring(c, 1, 5))


def tokens(description: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(T.text(description)), r"[^a-z0-9.\s\"]", " "), r"\s+")
    return F.filter(words, lambda t: F.length(t) >= 3)


# Points for an equal code stem, for two words in common, for pieces a carton that are near, the least
# points of a donor, and how near pieces a carton are.
STEM_POINTS, WORD_POINTS, PIECES_POINTS, LEAST_POINTS, NEAR_PIECES = 4, 3, 1, 3, 2


def _word_pairs(words: Column, twice: Column) -> Column:
    """Pairs of different words, smaller first, and (w, w) of the words in `twice`."""
    distinct = F.array_sort(F.array_distinct(words))
    pairs = F.flatten(F.transform(distinct, lambda a, i: F.transform(F.slice(distinct, i + 2, F.size(distinct)), lambda b: F.concat_ws(" ", a, b))))
    return F.concat(pairs, F.transform(twice, lambda w: F.concat_ws(" ", w, w)))


def price_donors(items: DataFrame) -> DataFrame:
    """Rows without a price borrow it from the best-scoring priced row of their document.

    Code stem 4, two words in common 3 (a word that the donor has twice is two), pieces a carton within 2: 1; three points
    at least; of equals, the first line. Rows never meet in pairs: donors are filed under their stem, their
    word pairs and both together, and of each key and number of pieces the first line stays. A row looks its own keys up;
    the key with most points that leads to a donor is the one that its score is made of."""
    rows = items.withColumns({"stem": F.nullif(code_stem(F.col("item_code")), F.lit("")), "words": tokens(F.col("description")), "per": F.coalesce(F.col("qty_per_carton").cast("double"), F.lit(0.0))})
    needs = rows.where((F.coalesce("unit_price_rmb", F.lit(0)) <= 0) & (F.col("total_quantity") > 0) & (F.coalesce("total_amount_rmb", F.lit(0)) <= 0))
    donors = rows.where((F.col("unit_price_rmb") > 0) & (F.col("total_quantity") > 0))

    def keyed(side: DataFrame, twice: Column, *columns: str) -> DataFrame:
        """A row for each key: document_id, points, key, per and the columns."""
        pairs = _word_pairs(F.col("words"), twice)
        key = lambda points, *parts: F.struct(F.lit(points).alias("points"), F.concat_ws("|", *parts).alias("key"))
        stem = F.when(F.col("stem").isNotNull(), F.array(key(STEM_POINTS, F.col("stem"))))
        both = F.when(F.col("stem").isNotNull(), F.transform("pairs", lambda p: key(STEM_POINTS + WORD_POINTS, F.col("stem"), p)))
        keys = F.flatten(F.array_compact(F.array(stem, F.transform("pairs", lambda p: key(WORD_POINTS, p)), both)))
        return side.withColumn("pairs", pairs).select("document_id", "per", *columns, F.explode(keys).alias("k")).select("document_id", "k.points", "k.key", "per", *columns)

    several = F.filter(F.array_distinct("words"), lambda w: F.size(F.filter("words", lambda x: x == w)) > 1)
    filed = keyed(donors, several, "line_no", "unit_price_rmb").groupBy("document_id", "points", "key", F.col("per").alias("donor_per")).agg(F.min(F.struct("line_no", "unit_price_rmb")).alias("donor"))
    found = keyed(needs, F.array_distinct("words"), "item_id", "total_quantity").join(filed, ["document_id", "points", "key"])
    near = (F.col("per") > 0) & (F.col("donor_per") > 0) & (F.abs(F.col("per") - F.col("donor_per")) <= NEAR_PIECES)
    score = F.col("points") + F.when(near, PIECES_POINTS).otherwise(0)
    best = found.withColumn("score", score).where(F.col("score") >= LEAST_POINTS).groupBy("item_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "donor")).alias("best"), F.first("total_quantity").alias("total_quantity"))
    price = F.col("best.donor.unit_price_rmb").cast("double")
    return best.select("item_id", F.col("best.donor.line_no").alias("donor_line"), (-F.col("best.minus")).alias("score"), price.alias("unit_price_rmb"), (half_up(F.col("total_quantity").cast("double") * price * 100) / 100).alias("total_amount_rmb"))


# Words of footer lines that a list query looks for.
FOOTER_WORDS = ("TOTAL WEIGHT", "TOTAL CBM", "TOTAL CARTON", "TOTAL COST", "TOTAL BALANCE", "GOODS BALANCE", "CREDIT SUPPORT", "PIVOC", "FREIGHT", "EXCHANGE RATE", "BALANCE PAYMENT", "outstanding balance is not paid", "payment delay surcharge", "vessel arrival mombasa", "REDUCE DETAILS")


def footer_rows(items: DataFrame, most: int = 400, include_deleted: bool = False) -> DataFrame:
    """The first rows that look like footer lines, for a report; deleted ones only if asked for."""
    hit = T.any_of([F.coalesce(F.col(c).ilike(f"%{w}%"), F.lit(False)) for w in FOOTER_WORDS for c in ("marks", "description", "shop")])
    return items.where(hit if include_deleted else hit & ~F.coalesce("deleted", F.lit(False))).orderBy("item_id").limit(most)


def merged_by_id(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the first, and those of the second that it does not have."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(first.columns))


def appended_if_none(items: DataFrame, recovered: DataFrame, is_one: Column) -> DataFrame:
    """Items with the recovered rows of documents that have no such row yet."""
    have = items.where(is_one).select("document_id").distinct()
    return items.unionByName(recovered.join(have, "document_id", "left_anti").select(items.columns))


# Item codes of rows kept for review, by kind of header or footer.
SENTINEL_CODES = {"header": "__FULL_EXTRACT__", "subtotal": "__SECTION_SUBTOTAL__", "footer": "__FOOTER__"}


def full_extract(products: DataFrame, other_lines: DataFrame) -> DataFrame:
    """Products with the other lines of the document (document_id, line_no, text), each under the code of its kind; lines of no kind are headers."""
    bar = (F.col("text").rlike(r"(?i)\d+\s*CTNS?\b") & F.col("text").rlike(r"(?i)\d\s*CBM\b")) & ~F.col("text").rlike(r"(?i)pcs\s*/\s*ctn")
    code = F.when(T.footer_like(F.col("text")), SENTINEL_CODES["footer"]).when(bar, SENTINEL_CODES["subtotal"]).otherwise(SENTINEL_CODES["header"])
    rows = other_lines.select("document_id", "line_no", code.alias("item_code"), F.col("text").alias("description"))
    return products.select("document_id", "line_no", "item_code", "description").unionByName(rows)


def name_ranks(names: DataFrame, name: str) -> DataFrame:
    """Distinct names with their place in order (name_rank, from 1), by the order of the column, collated ones too.

    Names are dealt over tasks by range and numbered there; the ranges' sizes, a row for each task, are added up."""
    ranged = names.select(name).repartitionByRange(name).sortWithinPartitions(name)
    # the number says the task (above 33 bits) and the place in it
    placed = written(ranged.withColumn("__place", F.monotonically_increasing_id()), "names")
    task, place = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__task", (F.sum("n").over(Window.orderBy("__task")) - F.col("n")).alias("before"))
    return placed.withColumn("__task", task).join(F.broadcast(before), "__task").select(name, (F.col("before") + place + 1).cast("long").alias("name_rank"))
