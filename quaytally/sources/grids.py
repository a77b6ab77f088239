"""Documents to grids: delivery-note CSV files and HTML pages as long tables of cells."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import count, groupby, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from quaytally.functions.headers import SKIP, field_named, fields_named
from quaytally.sources.shared import written


#: Blocks of files that are sent to every task at most; more are joined by shuffle.
MOST_BLOCKS = 200_000


def cells_of(record: str) -> list[str]:
    """The cells of a record: what stands between quotes is taken as it is, a quote between two quoted parts is one; elsewhere
    commas end cells and carriage returns go."""
    parts, cells, cell = record.split('"'), [], ""
    for i, part in enumerate(parts):
        if i % 2:
            cell += part
        elif not part and 0 < i < len(parts) - 1:
            cell += '"'
        else:
            first, *others = part.replace("\r", "").split(",")
            cell += first
            for other in others:
                cells.append(cell)
                cell = other
    return [*cells, cell]


BLOCKS = "file string, block long, size long, even long, odd long, quotes int, bytes long"


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """The blocks of lines (value, then what a block's lines have in common) in their order, each with its texts."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for own, block in groupby(rows, lambda row: row[1:]):
        yield own, (row[0] for row in block)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block (value, file, block, size): the records begun in it if it begins outside of quotes (even) or
    inside (odd), whether it has an odd number of quotes, and its bytes."""
    for own, values in _by_block(batches):
        even, odd, quotes, size = 0, 0, 0, 0
        for value in values:
            even, odd, size = even + (quotes == 0), odd + quotes, size + len(value.encode()) + 1
            quotes = (quotes + value.count('"')) % 2
        yield pa.RecordBatch.from_pydict({"file": [own[0]], "block": [own[1]], "size": [own[2]], "even": [even], "odd": [odd], "quotes": pa.array([quotes], pa.int32()), "bytes": [size]})


def _recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of blocks (value, file, block, size, parted, inside, before) as cells; in a parted file, what may go on in
    the block before or behind is a text without cells, for `delivery_notes` to put together."""
    out, signs = [], 0

    def made() -> pa.RecordBatch:
        columns = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())))], names=["file", "record", "block", "text", "cells"])

    for (file, block, size, parted, inside, before), values in _by_block(batches):
        record, lines, bytes_, quoted, cut = before, [], 0, inside, inside
        for value in values:
            bytes_ += 0 if parted else len(value.encode()) + 1
            if not quoted and lines:
                text = "\n".join(lines)
                out.append((file, record, block, text, None) if cut else (file, record, block, None, cells_of(text)))
                signs += len(text)
                lines, cut = [], False
            if not lines and not quoted:
                record += 1
            lines.append(value)
            quoted ^= value.count('"') % 2 == 1
            if signs > BATCH_SIGNS:
                yield made()
                out, signs = [], 0
        ended = not parted and size - bytes_ in (0, 3)  # a line break ends the file (a byte order mark is no text)
        text = "\n".join([*lines, ""] if ended and quoted else lines)
        out.append((file, record, block, text, None) if cut or parted and quoted else (file, record, block, None, cells_of(text)))
        if ended and not quoted:
            out.append((file, record + 1, block, None, [""]))
    if out:
        yield made()


#: Signs of a batch of records, about.
BATCH_SIGNS = 1_000_000


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(cells_of, batch.column(2).to_pylist()), pa.list_(pa.string()))], names=["file", "record", "cells"])


def delivery_notes(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of any layout: file, record (from 1), cells. Quoted cells may hold line breaks and doubled quotes; all cells are strings.

    A file is read in blocks, by many tasks, and records that lie in one block never leave its task. Of a file in several blocks,
    each counts its quotes and, for both cases, the records that begin in it; sums over the blocks tell which case holds and
    number the records. Only records that go over the end of a block are brought together.
    What stands behind the last line break is a record, if only an empty one; an empty file has none."""
    read = spark.read.option("lineSep", "\n").text(path)
    place = {"file": "file_path", "block": "file_block_start", "size": "file_size"}
    parted = F.col("_metadata.file_block_length") < F.col("_metadata.file_size")
    lines = read.select("value", *(F.col(f"_metadata.{m}").alias(c) for c, m in place.items()), parted.alias("parted"))
    blocks = written(lines.where("parted").drop("parted").mapInArrow(_counted, BLOCKS), "csv")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    begun = F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum(begun).over(before), F.lit(0)))
    # a line break at the end of a file opens one more record, or goes on with a quoted cell (a byte order mark is no text)
    ends = blocks.groupBy("file").agg(F.max_by(F.struct((F.col("before") + begun).alias("records"), (F.col("inside") != (F.col("quotes") == 1)).alias("inside")), "block").alias("end"), F.max("size").alias("size"), F.sum("bytes").alias("bytes"))
    ends = ends.where((F.col("size") - F.col("bytes")).isin(0, 3)).select("file", (F.col("end.records") + F.when(F.col("end.inside"), 0).otherwise(1)).alias("record"), F.lit(1 << 62).alias("block"), F.lit("").alias("text"))
    known = blocks.select("file", "block", "inside", "before")
    if known.limit(MOST_BLOCKS + 1).count() <= MOST_BLOCKS:
        placed = lines.join(F.broadcast(known), ["file", "block"], "left")
    else:
        numbered = lines.withColumn("place", F.monotonically_increasing_id()).join(known, ["file", "block"], "left")
        placed = numbered.repartition("file", "block").sortWithinPartitions("file", "block", "place")
    placed = placed.select("value", "file", "block", "size", "parted", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("before", F.lit(0)).cast("long").alias("before"))
    records = lambda rows: rows.mapInArrow(_recorded, "file string, record long, block long, text string, cells array<string>")
    pieces = records(placed.where("parted")).where("cells is null").select("file", "record", "block", "text").unionByName(ends)
    texts = pieces.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("pieces"))
    rest = texts.select("file", "record", F.array_join("pieces.text", "\n").alias("text")).mapInArrow(_parsed, "file string, record long, cells array<string>")
    return records(placed).where("cells is not null").select("file", "record", "cells").unionByName(rest)


def headed_rows(records: DataFrame, known: tuple[str, ...] = ("MARKS", "MARKS / SKU", "SKU", "NAME")) -> DataFrame:
    """Records after the first that names a known column, as maps from header to cell; blank records and
    single-cell banners go. In a file without such a record, all records after its first one.

    Unnamed columns are __colN; of columns of one name the last counts."""
    named = F.exists("cells", lambda c: F.upper(F.trim(c)).isin(*known))
    first = F.min(F.struct((~named).alias("other"), "record", "cells")).over(Window.partitionBy("file"))
    rows = records.withColumn("header", first).where("record > header.record")
    return rows.select("file", "record", "cells", "header.other", F.col("header.cells").alias("header")).mapInArrow(_mapped, "file string, record long, cells map<string,string>")


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, record, cells, other, header) as maps; the names of a header are made once for all rows below it."""
    own, places = None, {}
    for batch in batches:
        kept, maps = [], []
        for i, (cells, other, header) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
            if header != own:
                titles = [c.replace("\n", " ").strip(" ") for c in header]
                own, places = header, {title or f"__col{at}": at for at, title in enumerate(titles)}
            if other or sum(c.strip(" ") != "" for c in cells) > 1:
                kept.append(i)
                maps.append([(name, cells[at] if at < len(cells) else "") for name, at in places.items()])
        at = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(maps, pa.map_(pa.string(), pa.string()))], names=["file", "record", "cells"])


# Named entities and their signs, in the order in which they are decoded.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))
WHITE = re.compile("[ \t\n\x0b\f\r\xa0\u3000]+")
#: White space that is more than a space.
WIDES = ("  ", "\t", "\n", "\x0b", "\f", "\r", "\xa0", "\u3000")
WIDE = re.compile("  |[\t\n\x0b\f\r\xa0\u3000]")
# what stands between two tags is skipped as a whole
TABLE, ROW = re.compile(r"<table\b[^>]*>[^<]*+(?:<(?!/table>)[^<]*+)*+</table>", re.I), re.compile(r"<tr\b[^>]*>([^<]*+(?:<(?!/tr>)[^<]*+)*+)</tr>", re.I)
CELL = re.compile(r"<t[dh]\b([^>]*)>(.*?)</t[dh]>", re.I | re.S)
SPAN = re.compile(r"\b(col|row)span\s*=\s*[\"']?(\d+)", re.I)
HALF, ENDS_SMALL, SMALL = re.compile("[\ud800-\udfff]"), re.compile("[a-zA-Z]$"), re.compile("[a-z]{1,2}")
BREAK, TAG, NUMBERED = re.compile(r"<br\s*/?>", re.I), re.compile("<[^>]+>"), re.compile("&#([0-9]+|x[0-9a-f]+);", re.I)
#: Cells of a batch of grids, about.
BATCH_CELLS = 100_000


def _squeezed(text: str) -> str:
    return WHITE.sub(" ", text).strip(" ") if WIDE.search(text) else text.strip(" ")


def _sign(found: re.Match) -> str:
    """A numeric entity as its sign, a UTF-16 unit; a number beyond 64 bits is text."""
    code = int(found[1][1:], 16) if found[1][0] in "xX" else int(found[1])
    return found[0] if code >= 1 << 63 else chr(code % 65536)


def decoded(text: str) -> str:
    """Named and numeric entities as their signs."""
    if "&" not in text:
        return text
    for name, sign in ENTITIES:
        text = text.replace(name, sign)
    if "&#" in text:
        text = NUMBERED.sub(_sign, text)
        if HALF.search(text):  # two halves of a sign are one
            text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def cell_text(html: str) -> str:
    """A cell's text without tags. A line break is a space, or nothing before one or two small letters that end a word."""
    if "<" not in html:
        return _squeezed(decoded(html))
    if not BREAK.search(html):
        return _squeezed(decoded(TAG.sub("", html)))
    whole = ""
    for part in BREAK.split(html):
        part = _squeezed(decoded(TAG.sub("", part) if "<" in part else part))
        if part:
            ends_word = not whole or (SMALL.fullmatch(part) and ENDS_SMALL.search(whole))
            whole += part if ends_word else " " + part
    return _squeezed(whole)


def _texts(line: str) -> list[str]:
    """The texts of a row's cells, each as often as it spans columns."""
    if line.startswith("<td>") and line.endswith("</td>"):
        cells = line[4:-5].split("</td><td>")
        if line.count("<") == 2 * len(cells):  # no cell has attributes or tags, as in most rows
            return [*map(cell_text, cells)] if "&" in line or any(wide in line for wide in WIDES) else [c.strip(" ") for c in cells]
    return [text for attributes, html in CELL.findall(line) for text in [cell_text(html)] * (_spans(attributes)[0] if attributes else 1)]


def _spans(attributes: str) -> tuple[int, int]:
    """The columns and rows that a cell spans."""
    spans = {kind.lower(): max(1, int(n)) for kind, n in SPAN.findall(attributes)}
    return min(spans.get("col", 1), MOST_COLUMNS), spans.get("row", 1)


def grid_of(table: str) -> list[list[str]]:
    """A table as rows of equally many texts; spanned places repeat the cell, missing ones are empty."""
    rows = ROW.findall(table)
    if "rowspan" not in table.casefold():  # rows stand for themselves
        # a table without wide space and entities is told once; its cells without tags are their own text
        alone = [_texts(line) for line in rows]
        most = max(map(len, alone), default=0)
        return [row + [""] * (most - len(row)) for row in alone]
    taken: dict[tuple[int, int], str] = {}
    lengths = [0] * len(rows)
    for r, line in enumerate(rows):
        col = 0
        for attributes, html in CELL.findall(line):
            while (r, col) in taken:
                col += 1
            (width, height), text = _spans(attributes) if attributes else (1, 1), cell_text(html)
            # what a span leaves beyond the last row is no row
            for k in range(r, min(r + height, len(rows))):
                lengths[k] = max(lengths[k], col + width)
                for c in range(col, col + width):
                    taken[k, c] = text
            col += width
    most = max(lengths, default=0)
    return [[taken.get((r, c), "") for c in range(most)] for r in range(len(rows))]


#: Columns that one cell may span, as in HTML.
MOST_COLUMNS = 1000


def pieces_of(html: str | None) -> list[tuple[str | None, list[list[str]] | None]]:
    """The texts and tables of a page in their order: (text, None) or (None, grid); blank texts go."""
    out: list[tuple[str | None, list[list[str]] | None]] = []
    at, html = 0, html or ""
    for found in TABLE.finditer(html):
        out += [(_squeezed(TAG.sub(" ", html[at : found.start()])), None), (None, grid_of(found[0]))]
        at = found.end()
    out.append((_squeezed(TAG.sub(" ", html[at:])), None))
    return [p for p in out if p[0] != ""]


GRID = pa.list_(pa.list_(pa.string()))


def html_pieces(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, piece, table, text, grid: the texts and tables of each page in their order, tables with their number
    from 0 (null for texts). No row leaves its task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], 0

            def made() -> pa.RecordBatch:
                at, number, table, text, grid = zip(*rows)
                own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
                return pa.RecordBatch.from_arrays([*own, pa.array(number, pa.int32()), pa.array(table, pa.int32()), pa.array(text, pa.string()), pa.array(grid, GRID)], names=[*keys, "piece", "table", "text", "grid"])

            for i, page in enumerate(batch.columns[-1]):
                tables = count()
                for number, (text, grid) in enumerate(pieces_of(page.as_py())):
                    rows.append((i, number, None if grid is None else next(tables), text, grid))
                    cells += sum(map(len, grid or ()))
                if cells > BATCH_CELLS:
                    yield made()
                    rows, cells = [], 0
            if rows:
                yield made()

    schema = TY.StructType([*(pages.schema[k] for k in keys), TY.StructField("piece", TY.IntegerType()), TY.StructField("table", TY.IntegerType()), TY.StructField("text", TY.StringType()), TY.StructField("grid", TY.ArrayType(TY.ArrayType(TY.StringType())))])
    return pages.select(*keys, html).mapInArrow(parse, schema)


def html_grids(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, table, grid: every table of a page, by number from 0, as rows of equally many texts."""
    own = pages.select(F.col(id).alias("page_id"), F.col(html).alias("html"))
    return html_pieces(own, ["page_id"]).where("grid is not null").select("page_id", "table", "grid")


def html_cells(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, table, row, col, text of every cell of every table."""
    rows = html_grids(pages, id, html).select("page_id", "table", F.posexplode("grid").alias("row", "cells"))
    return rows.select("page_id", "table", "row", F.posexplode("cells").alias("col", "text"))


def headed(grids: DataFrame, sales: bool, first_rows: int = 8) -> DataFrame:
    """Grids with score (labels in the header row), header_row, data_row (the first below the header), columns (their
    fields, null for none) and first_columns (the fields that the header's first row names by itself).

    The header is that of the first rows with most cells that name a field, the first of equals. A row
    below it that holds labels too is part of it: it names what the header leaves open, or both do together."""
    kept = [c for c in grids.columns if c != "grid"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header_of(grid, sales, first_rows) for grid in batch.column(len(kept)).to_pylist()]
            new = [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * len(HEADER), HEADER.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, "grid", *HEADER])

    names = TY.ArrayType(TY.StringType())
    types = {"score": TY.IntegerType(), "header_row": TY.IntegerType(), "data_row": TY.IntegerType(), "first_columns": names, "columns": names}
    rows = grids.select(*kept, "grid")
    return rows.mapInArrow(read, TY.StructType([*rows.schema, *(TY.StructField(c, t) for c, t in types.items())]))


HEADER = {"score": pa.int32(), "header_row": pa.int32(), "data_row": pa.int32(), "first_columns": pa.list_(pa.string()), "columns": pa.list_(pa.string())}


def header_of(grid: list[list[str]], sales: bool, first_rows: int) -> tuple:
    """A grid's HEADER (see `headed`)."""
    labels = [fields_named(row, sales) for row in grid[: first_rows + 1]]
    if not labels:
        return 0, None, None, None, None
    scores = [len(row) - row.count(None) for row in labels[:first_rows]]
    at = scores.index(max(scores))
    first, second = grid[at], grid[at + 1] if at + 1 < len(grid) else []
    filled = sum(bool(c and c.strip(" ")) for c in second)
    hits = sum(f not in (None, SKIP) for f in labels[at + 1]) if second else 0
    if not filled or not (filled <= 8 and hits == filled or hits >= max(2, math.ceil(filled * 0.35))):
        return scores[at], at, at + 1, labels[at], labels[at]
    pairs = zip_longest(first, second, fillvalue="")
    columns = [field_named(a, sales) or field_named(b, sales) or field_named(f"{a.strip(' ')} {b.strip(' ')}".strip(" "), sales) for a, b in pairs]
    return scores[at], at, at + 2, labels[at], columns


def with_columns(grids: DataFrame, sales: bool, first_rows: int = 8, least: int = 3) -> DataFrame:
    """The grids of `headed` whose header names `least` fields or more."""
    return headed(grids, sales, first_rows).where(F.col("score") >= least).drop("score", "first_columns")


def field_rows(pages: DataFrame, fields: tuple[str, ...], sales: bool = True) -> DataFrame:
    """Rows below the header as one column per field; different texts of one field are joined."""
    headed = with_columns(html_grids(pages), sales)
    rows = headed.select("page_id", "table", "data_row", "columns", F.posexplode("grid").alias("row", "cells")).where("row >= data_row")

    def value(f: str) -> Column:
        own = F.filter(F.col("cells"), lambda c, i: (F.try_element_at(F.col("columns"), i + 1) == f) & (F.trim(c) != ""))
        return F.when(F.array_contains("columns", f), F.array_join(F.array_distinct(own), " ")).alias(f)

    return rows.select("page_id", "table", "row", *map(value, fields))


# Cells at the end of a sales row that are no part of its description.
WAREHOUSE_CELL = re.compile("仓|WAREHOUSE", re.I)
TAIL_CELL = re.compile("仓|WAREHOUSE|^\\s*(?:PCS|SET|DCS|PS|PCS/SE)\\s*$|[\u4e00-\u9fff]", re.I)
#: Cells from the end in which a sales row shows that it ends with such cells.
TAIL_CELLS = 6


def aligned(cells: list[str], columns: list[str | None], sales: bool) -> list[str]:
    """Cells with as many places as columns are known: fields by position, None for unknown ones.

    What a row has too much is joined to its description, unless the header spreads that over neighbours too; what it
    lacks of a spread description is left blank. A sales row that ends with a warehouse, a unit or Chinese
    words has its surplus there, and stays. So does a row without a description column."""
    last = max((i for i, f in enumerate(columns) if f is not None), default=None)
    if last is None or "description" not in columns:
        return cells
    first, more = columns.index("description"), len(cells) - (last + 1)
    after = next((i for i, f in enumerate(columns[first:]) if f != "description"), len(columns) - first)
    if more > 0 and after == 1:
        if sales and (WAREHOUSE_CELL.search(cells[last]) or any(map(TAIL_CELL.search, cells[last + 1 :] + cells[-TAIL_CELLS:]))):
            return cells
        joined = " ".join(c for c in cells[first : first + more + 1] if c.strip())
        return [*cells[:first], joined, *cells[first + more + 1 :]]
    if more < 0 and -more < after:
        return [*cells[: first + 1], *[""] * -more, *cells[first + 1 :]]
    return cells


def aligned_rows(rows: DataFrame, columns: list[str | None], sales: bool = False) -> DataFrame:
    """Rows of cells (`cells`) aligned to the columns, as `aligned` does."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("cells")
            new = pa.array([c and aligned(c, columns, sales) for c in batch.column(at).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(align, rows.schema)
