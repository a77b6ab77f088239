"""Near-duplicates by fast similarity sketching, banding and exact verification.

A text's set is that of its distinct runs of SHINGLE words (64-bit hashes). Sketching goes in rounds:
round r hashes every element to one of COORDINATES bins and to a value that is larger than any value
of earlier rounds; the bins keep their least value. Rounds 0 to t-1 choose bins by hash, rounds t to
2t-1 bin r-t, so after at most 2t rounds every coordinate is filled; a text stops once its are. As
all elements of a round share the bins, one or two rounds do for most texts, and the estimate is as
concentrated as with independent hash functions.

1. Texts of one set are one node (the smallest id); copies never meet in pairs. Keys that hold more than a
   thousandth of the rows (a text of many copies, a node of many links) are dealt over several tasks.
2. Nodes of a common band are a bucket. The node of each bucket that shares most bands is held
   against its others on the full sets, then the smallest node against those not yet in its
   component; the links found give components.
3. Buckets of three or more nodes that still hold several components have pairs not yet looked at.
   Their nodes go to an exact join: elements ordered by rarity, sets of sizes n and m that
   are similar enough have k = ceil(0.75 (n + m) / 1.75) common elements, so one among the first
   n - k + 1 and m - k + 1; sizes must fit, pairs of one component are left out, and the candidates
   are verified on the full sets. No bucket is cut or sampled.

Two sets of similarity 0.75 share no band with probability (1 - 0.75 ** ROWS) ** BANDS < 0.0002.

Null and empty texts have an empty set and are linked with nothing. A text of fewer words than a
shingle has one element, its whole sequence. Long texts are whole. Rows that share an id are one node
where they share a set. A null id takes part in no link (in near_dedup it does). An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaytally.llm.common import chunks, dealt_join, few, mixed, numbered, written
from quaytally.llm.graph import components
from quaytally.llm.words import words_of

SHINGLE, ROWS, BANDS, PERCENT = 5, 5, 32, 75
COORDINATES = ROWS * BANDS


def element_sets(raws: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct elements of all texts one after another, ascending in each text, and each text's number."""
    words = words_of(raws, lower=True)
    code, sizes, first, of = words.code, words.size, words.first, words.text
    at = np.flatnonzero(np.arange(len(code)) + size <= (first + sizes)[of]) if len(code) else np.zeros(0, np.int64)
    short = np.flatnonzero((sizes > 0) & (sizes < size))
    value = np.full(len(at), size, np.uint64)
    for j in range(size):
        value = mixed(value, code[at + j])
    extra = np.array([_sequence(code[first[d] : first[d] + sizes[d]]) for d in short], np.uint64)
    value, owner = np.concatenate([value, extra]), np.concatenate([of[at], short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(raws))


def _sequence(code: np.ndarray) -> np.uint64:
    value = np.full(1, len(code), np.uint64)
    for c in code:
        value = mixed(value, c)
    return value[0]


def sketch(elements: np.ndarray, sizes: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The sketches, by text; a text without elements has a meaningless one."""
    empty = np.uint64(2**64 - 1)
    state = np.full(len(sizes) * t, empty, np.uint64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    for r in range(2 * t):
        if not len(elements):
            break
        h = mixed(elements, np.uint64(r), 0x5851F42D4C957F2D)
        bins = (h % np.uint64(t)).astype(np.int64) if r < t else np.full(len(h), r - t)
        np.minimum.at(state, of * t + bins, np.uint64(r) << np.uint64(53) | mixed(h, np.uint64(1)) >> np.uint64(11))
        open_ = (state.reshape(-1, t) == empty).any(1)[of]
        elements, of = elements[open_], of[open_]
    return state.reshape(-1, t)


SKETCHES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def sketches(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set (null if empty), a hash by band."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in chunks(batches):
            elements, sizes = element_sets(raws)
            state = sketch(elements, sizes)
            bands = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(raws), 0)
            for j in range(ROWS):
                bands = mixed(bands, state[:, j::ROWS])
            some = sizes > 0
            ends = np.cumsum(sizes)
            hashes = []
            for salt in (1, 2):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(elements, np.uint64(salt)), dtype=np.uint64)])
                hashes.append(pa.array((total[ends] - total[ends - sizes]).view(np.int64), pa.int64(), mask=~some))
            offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands[some].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *hashes, lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("raw")).mapInArrow(make, SKETCHES)


def _fits(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _ceil_of(a: Column, b: int) -> Column:
    """a / b, rounded up, in whole numbers."""
    return F.floor((a + (b - 1)) / b)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two ascending sets share."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; bodies: node, raw.

    A node that is u of very many pairs is held against its partners in several tasks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in chunks(batches, "raw_v"):
            lefts = part.column(part.schema.get_field_index("raw_u")).to_pylist()
            numbers = {raw: i for i, raw in enumerate(dict.fromkeys(lefts))}
            sets = [np.split(value, np.cumsum(sizes)[:-1]) for value, sizes in (element_sets(list(numbers)), element_sets(raws))]
            keep = []
            for raw, b in zip(lefts, sets[1]):
                a = sets[0][numbers[raw]]
                common = _common(a, b)
                keep.append(common > 0 and 100 * common >= PERCENT * (len(a) + len(b) - common))
            yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs.select("u", "v"), "pairs")
    counts = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("__many"))
    left = bodies.join(counts, bodies["node"] == counts["u"]).select("u", F.col("raw").alias("raw_u"), "__many")
    right = bodies.select(F.col("node").alias("v"), F.col("raw").alias("raw_v"))
    both = dealt_join(pairs.join(right, "v"), left, ["u"], F.xxhash64("v"), pairs.count(), least=0, counts=counts)
    return both.select("u", "v", "raw_u", "raw_v").mapInArrow(check, "u long, v long")


def _rest(rest: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs of rest (node, component) of different components that the prefix filter lets through."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in chunks(batches):
            value, sizes = element_sets(raws)
            own = np.repeat(np.arange(len(raws)), sizes)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(value.view(np.int64))], names=["node", "component", "n", "element"])

    rows = written(rest.join(bodies, "node").select("node", "component", "raw").mapInArrow(elements, "node long, component long, n long, element long"), "elements")
    # an element of one component links nothing; it is the rarest kind
    counts = rows.groupBy("element").agg(F.count(F.lit(1)).alias("df"), (F.min("component") != F.max("component")).alias("mixed"))
    by_rarity = Window.partitionBy("node").orderBy("mixed", "df", "element")
    prefix = rows.join(counts, "element").withColumn("place", F.row_number().over(by_rarity))
    needed = F.col("n") - _ceil_of(F.col("n") * PERCENT, 100) + 1
    prefix = written(prefix.where(F.col("mixed") & (F.col("place") <= needed)).select("element", "node", "component", "n", "place"), "prefix")
    a, b = (prefix.select("element", *(F.col(c).alias(c + x) for c in ("node", "component", "n", "place"))) for x in "ab")
    # two sets of these sizes need so many common elements: the first of them leaves room for the others
    overlap = _ceil_of((F.col("na") + F.col("nb")) * PERCENT, 100 + PERCENT)
    fits = _fits(F.col("na"), F.col("nb")) & (F.col("placea") <= F.col("na") - overlap + 1) & (F.col("placeb") <= F.col("nb") - overlap + 1)
    return a.join(b, "element").where((F.col("nodea") < F.col("nodeb")) & (F.col("componenta") != F.col("componentb")) & fits).select(F.col("nodea").alias("u"), F.col("nodeb").alias("v")).distinct()


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    all_sketches = written(sketches(docs, id, text), "sketches")
    some = all_sketches.where("n_shingles > 0 and doc_id is not null")
    # one node for each set: what it has is a function of the set, so copies are combined before they move
    own = written(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("__many")), "nodes")
    buckets = own.select(F.explode("bands").alias("band"), "node", F.col("n_shingles").alias("n"))
    shared = buckets.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("least <> last").drop("last")
    shared = written(shared.withColumn("__many", F.col("size")), "shared")
    total = own.count() * BANDS
    members = written(dealt_join(buckets, shared, ["band"], F.xxhash64("node"), total), "buckets")
    # the node that shares most bands with others is the nearest to all of them
    degrees = members.groupBy("node").agg(F.sum("size").alias("degree"))
    central = members.join(degrees, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("best"), F.count(F.lit(1)).alias("__many")).select("band", F.col("best.node").alias("central"), "__many")
    central = written(central, "central")

    found = docs.select(F.col(id).alias("node"), F.col(text).cast("binary").alias("raw"))
    bodies = written(found.join(few(written(members.select("node").distinct(), "named")), "node"), "bodies")
    sizes = members.select(F.col("node").alias("u"), F.col("n").alias("nu")).distinct()

    def star(centres: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """Verified links of each bucket's centre (u) with its other nodes, of other components if there are labels."""
        pairs = centres.where("u <> v").distinct()
        if labels is not None:
            for end in "uv":
                pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
            pairs = pairs.where(F.coalesce("cu", "u") != F.coalesce("cv", "v"))
        return written(verified(pairs.join(sizes, "u").where(_fits(F.col("n"), F.col("nu"))), bodies), "links")

    edges = star(dealt_join(members, central, ["band"], F.xxhash64("node"), total).select(F.col("central").alias("u"), F.col("node").alias("v"), "n"))
    labels = components(edges)
    second = star(members.where("size > 2").select(F.col("least").alias("u"), F.col("node").alias("v"), "n"), labels)
    if not second.isEmpty():
        edges = edges.unionByName(second)
        labels = components(edges)

    labelled = members.where("size > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band")
    rest = written(labelled.join(several, "band", "left_semi").select("node", "component").distinct(), "rest")
    if not rest.isEmpty():
        more = verified(_rest(rest, bodies), bodies)
        labels = components(edges.unionByName(more))

    placed = dealt_join(some.select("doc_id", "n_shingles", "set_a", "set_b"), own.select("set_a", "set_b", "node", "__many"), ["set_a", "set_b"], F.xxhash64("doc_id"), some.count())
    # empty sets and null ids are linked with nothing
    alone = all_sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = placed.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")).unionByName(alone)
    return grouped.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: one row of each group, with all their columns. Rows are told apart by their
    number, so null and repeated ids are grouped like any other."""
    own, row = numbered(docs)
    groups = near_groups(own, row, text).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")  # a null id comes last
    placed = written(own.select(F.col(row).alias("row"), F.col(id).alias("id")).join(groups, "row"), "placed")
    several = placed.groupBy("component").agg(first, F.count(F.lit(1)).alias("__many")).where("__many > 1").select("component", F.col("first.row").alias("stays"), "__many")
    several = written(several, "several")
    gone = dealt_join(placed, several, ["component"], F.xxhash64("row"), placed.count()).where("row <> stays").select(F.col("row").alias(row))
    return own.join(few(written(gone, "gone")), row, "left_anti").select(docs.columns)
