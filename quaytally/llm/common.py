"""What the corpus operators share: reading, shared storage and batches of texts."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one task works on at a time.
CHUNK_BYTES = 2 << 20
#: Entries of a per-process word cache before it starts anew.
CACHE_WORDS = 500_000
#: Words of a class that the classifiers learn from before they take no more rows (about 30 MB of hashes).
TRAIN_WORDS = 2_500_000


#: Rows that Spark's reader and its way to Python hold at a time. Of long texts the usual 4,096 and 10,000 are too many.
ROWS_AT_ONCE = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 2000}


def sized_for_texts(spark: SparkSession) -> None:
    """Sets ROWS_AT_ONCE in the session, where it has more."""
    for name, most in ROWS_AT_ONCE.items():
        if int(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sized_for_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folders: dict[str, str] = {}


_tables: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from the session; one of our own only where it is unset and Spark runs in
    one process (tests). A cluster's executors would not see a local folder of the driver."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or _own_folders.get(context.applicationId)
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own_folders[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return found


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and outlives any executor."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes what the operators of this application have written to the shared folder, once their results have been
    read or stored; gives the number of paths."""
    paths = _tables.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    return len(paths)


#: Rows of one or two numbers that go to every task (some 50 MB as a hash table).
FEW = 1_000_000


def few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """rows (one or two numbers each), for a join: broadcast if a count shows that they are at most `most`, else as they are."""
    return F.broadcast(rows) if rows.count() <= most else rows


def unused(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column in `taken` has it, whatever the case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row that stays, and the column's name: ids may be null or repeated, these are not."""
    name = unused("__row", docs.columns)
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


#: Tasks that a hot key's rows are dealt over, the share of all rows (one in so many) that makes a key hot, and
#: the number of narrow rows below which one task may take them all.
PARTS, HOT, DEAL_FROM = 256, 1000, 1_000_000


def dealt_join(many: DataFrame, one: DataFrame, keys: list[str], spread: Column, total: int, least: int = DEAL_FROM, counts: DataFrame | None = None) -> DataFrame:
    """many (`total` rows) joined to one, which has a row for each key and in __many the key's number of rows in `many`
    (`counts` has these numbers alone, where they cost less).

    The rows of a key that holds more than a thousandth of them go to several tasks, by `spread`. Fewer than HOT
    keys can be so hot, so a list of them may be broadcast. With fewer rows than `least`, or no hot key, it is a plain join."""
    most = max(PARTS, total // HOT)
    known = [] if total < least else (one if counts is None else counts).where(F.col("__many") > most).select(*keys).collect()  # fewer than HOT rows
    if not known:
        return many.join(one.drop("__many"), keys)
    types = dict(many.dtypes)
    hot = F.broadcast(many.sparkSession.createDataFrame(known, ", ".join(f"{k} {types[k]}" for k in keys)).withColumn("__hot", F.lit(True)))
    dealt = many.join(hot, keys, "left").withColumn("__part", F.when(F.col("__hot"), F.pmod(spread, F.lit(PARTS)).cast("int")).otherwise(0)).drop("__hot")
    copies = one.withColumn("__part", F.explode(F.when(F.col("__many") > most, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))).drop("__many")
    return dealt.join(copies, [*keys, "__part"]).drop("__part")


def texts(docs: DataFrame, *more: str | Column, text: str = "text") -> DataFrame:
    """The text in UTF-8 as `raw` (null stays null), besides the columns named."""
    return docs.select(*more, F.col(text).cast("binary").alias("raw"))


def chunks(batches: Iterator[pa.RecordBatch], raw: str = "raw") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about CHUNK_BYTES of text each, and their texts; null counts as empty."""
    for batch in batches:
        sizes = np.diff(np.asarray(_offsets(batch.column(batch.schema.get_field_index(raw)))))
        begin = 0
        while begin < batch.num_rows:
            taken = np.searchsorted(np.cumsum(sizes[begin:]), CHUNK_BYTES, side="right")
            end = min(batch.num_rows, begin + max(1, int(taken)))
            part = batch.slice(begin, end - begin)
            own = part.column(part.schema.get_field_index(raw))
            own = own.cast(pa.binary()) if pa.types.is_string(own.type) or pa.types.is_large_string(own.type) else own
            yield part, [x or b"" for x in own.to_pylist()]
            begin = end


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)


def hash64(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class WordCodes(dict):
    """word -> unsigned 64-bit code, kept for words seen; emptied by trim() once it is large."""

    def __init__(self, code=hash64):
        super().__init__()
        self.code = code

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.code(word)
        return value

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(a: np.ndarray, b: np.ndarray | int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of two 64-bit numbers, element by element."""
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(0x9E3779B97F4A7C15 + salt)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x = (x + b) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(31))


def held_out(id: Column) -> Column:
    """Whether a document's labels are kept from training; a null id's are not."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id: str, text: str) -> DataFrame:
    """A bounded sample of labelled rows that are not held out, by hash of their id: raw, label, lang."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label")).where("__id is not null and label in (0, 1)")
    known = known.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("label").alias("label"))
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("__id")).limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # 2 * per_class ids at most
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col(id).alias("__doc"), F.col(text).cast("binary").alias("raw"), lang.alias("lang"))
    key = F.xxhash64("__doc", "raw").alias("key")
    return own.join(F.broadcast(chosen), own["__doc"] == chosen["__id"]).select("raw", "label", F.coalesce("lang", F.lit("")).alias("lang"), key)


def whole_rows(coded: DataFrame, per_class: int, most_words: int) -> list[dict]:
    """The rows (key, label, words, ...) to learn from, each whole: by key, per_class a class at most, and
    no more of a class once its words have reached most_words. Rows of one key count once."""
    coded, chosen = written(coded, "sample"), []
    for y in (0, 1):
        left = most_words
        for r in coded.where(F.col("label") == y).groupBy("key").agg(F.max("words").alias("words")).orderBy("key").limit(per_class).collect():
            if left <= 0:
                break
            left -= r["words"]
            chosen.append(r["key"])
    return coded.where(F.col("key").isin(chosen)).dropDuplicates(["key"]).toArrow().to_pylist() if chosen else []
