"""Packing of tokenised documents into sequences by shortest-pack-first over the length histogram.

Each document's ids, closed by id 0, are cut at multiples of the sequence length. Only the histogram
of piece lengths (as many rows as a sequence has tokens) decides the packing: packs are opened for the
total of all tokens, lengths are placed longest first, always into the packs that hold least so far,
and packs of one content are one pattern with a count. Pieces then find their place by their rank
among the pieces of their length. A length has a bucket for each few hundred of its pieces (more, once
there are 100,000 buckets), so that a length of a third of all pieces is spread over many tasks.

Null and empty texts are one piece with id 0 alone. Long texts are whole. Repeated rows are packed
each. A null id stays null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaytally.llm.common import chunks, texts, written

LENGTH = 1024
#: Pieces of one length that are ranked together, and groups of such pieces besides one a length: more pieces make larger groups.
BUCKET_PIECES, MOST_BUCKETS = 256, 100_000
#: Pieces of text that a worker remembers the ids of; encoding anew is what costs.
CACHE_PIECES = 1_000_000
#: Pieces that are encoded together.
TOGETHER = 50


class Numbers(dict):
    """piece -> number, in the order in which pieces are first seen; new ones are also in `unseen`."""

    unseen: list[str]

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.unseen.append(piece)
        return number


class Ids:
    """Texts' token ids.

    The byte-level tokenizer splits before it merges, and never across a space or line break that
    stands alone between other characters; so a text is cut before each of these, and each piece is
    encoded once and remembered. A piece's first token is the only one that begins with a space or line
    break, so many pieces are encoded in a row and told apart by these. Texts with other white space, or
    with the special token's string, are encoded as a whole."""

    #: White space besides the space and the line break, in ASCII and beyond.
    OTHER = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
    BEYOND = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    #: Closes a document; stands for id 0.
    END = ""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        # fixed values: how a byte-level vocabulary writes the space and the line break
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[0] in "\u0120\u010a"]] = True
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers({self.END: 0})
        self.numbers.unseen = []
        self.tokens, self.used = np.zeros(1 << 16, np.uint32), 1
        self.begin, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def encoded(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def is_plain(self, text: str, raw: bytes) -> bool:
        """Whether all white space is single spaces and line breaks inside the text."""
        if not text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or "<|endoftext|>" in text:
            return False
        return len(raw.translate(None, self.OTHER)) == len(raw) and (text.isascii() or not any(c in text for c in self.BEYOND))

    def learn(self) -> None:
        """Encodes the pieces not seen before."""
        unseen, self.numbers.unseen = self.numbers.unseen, []
        if not unseen:
            return
        rows = [p if p[0] == "\n" else f" {p}" for p in unseen]
        tokens = np.concatenate(self.encoded(["".join(rows[i : i + TOGETHER]) for i in range(0, len(rows), TOGETHER)]))
        begin = np.flatnonzero(self.opens[tokens])
        if len(begin) != len(rows):
            raise ValueError("the tokenizer does not split at spaces and line breaks")
        if self.used + len(tokens) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens[: self.used], np.zeros(self.used + 2 * len(tokens), np.uint32)])
        self.tokens[self.used : self.used + len(tokens)] = tokens
        self.begin = np.concatenate([self.begin, self.used + begin])
        self.size = np.concatenate([self.size, np.diff(np.append(begin, len(tokens)))])
        self.used += len(tokens)

    def of(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, closed by id 0."""
        if len(self.numbers) > CACHE_PIECES:
            self.forget()
        whole = [raw.decode("utf-8", "replace") for raw in raws]
        plain = [self.is_plain(t, raw) for t, raw in zip(whole, raws)]
        others = iter(self.encoded([t for t, p in zip(whole, plain) if not p]))
        # a line break before the text makes its first piece one like those of later lines
        pieces = [("\n" + t.replace("\n", " \n")).split(" ") for t, p in zip(whole, plain) if p]
        number = np.fromiter(chain.from_iterable(chain(map(self.numbers.__getitem__, d), (0,)) for d in pieces), np.int64)
        self.learn()
        begin, size = self.begin[number], self.size[number]
        many = np.array([len(d) + 1 for d in pieces], np.int64)
        last = np.cumsum(many)
        first = last - many
        begin[first] += 1  # without that line break
        size[first] -= 1
        ends = np.cumsum(size)
        ids = self.tokens[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        own = iter(np.split(ids, ends[last - 1][:-1]))
        return [next(own) if p else np.append(next(others), np.uint32(0)) for p in plain]


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents' ids cut at multiples of length: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        for part, raws in chunks(batches):
            keys, starts, lengths, sums, totals = [], [], [], [], []
            for key, own in zip(part.column(0).to_pylist(), ids.of(raws)):
                n = len(own)
                own = own.astype("<u4").tobytes()
                for start in range(0, n, length):
                    keys.append(key)
                    starts.append(start)
                    lengths.append(min(length, n - start))
                    sums.append(zlib.crc32(own[4 * start : 4 * (start + length)]))
                    totals.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, lengths, sums, totals)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        ids.forget()  # a worker's next tasks may be another operator's

    return texts(docs, F.col(id).alias("doc_id"), text=text).mapInArrow(cut, PIECES)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(count, piece lengths) of the packs for a histogram of piece lengths."""
    whole = histogram.get(length, 0)
    rest = sorted(((n, c) for n, c in histogram.items() if c and n < length), reverse=True)
    done: list[tuple[int, tuple[int, ...]]] = [(whole, (length,))] if whole else []
    opened = -(-sum(n * c for n, c in rest) // length)
    packs: list[tuple[int, tuple[int, ...], int]] = [(0, (), opened)] if opened else []  # filled, content, count
    for n, count in rest:
        while count:
            if not packs or packs[0][0] + n > length:
                heapq.heappush(packs, (0, (), count))
            filled, content, many = heapq.heappop(packs)
            taken = min(many, count)
            count -= taken
            if many > taken:
                heapq.heappush(packs, (filled, content, many - taken))
            if filled + n == length:
                done.append((taken, (*content, n)))
            else:
                heapq.heappush(packs, (filled + n, (*content, n), taken))
    return done + [(many, content) for filled, content, many in packs if filled]


class Places:
    """For the pieces of each length, by rank: their sequence and their offset there."""

    def __init__(self, packs: list[tuple[int, tuple[int, ...]]]):
        following: dict[int, int] = {}
        rows, base = [], 0
        for count, content in packs:
            offset = 0
            for n in content:
                rank = following.get(n, 0)
                rows.append((n, rank, base, offset))
                following[n] = rank + count
                offset += n
            base += count
        self.n, self.rank, self.base, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T
        self.first = np.searchsorted(self.n, np.arange(int(self.n.max(initial=0)) + 2))

    def of(self, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(n), np.empty_like(n)
        for length in np.unique(n):
            mine, low, high = n == length, self.first[length], self.first[length + 1]
            row = low + np.searchsorted(self.rank[low:high], rank[mine], side="right") - 1
            sequence[mine] = self.base[row] + rank[mine] - self.rank[row]
            offset[mine] = self.offset[row]
        return sequence, offset


PACKED = f"{PIECES}, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = written(pieces(docs, tokenizer, id, text, length), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # `length` rows at most
    bucket_pieces = max(bucket_pieces, sum(histogram.values()) // MOST_BUCKETS)
    many = [0] + [-(-histogram.get(n, 0) // bucket_pieces) for n in range(1, length + 1)]
    # all columns spread the pieces, also those of null or repeated ids
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.element_at(F.lit(many), F.col("length").cast("int") + 1).cast("long"))
    bucketed = rows.withColumn("bucket", spread.cast("int"))
    first = np.cumsum(many) - many  # the buckets of a length, in one row
    counts = np.zeros(sum(many), np.int64)
    for r in bucketed.groupBy("length", "bucket").count().collect():  # MOST_BUCKETS + length rows at most
        counts[first[r["length"]] + r["bucket"]] = r["count"]
    total = np.append(0, np.cumsum(counts))
    before = total[:-1] - np.repeat(total[first], many)
    shared = spark.sparkContext.broadcast((first, before, Places(patterns(histogram, length))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, places = shared.value
        for part in batches:
            own = {name: part.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(part.schema.names) if name in ("length", "bucket", "number")}
            sequence, offset = places.of(own["length"], before[first[own["length"]] + own["bucket"]] + own["number"] - 1)
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*part.schema.names[:5], "sequence_id", "offset"])

    in_bucket = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    return bucketed.withColumn("number", F.row_number().over(in_bucket)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "number").mapInArrow(place, PACKED)
