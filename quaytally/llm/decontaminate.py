"""Benchmark decontamination by a prefix-filtered join on shingles ordered by rarity.

A window is `size` consecutive words of a benchmark item (an item of fewer words, but not none, is one
window). A document that contains a window contains all its shingles, so it contains the rarest: that
one shingle is the window's necessary prefix. Shingles are counted over all documents, each window is
indexed by its rarest shingle, documents look up their shingles, and a window found in this way is
held against the document word by word where it would have to start, if it fits there.

The windows of a benchmark of at most `block_bytes` of text (its size is checked) go to every task. A larger
one is joined: shingles of documents that a filter of fixed size lets through, windows filed under their
rarest shingle, and the documents' texts, each once whatever the benchmark's size.

Nulls and empty texts have no words (a null or wordless item has no windows); a null id stays null.
Long texts are whole. Repeated rows give repeated results; repeated items, or items of one text,
count by item_id. Empty tables give an empty result or no hits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaytally.llm.common import chunks, mixed, numbered, texts, written
from quaytally.llm.words import Words, words_of

SIZE, SHINGLE, BLOCK_BYTES = 10, 3, 4 << 20

#: A-Z lower-cased; what is not part of a word becomes a space.
WORD_BYTES = bytes(ord(c.lower()) if (c := chr(i)).isascii() and c.isalnum() else (i if i >= 0x80 else 0x20) for i in range(256))


def words_of_text(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


@dataclass
class Windows:
    """A block's windows: word ids by row (0 beyond the window's length), and their items."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], size: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, raw in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of_text(raw)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(item)
        rows = np.zeros((len(found), size), np.int64)
        for row, window in zip(rows, found):
            row[: len(window)] = window
        return cls(vocabulary, rows, (rows > 0).sum(1), [sorted(x) for x in found.values()])

    def word_ids(self, documents: list[list[bytes]]) -> np.ndarray:
        """The documents' word ids one after another, 0 for a word of no window and between documents."""
        flat = chain.from_iterable(chain(d, (b"",)) for d in documents)
        return np.fromiter(map(self.vocabulary.get, flat, repeat(0)), np.int64, sum(map(len, documents)) + len(documents))


def shingle_codes(ids: np.ndarray, k: int) -> np.ndarray:
    """A code for the k ids from each place on; 0 where one of them is 0 or missing."""
    n = max(0, ids.shape[-1] - k + 1)
    code, whole = np.zeros((*ids.shape[:-1], n), np.uint64), np.ones((*ids.shape[:-1], n), bool)
    for j in range(k):
        part = ids[..., j : j + n]
        code = mixed(code, part.astype(np.uint64), k)
        whole &= part > 0
    return np.where(whole, code | np.uint64(1), np.uint64(0))


def known_codes(windows: Windows, shingle: int) -> list[tuple[int, np.ndarray]]:
    """Shingle length and sorted codes: windows shorter than a shingle have themselves as shingle."""
    kinds = []
    for k in range(1, shingle + 1):
        own = windows.ids[(windows.lengths >= k) if k == shingle else (windows.lengths == k)]
        codes = np.unique(shingle_codes(own, k))
        if (codes := codes[codes > 0]).size:
            kinds.append((k, codes))
    return kinds


def places(ids: np.ndarray, k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a known shingle starts, and its number in codes."""
    own = shingle_codes(ids, k)
    at = np.flatnonzero(own)
    number = np.minimum(np.searchsorted(codes, own[at]), len(codes) - 1)
    same = codes[number] == own[at]
    return at[same], number[same]


def shingle_counts(docs: DataFrame, windows, shingle: int) -> dict[tuple[int, int], int]:
    """How often each shingle of a block stands in all documents: (length, number) -> count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = windows.value
        kinds = known_codes(block, shingle)
        totals = [np.zeros(len(codes), np.int64) for _, codes in kinds]
        for _, raws in chunks(batches):
            ids = block.word_ids([words_of_text(r) for r in raws])
            for (k, codes), total in zip(kinds, totals):
                total += np.bincount(places(ids, k, codes)[1], minlength=len(codes))
        for (k, _), total in zip(kinds, totals):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["k", "number", "n"])

    rows = docs.select("raw").mapInArrow(count, "k int, number long, n long").groupBy("k", "number").agg(F.sum("n").alias("n")).collect()  # a block's shingles at most
    return {(r["k"], r["number"]): r["n"] for r in rows}


@dataclass
class Index:
    """Windows by their rarest shingle."""

    windows: Windows
    kinds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # length, codes, first entry of a code, windows, offsets

    @classmethod
    def of(cls, windows: Windows, counts: dict[tuple[int, int], int], shingle: int) -> Index:
        kinds = []
        for k, codes in known_codes(windows, shingle):
            rows = np.flatnonzero((windows.lengths >= k) if k == shingle else (windows.lengths == k))
            own = shingle_codes(windows.ids[rows], k)
            number = np.searchsorted(codes, own)
            frequency = np.array([counts.get((k, i), 0) for i in range(len(codes))], np.int64)
            rank = np.where(own > 0, frequency[np.minimum(number, len(codes) - 1)], np.iinfo(np.int64).max)
            offset = rank.argmin(1)
            rarest = number[np.arange(len(rows)), offset]
            order = np.argsort(rarest, kind="stable")
            first = np.searchsorted(rarest[order], np.arange(len(codes) + 1))
            kinds.append((k, codes, first, rows[order], offset[order]))
        return cls(windows, kinds)

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows in ids, and the windows."""
        starts, which = [], []
        for k, codes, first, rows, offsets in self.kinds:
            at, number = places(ids, k, codes)
            many = first[number + 1] - first[number]
            entry = np.repeat(first[number] - np.cumsum(many) + many, many) + np.arange(many.sum())
            start, window = np.repeat(at, many) - offsets[entry], rows[entry]
            length = self.windows.lengths[window]
            fits = (start >= 0) & (start + length <= len(ids))
            for n in np.unique(length[fits]):
                mine = fits & (length == n)
                s, w = start[mine], window[mine]
                same = (ids[s[:, None] + np.arange(n)] == self.windows.ids[w, :n]).all(1)
                starts.append(s[same])
                which.append(w[same])
        return (np.concatenate(starts), np.concatenate(which)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    shingle = min(shingle, size)
    own = texts(docs, F.col(id).alias("doc_id"), text=text)
    items = benchmark_items(benchmark, item, item_text)
    index = small_index(own, items, size, shingle, block_bytes)
    return own.mapInArrow(_searcher(index), DIGEST) if index else _joined(own, items, size, shingle)


def benchmark_items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("raw")).where("item is not null and raw is not null")


def small_index(own: DataFrame, items: DataFrame, size: int, shingle: int, block_bytes: int):
    """The broadcast index of a benchmark of at most block_bytes of text; None for a larger one."""
    if (items.agg(F.sum(F.length("raw"))).first()[0] or 0) > block_bytes:
        return None
    windows = Windows.of([(r["item"], bytes(r["raw"])) for r in items.collect()], size)  # block_bytes of text at most
    context = own.sparkSession.sparkContext
    counts = shingle_counts(own, context.broadcast(windows), shingle) if windows.items else {}
    return context.broadcast(Index.of(windows, counts, shingle))


#: Bits of the filter that keeps shingles of no window from being sent anywhere.
FILTER_BITS = 1 << 27


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each code."""
    mask = np.uint64(FILTER_BITS - 1)
    return (codes & mask).astype(np.int64), (codes >> np.uint64(32) & mask).astype(np.int64)


def _shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the k words from each place of a text on, and their places."""
    at = np.flatnonzero(np.arange(len(words.code)) + k <= np.repeat(words.first + words.size, words.size))
    code = np.full(len(at), k, np.uint64)
    for j in range(k):
        code = mixed(code, words.code[at + j])
    return code, at


def _joined(own: DataFrame, items: DataFrame, size: int, shingle: int) -> DataFrame:
    """decontamination for a benchmark of any size: windows and documents meet in joins on shingles.

    Shingles that pass a filter of fixed size are counted by document; each window is filed under its rarest,
    joined to the documents that have it, and verified there."""
    spark = own.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in chunks(batches):
            rows = []
            for name, raw in zip(part.column(0).to_pylist(), raws):
                words = words_of_text(raw)
                spans = [words[i : i + size] for i in range(max(1, len(words) - size + 1) if words else 0)]
                rows += [(name, b" ".join(w), min(len(w), shingle)) for w in spans]
            for begin in range(0, len(rows), 1 << 16):
                names, windows, ks = zip(*rows[begin : begin + (1 << 16)])
                found = words_of([*windows])
                codes: list[list[int]] = [[] for _ in windows]
                for k in set(ks):
                    code, at = _shingles(found, k)
                    for c, t in zip(code.view(np.int64).tolist(), found.text[at].tolist()):
                        if ks[t] == k:
                            codes[t].append(c)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(windows, pa.binary()), pa.array(ks, pa.int32()), pa.array(codes, pa.list_(pa.int64()))], names=["item", "raw", "k", "codes"])

    windows = written(items.mapInArrow(cut, "item string, raw binary, k int, codes array<long>"), "windows")
    kinds = sorted(r["k"] for r in windows.select("k").distinct().collect())  # `shingle` numbers at most

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            codes = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(np.concatenate(_places(codes)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    filled = windows.select("codes").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS at most
    bitmap = np.zeros(FILTER_BITS >> 6, np.uint64)
    bitmap[filled.column(0).to_numpy()] = filled.column(1).to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in chunks(batches):
            words = words_of([r.translate(WORD_BYTES) for r in raws])
            rows, codes = [], []
            for k in kinds:
                code, at = _shingles(words, k)
                some = np.ones(len(code), bool)
                for place in _places(code):
                    some &= (shared.value[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                rows.append(words.text[at[some]])
                codes.append(code[some])
            found = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(codes)]), axis=1) if kinds else np.zeros((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found[0].astype(np.int64))), pa.array(found[1].view(np.int64))], names=["__row", "code"])

    own, _ = numbered(own)  # doc_id, raw and __row
    codes = written(own.select("__row", "raw").mapInArrow(known, "__row long, code long"), "codes")
    counts = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    rarest = windows.select("item", "raw", F.explode("codes").alias("code")).join(counts, "code").groupBy("item", "raw").agg(F.min_by("code", F.struct("n", "code")).alias("code"))
    candidates = codes.join(rarest, "code").select("__row", "item", "raw")
    by_row = candidates.groupBy("__row").agg(F.collect_list("item").alias("items"), F.collect_list("raw").alias("windows"))
    return own.join(by_row, "__row", "left").select("doc_id", "raw", "items", "windows").mapInArrow(_verifier(size, shingle), DIGEST)


def _verifier(size: int, shingle: int):
    """Digests of documents (doc_id, raw) that bring the windows they may hold (items, windows)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in chunks(batches):
            names, windows = (part.column(i).flatten().to_pylist() for i in (2, 3))
            own = Windows.of(list(dict.fromkeys(zip(names, windows))), size)
            yield _searched(Index.of(own, {}, shingle), part.column(0), raws)

    return verify


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without any window of the benchmark, with all their columns. Each row is judged by itself, whatever its id."""
    shingle = min(SHINGLE, SIZE)
    index = small_index(texts(docs, text=text), benchmark_items(benchmark, item, item_text), SIZE, shingle, block_bytes)
    if index:

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, raws in chunks(batches, text):
                hit = _searched(index.value, part.column(0), raws).column(5)
                yield part.filter(pc.invert(hit))

        return docs.mapInArrow(choose, docs.schema)
    own, row = numbered(docs)  # by row, as an id may be null or repeated
    hit = decontamination(own.select(row, F.col(text).alias("text")), benchmark, row, item=item, item_text=item_text, block_bytes=block_bytes).where("contaminated").select(F.col("doc_id").alias(row))
    return own.join(hit, row, "left_anti").select(docs.columns)


def _searcher(index):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in chunks(batches):
            yield _searched(index.value, part.column(0), raws)

    return search


def _searched(index: Index, keys: pa.Array, raws: list[bytes]) -> pa.RecordBatch:
    documents = [words_of_text(r) for r in raws]
    starts, which = index.found(index.windows.word_ids(documents))
    begin = np.concatenate([[0], np.cumsum([len(d) + 1 for d in documents])])
    edges = np.zeros(begin[-1] + 1, np.int64)  # where hits begin and end, over all documents
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + index.windows.lengths[which], -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
    hits = hit[begin[1:]] - hit[begin[:-1]]
    names: list[set[str]] = [set() for _ in raws]
    for w, d in set(zip(which.tolist(), (np.searchsorted(begin, starts, side="right") - 1).tolist())):
        names[d].update(index.windows.items[w])
    hashes = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
    columns = [pa.array([len(d) for d in documents], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(hashes, pa.string()), pa.array(hits > 0, pa.bool_())]
    return pa.RecordBatch.from_arrays([keys, *columns], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
