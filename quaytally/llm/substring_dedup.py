"""Removal of repeated passages, found by recompression.

A text's words become symbols. A phase of recompression names runs (a symbol that stands any number of
times in a row becomes one symbol with its count) and pairs (symbols are left or right by a bit of their
name; a left one before a right one becomes one symbol). Names are hashes of the parts' names, equal
everywhere, and what is joined depends on the nearest symbols alone. A symbol is sure in a window of
`size` words if all that decides its extent lies in the window; equal windows have the same sure symbols.

1. The largest sure symbol of a window (by letters, then name, then the first) is its anchor; it is
   named with its sure neighbours. Windows without a sure symbol are their own anchors. Spark brings
   equal names of all documents together, keeps the shared ones, and sends them to their documents.
2. The windows of shared anchors are verified as a whole, by 128 bits of hash over all their words: for
   each, Spark finds the smallest document that has it.
3. A document removes the words of each such window that starts earlier somewhere: in a smaller
   document, or before in its own.

An anchor that a task sees in several places is known as shared at once: its places need no company, and
one row tells the other tasks. So an anchor sends a row or two per chunk of text, however hot it is.

Nulls and empty texts have no words. Texts of any length are whole (one text is one task's work).
Rows that share an id are judged alike and do not remove each other's words. A row with a null id keeps
its words and removes no other's. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaytally.llm.common import chunks, mixed, written
from quaytally.llm.words import Words, words_of

SIZE = 20
#: Windows of one block, so that a block's place and size fit one number.
BLOCK = 63
#: Windows that are given their anchors at a time.
SECTION, PLACE_BITS = 1 << 20, 24


def phases(size: int) -> int:
    """Rounds of runs and pairs after which a window usually still has several sure symbols."""
    return max(1, int(np.log2(max(1, size / 10))))


@dataclass
class Symbols:
    """A level of recompression over some texts: symbols, and those that are sure in each window."""

    name: np.ndarray
    letters: np.ndarray
    text: np.ndarray
    low: np.ndarray  # by window: its first sure symbol
    high: np.ndarray  # and its last


def _sure(s: Symbols, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """low and high as they are where they leave something, else 1 and 0."""
    room = (s.low <= s.high) & (low <= high)
    return np.where(room, low, 1), np.where(room, high, 0)


def runs(s: Symbols) -> Symbols:
    """Equal symbols in a row become one. A run is sure if the window holds its other neighbours too."""
    new = np.ones(len(s.name), bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.text[1:] != s.text[:-1])
    at, of = np.flatnonzero(new), np.cumsum(new) - 1
    many = np.diff(np.append(at, len(new)))
    name, several = s.name[at], many > 1
    name[several] = mixed(name[several], many[several].astype(np.uint64), 1)
    low, high = (of[np.minimum(x, len(new) - 1)] for x in (s.low, s.high))
    return Symbols(name, s.letters[at] * many, s.text[at], *_sure(s, low + 1, high - 1))


def pairs(s: Symbols, phase: int) -> Symbols:
    """A left symbol before a right one becomes one with it. What is sure has a sure symbol on either side."""
    left = (mixed(s.name, np.uint64(phase), 5) & np.uint64(1)).astype(bool)
    joined = np.zeros(len(s.name), bool)
    joined[:-1] = left[:-1] & ~left[1:] & (s.text[1:] == s.text[:-1])
    new = np.ones(len(s.name), bool)
    new[1:] = ~joined[:-1]
    at, of = np.flatnonzero(new), np.cumsum(new) - 1
    name, letters = s.name.copy(), s.letters.copy()
    i = np.flatnonzero(joined)
    name[i] = mixed(name[i], name[i + 1], 2)
    letters[i] += letters[i + 1]
    low, high = (np.clip(x, 0, len(new) - 1) for x in (s.low + 1, s.high - 1))
    first, last = _sure(s, of[low] + ~new[low], of[high])
    narrow = s.low + 1 > s.high - 1
    return Symbols(name[at], letters[at], s.text[at], np.where(narrow, 1, first), np.where(narrow, 0, last))


def largest(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the largest value from low to high (inclusive, both ascending) stands, the first of equals; low <= high."""
    best = np.empty(len(low), np.int64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for begin in range(0, len(low), SECTION):
        lo, hi = low[begin : begin + SECTION], high[begin : begin + SECTION]
        base, top = int(lo[0]), int(hi[-1]) + 1
        key = value[base:top] & ~mask | mask - np.arange(top - base, dtype=np.uint64)
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        levels = [key]
        for k in range(int(level.max())):
            wider = levels[-1].copy()
            wider[: -(1 << k)] = np.maximum(wider[: -(1 << k)], levels[-1][1 << k :])
            levels.append(wider)
        for k, own in enumerate(levels):
            mine = np.flatnonzero(level == k)
            found = np.maximum(own[lo[mine] - base], own[hi[mine] - base - (1 << k) + 1])
            best[begin + mine] = base + (mask - (found & mask)).astype(np.int64)
    return best


def window_hash(code: np.ndarray, window: np.ndarray, size: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64 bits for the words of each window."""
    total = np.zeros(len(window), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = total * np.uint64(factor) + code[window + j]
    return mixed(total, np.uint64(3))


def window_hashes(words: Words, window: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Twice 64 bits for the words of each window, from independent hashes of the words."""
    return window_hash(words.code, window, size), window_hash(words.second, window, size, 0xC2B2AE3D27D4EB4F)


def starts(words: Words, size: int) -> np.ndarray:
    """Where windows start, in words of all texts."""
    last = np.repeat(words.first + words.size - size, words.size)
    return np.flatnonzero(np.arange(len(last)) <= last)


def anchored(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of windows in a row with one anchor: first window, number of windows (BLOCK at most), anchor's name.

    A window equal to the one before it, inside a long run, is in no block (see `follows`)."""
    window = starts(words, size)
    length = words.end - words.start
    s = Symbols(words.code, length, words.text, window, window + size - 1)
    rounds = phases(size)
    for phase in range(rounds):
        s = pairs(runs(s), phase)
    # neighbours on either side that the name takes in, and that must be sure with it
    side = 3 if rounds == 1 and size >= SIZE else 1
    low, high = s.low + side, s.high - side
    own = low > high
    place = np.empty(len(window), np.int64)
    some = np.flatnonzero(~own)
    if some.size:
        value = np.minimum(s.letters, 255).astype(np.uint64) << np.uint64(56) | s.name >> np.uint64(8)
        place[some] = largest(value, low[some], high[some])
    alone = np.flatnonzero(own)
    place[alone] = -1 - window[alone]
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    name = np.empty(len(at), np.uint64)
    lonely = place[at] < 0
    name[lonely] = window_hash(words.code, window[at[lonely]], size)
    p = place[at[~lonely]]
    named = mixed(s.name[p], np.uint64(9))
    for j in range(1, side + 1):
        named = mixed(mixed(named, s.name[p - j]), s.name[p + j])
    name[~lonely] = named
    many = np.diff(np.append(at, len(window)))
    first = window[at]
    if lonely.any():
        keep = ~lonely | ~np.isin(first, follows(words, size))
        first, many, name = first[keep], many[keep], name[keep]
    if (many > BLOCK).any():
        parts = -(-many // BLOCK)
        which = np.repeat(np.arange(len(many)), parts)
        skip = BLOCK * (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts))
        first, many, name = first[which] + skip, np.minimum(many[which] - skip, BLOCK), name[which]
    return first, many, name


def follows(words: Words, size: int) -> np.ndarray:
    """Windows equal to the window one word before: size + 1 equal words in a row. They always go."""
    n = len(words.code)
    same = np.zeros(n, np.int64)
    same[1:] = (words.code[1:] == words.code[:-1]) & (words.text[1:] == words.text[:-1])
    if same.any():
        second = words.second
        same[1:] &= second[1:] == second[:-1]
    total = np.concatenate([[0], np.cumsum(same)])
    at = np.arange(1, max(1, n - size + 1))
    return at[total[at + size] - total[at] == size] if n >= size else at[:0]


ANCHORS = "doc_id long, block long, anchor long, many int"


def anchors(docs: DataFrame, size: int) -> DataFrame:
    """A row for each place of an anchor: doc_id, block (64 * first window + windows), anchor, many (places known so far).

    Places whose anchor the task has seen elsewhere have many = 2 and a number of their own as anchor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in chunks(batches):
            words = words_of(raws)
            first, many, name = anchored(words, size)
            of = words.text[first]
            block = (first - words.first[of]) * (BLOCK + 1) + many
            _, at, back, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
            known = count[back] > 1
            # any numbers do that spread the known places
            key = np.where(known, mixed(mixed(name, of.astype(np.uint64)), block.astype(np.uint64), 4), name)
            told = at[count > 1]  # one row for all places of a known anchor
            nobody = pa.nulls(len(told), pa.int64())
            columns = (
                pa.chunked_array([part.column(0).take(pa.array(of)), nobody]),
                pa.chunked_array([pa.array(block), nobody]),
                pa.chunked_array([pa.array(key.view(np.int64)), pa.array(name[told].view(np.int64))]),
                pa.chunked_array([pa.array(known + 1, pa.int32()), pa.array(np.full(len(told), 2), pa.int32())]),
            )
            yield from pa.table(columns, names=["doc_id", "block", "anchor", "many"]).combine_chunks().to_batches()

    return docs.mapInArrow(find, ANCHORS)


def shared_blocks(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, blocks: the blocks of each document whose anchors stand at several places."""
    places = F.sum("many").over(Window.partitionBy("anchor"))
    rows = anchors(docs, size).withColumn("places", places).where("places > 1 and block is not null")
    return rows.groupBy("doc_id").agg(F.collect_list("block").alias("blocks"))


def _windows(part: pa.RecordBatch, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of a batch's blocks, ascending, and their texts."""
    blocks = part.column(part.schema.get_field_index("blocks"))
    own = blocks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(blocks)), np.asarray(blocks.value_lengths().fill_null(0)))
    begin, many = words.first[of] + own // (BLOCK + 1), own % (BLOCK + 1)
    window = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
    # rows of one id have their blocks together: a shorter text has not all of them
    window = np.unique(window[window + size <= np.repeat((words.first + words.size)[of], many)])
    return window, words.text[window]


def windows(found: DataFrame, size: int) -> DataFrame:
    """doc_id, a, b: the windows of shared anchors of each document, once each."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in chunks(batches):
            words = words_of([r if b else b"" for r, b in zip(raws, part.column(2).is_valid().to_pylist())])
            window, of = _windows(part, words, size)
            a, b = window_hashes(words, window, size)
            at = _firsts(of, a, b)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[at])), pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64))], names=["doc_id", "a", "b"])

    return found.mapInArrow(find, "doc_id long, a long, b long")


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """The places at which each row of the columns stands first."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order[new]


def _among(own: tuple[np.ndarray, ...], known: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each row of own, of which no two are equal, is a row of known (likewise)."""
    columns = [np.concatenate([o, k]) for o, k in zip(own, known)]
    order = np.lexsort(columns[::-1])
    twice = np.ones(len(order), bool)
    twice[:1] = False
    for c in columns:
        twice[1:] &= c[order][1:] == c[order][:-1]
    either = twice.copy()
    either[:-1] |= twice[1:]
    found = np.zeros(len(order), bool)
    found[order] = either
    return found[: len(own[0])]


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(size: int, whole: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in chunks(batches):
            words = words_of(raws)
            window, of = _windows(part, words, size)
            a, b = window_hashes(words, window, size)
            # a window stays where its document is the first to have it, and has it for the first time
            firsts = part.column(3)
            first_of = np.repeat(np.arange(len(raws)), np.asarray(firsts.value_lengths().fill_null(0)))
            both = [firsts.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1)]
            stays = np.zeros(len(window), bool)
            at = _firsts(of, a, b)
            stays[at] = _among((of[at], a[at], b[at]), (first_of, *both))
            in_runs = follows(words, size)
            in_runs = in_runs[part.column(0).is_valid().to_numpy(zero_copy_only=False)[words.text[in_runs]]]
            gone = np.zeros(len(words.code) + 1, np.int64)
            for begin in (window[~stays], in_runs):
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + size, -1)
            gone = np.cumsum(gone)[:-1] > 0
            removed = np.bincount(words.text[gone], minlength=len(raws))
            out = []
            for d, raw in enumerate(raws):
                own = raw.split()
                if removed[d]:
                    begin = words.first[d]
                    own = [w for w, g in zip(own, gone[begin : begin + len(own)].tolist()) if not g]
                kept = b" ".join(own)
                out.append(kept.decode("utf-8", "replace") if whole else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.size, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text" if whole else "kept_sha256"])

    return find


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, whole: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (whole: kept_text instead)."""
    # without a needless alias, both uses of `texts` are one exchange
    own = docs.select(F.col(id) if id == "doc_id" else F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    known = own.where("doc_id is not null")
    by_doc = written(shared_blocks(known, size), "anchors")
    texts = known.join(by_doc, "doc_id", "left").select("doc_id", "raw", "blocks")
    first = windows(texts, size).groupBy("a", "b").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("firsts"))
    judged = texts.join(first, "doc_id", "left").select("doc_id", "raw", "blocks", "firsts")
    # null ids need no company, and must not meet in one task
    others = own.where("doc_id is null").select("doc_id", "raw", F.lit(None).cast("array<long>").alias("blocks"), F.lit(None).cast("array<struct<a:long,b:long>>").alias("firsts"))
    return judged.unionByName(others).mapInArrow(_kept(size, whole), RESULT.replace("kept_sha256", "kept_text") if whole else RESULT)
