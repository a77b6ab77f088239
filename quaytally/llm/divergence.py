"""How far the sources of a language diverge in their use of terms, by Gustavson row accumulation.

A language keeps the V terms that stand in at least `least` of its documents. A group (language, source) with
`count` occurrences of a kept term, N of all kept terms, has p = 1 + floor(10^9 (count + 2) / (N + 2 V)) there, also
where count is 0. Two groups diverge by the sum of f(p, q) = floor((p - q)^2 / (p + q)) over all kept terms.

1. Tasks count occurrences and documents by group and term; sums by (language, source, term) combine them.
2. The kept cells of a language are cut into blocks by a hash of the term, each with some CELLS cells, so neither
   a large source nor a frequent term nor a large language is ever in one task as a whole.
3. A block holds its cells by group and, as term-major index, by term. Each group scatters its terms through
   that index into a dense accumulator with a place for each peer: no pair of postings is ever a row. Only the
   places that are not zero leave the block, at most one a pair of groups.
4. Most pairs (group, term) are zeros, whose p is the group's baseline. The accumulator starts from what all
   terms would give if both groups had their baselines, takes each own term against the peers' baselines
   and each peer's term against the own baseline, by distinct values of p, and the scatter corrects terms that both have.

All arithmetic is in whole numbers. Nulls in text, language or source count as ''; a group without terms is a
group. Empty and very long texts are like any other; a repeated row is a document of its own. A language
without kept terms gives 0 for all its pairs. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaytally.llm.common import chunks, few, written

LEAST_DOCUMENTS, RANKS, SCALE = 10, 10, 10**9
#: Cells (group, term) of a block, and cells a source that it has at least, so that few blocks report a pair.
CELLS, CELLS_A_SOURCE = 1 << 16, 64
#: Terms of a task before its counts are handed on, bytes of a text that are cut into words at once.
HELD, SLICE = 1 << 20, 4 << 20

#: A-Z lower-cased; what is no letter of ASCII and no other character becomes a space.
TERM_BYTES = bytes(ord(c.lower()) if (c := chr(i)).isascii() and c.isalpha() else (i if i >= 0x80 else 0x20) for i in range(256))


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice of it at a time."""
    begin = 0
    while begin < len(raw):
        end = begin + SLICE
        while end < len(raw) and TERM_BYTES[raw[end]] != 0x20:
            end += 1
        yield raw[begin:end].translate(TERM_BYTES).split()
        begin = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, raw) to occurrences n and documents by (lang, source, term); each group also has a row without term."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in found.items():
            terms = [*n]
            size = len(terms) + 1
            columns = [[lang] * size, [source] * size, [None, *terms], [0, *n.values()], [0, *map(documents.__getitem__, terms)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], names=["lang", "source", "term", "n", "documents"])
        found.clear()

    for part, raws in chunks(batches):
        for lang, source, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raws):
            n, documents = found.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for terms in terms_of(raw):
                n.update(terms)
                own.update(terms)
            documents.update(own)
        if sum(len(n) for n, _ in found.values()) > HELD:
            yield from flushed()
    yield from flushed()


def cells_of(docs: DataFrame, least: int, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n of kept terms; one row with a null term a group; `first` marks one row a (lang, term)."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]
    rows = docs.select(*named, F.col(text).cast("binary").alias("raw")).mapInArrow(counted, "lang string, source string, term binary, n long, documents long")
    sums = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    same = Window.partitionBy("lang", "term")
    told = sums.withColumn("all", F.sum("documents").over(same)).withColumn("first", F.min("source").over(same) == F.col("source"))
    return told.where(F.col("term").isNull() | (F.col("all") >= least)).select("lang", "source", "term", "n", "first")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + 2) / total), three decimal places at a time, which stays within 64 bits."""
    total = np.maximum(total, 1)
    whole, left = np.divmod(count + 2, total)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Block:
    """The cells of some terms of a language, by group and by term."""

    def __init__(self, peer: np.ndarray, term: np.ndarray, n: np.ndarray, totals: np.ndarray, kept: int):
        """peer and term of each cell as numbers, its count; N of each group; V."""
        self.zero, self.kept = share(np.zeros(len(totals), np.int64), totals + 2 * kept), kept
        order = np.argsort(term, kind="stable")  # the term-major index
        self.peer, self.term = peer[order], term[order]
        self.p = share(n[order], (totals + 2 * kept)[self.peer])
        self.begin = np.searchsorted(self.term, np.arange(self.term.max(initial=-1) + 2))
        self.by_peer = np.argsort(self.peer, kind="stable")
        self.own = np.searchsorted(self.peer[self.by_peer], np.arange(len(totals) + 1))
        # the distinct p of each group, and how many terms have it
        pairs, self.times = np.unique(np.stack([self.peer, self.p]), axis=1, return_counts=True)
        self.value_peer, self.value = pairs.astype(np.int64)
        self.values = np.searchsorted(self.value_peer, np.arange(len(totals) + 1))

    def row(self, a: int, with_base: bool) -> np.ndarray:
        """What the block adds to the divergence of group a from each group; with_base: and what no term changes."""
        zero, own = self.zero, self.zero[a]
        base = apart(own, zero)
        total = self.kept * base if with_base else np.zeros(len(zero), np.int64)
        mine = slice(self.values[a], self.values[a + 1])
        for p, times in zip(self.value[mine], self.times[mine]):  # own terms, as if no peer had them
            total = total + times * (apart(p, zero) - base)
        np.add.at(total, self.value_peer, self.times * (apart(own, self.value) - base[self.value_peer]))  # peers' terms, as if a had none
        cells = self.by_peer[self.own[a] : self.own[a + 1]]
        begin, many = self.begin[self.term[cells]], np.diff(self.begin)[self.term[cells]]
        posting = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        p, q, peer = np.repeat(self.p[cells], many), self.p[posting], self.peer[posting]
        np.add.at(total, peer, apart(p, q) - apart(p, zero[peer]) - apart(own, q) + base[peer])  # terms of both
        return total

    def typical(self, n: np.ndarray, term: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, term and value of the cells where p exceeds the language's q; n, term: the counts of all cells."""
        sums = np.zeros(self.term.max(initial=-1) + 1, np.int64)
        np.add.at(sums, term, n)
        q = share(sums, np.array(total + 2 * self.kept))[self.term]
        some = self.p > q
        return self.peer[some], self.term[some], apart(self.p[some], q[some])


REPORT = "lang string, part string, source binary, item binary, value long"


def _report(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """What a block (lang, block) adds: part `pair` of two groups (each once), part `term` with its RANKS best of each group."""
    groups = groups.sort_by("source")
    names = groups["source"].combine_chunks()
    lang, block, kept = (groups[c][0].as_py() for c in ("lang", "block", "kept"))
    totals = groups["total"].to_numpy()
    peer = pc.index_in(cells["source"], value_set=names).to_numpy().astype(np.int64)
    words = pa.chunked_array(cells["term"].chunks, pa.binary()).combine_chunks().dictionary_encode()
    term, n = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), cells["n"].to_numpy()
    made = Block(peer, term, n, totals, kept)
    lefts, rights, values = [], [], []
    for a in range(len(names) - 1):
        row = made.row(a, block == 0)[a + 1 :]
        other = np.flatnonzero(row) if block else np.arange(len(row))
        lefts.append(np.full(len(other), a))
        rights.append(other + a + 1)
        values.append(row[other])
    parts = [("pair", names, names, *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (lefts, rights, values)))]
    own, which, value = made.typical(n, term, int(sum(totals.tolist())))
    vocabulary = words.dictionary.to_pylist()
    rank = np.zeros(len(vocabulary), np.int64)
    rank[sorted(range(len(vocabulary)), key=vocabulary.__getitem__)] = np.arange(len(vocabulary))
    order = np.lexsort((rank[which], -value, own))
    place = np.arange(len(order)) - np.searchsorted(own[order], own[order])
    best = order[place < RANKS]
    parts.append(("term", names, words.dictionary, own[best], which[best], value[best]))
    tables = []
    for part, left, right, a, b, v in parts:
        columns = [pa.array([lang] * len(a), pa.string()), pa.array([part] * len(a), pa.string()), left.take(pa.array(a)).cast(pa.binary()), right.take(pa.array(b)).cast(pa.binary()), pa.array(v, pa.int64())]
        tables.append(pa.Table.from_arrays(columns, names=["lang", "part", "source", "item", "value"]))
    return pa.concat_tables(tables)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, cells_a_block: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: each group's divergence from the other sources of its language (part
    `pair`, all ranks), and the terms it has more often than its language (part `term`, RANKS of them)."""
    cells = written(cells_of(docs, least, text, lang, source), "cells")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("cells"), F.count_if(F.col("term").isNotNull() & F.col("first")).alias("terms"))
    sizes = written(sizes, "groups")
    # a language's number of blocks follows from its cells; a block of many sources is larger
    room = F.greatest(F.lit(cells_a_block), CELLS_A_SOURCE * F.count(F.lit(1)))
    languages = sizes.groupBy("lang").agg(F.sum("terms").alias("kept"), F.greatest(F.lit(1), F.ceil(F.sum("cells") / room)).alias("blocks"))
    languages = written(languages, "languages")
    groups = sizes.join(languages, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "kept")
    own = cells.where(F.col("term").isNotNull()).select("lang", "source", "term", "n")
    placed = own.join(few(languages.select("lang", "blocks")), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), F.col("source").cast("binary").alias("source"), "term", "n")
    groups = groups.withColumn("source", F.col("source").cast("binary"))
    found = placed.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInArrow(_report, REPORT)
    found = written(found, "report")
    pairs = found.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (both, found.where("part = 'term'").select(both.columns))]
    rows = ranked[0].unionByName(ranked[1].where(F.col("rank") <= RANKS))
    return rows.select("lang", F.col("source").cast("string").alias("source"), "part", F.col("item").cast("string").alias("item"), "value", "rank")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY lang, source, term),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM groups g JOIN kept k ON k.lang = g.lang
         LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(c) AS n FROM grid GROUP BY lang, source),
shares AS (SELECT g.lang, g.source, g.term, g.c, 1 + (1000000000::HUGEINT * (g.c + 2)) // (t.n + 2 * v.v)::HUGEINT AS p
           FROM grid g JOIN totals t USING (lang, source) JOIN vs v USING (lang)),
whole AS (SELECT lang, term, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS n FROM grid GROUP BY lang, term),
langs AS (SELECT w.lang, w.term, 1 + (1000000000::HUGEINT * (w.c + 2)::HUGEINT) // (w.n + 2 * v.v)::HUGEINT AS q FROM whole w JOIN vs v USING (lang)),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
             FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL) s
    ON s.lang = g.lang AND s.source = g.source AND s.other = h.source),
terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, (s.p - l.q) * (s.p - l.q) // (s.p + l.q) AS value
  FROM shares s JOIN langs l USING (lang, term) WHERE s.c > 0 AND s.p > l.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
