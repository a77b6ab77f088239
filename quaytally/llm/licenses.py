"""License scan: one Aho-Corasick pass over the words of a text, and a parser of licence expressions.

Words are maximal runs of ASCII letters and digits (lower-cased) and of other letters. The automaton
holds notice phrases and the identifier tag; where a tag stands, the expression after it is read from
the raw text by a shunting-yard parser ("and", "or", "with", brackets; "with" binds closest, then
"and") and evaluated to the labels of its licences and to a score.

score: 1 for a tag whose expression is well formed (with a licence unknown to us: 0.9; the worse of
the sides of "and", the better of "or"), 0.8 for a notice phrase, 0.4 for a malformed expression, 0
for none; the largest counts.

Null and empty texts have no words and no labels (first_word, last_word null, score 0). Texts of any
length are scanned whole. Repeated rows give repeated results, a null id stays null, an empty table
gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaytally.llm.common import chunks, texts

# The phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices; they add labels only.
MORE = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "bsd license": "bsd", "isc license": "isc", "boost software license": "bsl", "the unlicense": "unlicense", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "creative commons attribution": "cc-by", "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd", "dedicated to the public domain": "public-domain",
}
TAG = "spdx license identifier"
#: Beginnings of licence identifiers and their labels; the longest that fits counts.
FAMILIES = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc", "bsl": "bsl", "unlicense": "unlicense",
    "cc0": "public-domain", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nc-nd": "cc-by-nc-nd",
}
SURE, UNKNOWN, NOTICE, MALFORMED = 1.0, 0.9, 0.8, 0.4
BINDS = {"or": 1, "and": 2, "with": 3}
TAGGED = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\n\r]*)", re.IGNORECASE | re.ASCII)
PART = re.compile(r"[()]|[A-Za-z0-9.+-]+")

#: A-Z lower-cased; what is not part of a word becomes a space.
WORD_BYTES = bytes(ord(c.lower()) if (c := chr(i)).isascii() and c.isalnum() else (i if i >= 0x80 else 0x20) for i in range(256))


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in (*BASE, *MORE, TAG):
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def postfix(expression: str) -> list[str] | None:
    """Shunting yard: the expression's operands and operators in postfix order; None if malformed.

    The expression ends where no operator follows an operand, as prose may follow it."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # an operand stands before
    for part in PART.findall(expression):
        low = part.lower()
        if part == "(":
            if operand:
                break
            held.append(part)
        elif part == ")":
            if "(" not in held:
                break
            if not operand:
                return None
            while (top := held.pop()) != "(":
                out.append(top)
        elif low in BINDS:
            if not operand:
                return None
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = False
        elif operand:
            break
        else:
            out.append(part.rstrip("."))
            operand = True
    if not operand or "(" in held:
        return None
    return out + held[::-1]


def label_of(identifier: str) -> str | None:
    low = identifier.lower()
    fits = [f for f in FAMILIES if low == f or low.startswith(f"{f}-") or low == f"{f}+"]
    return FAMILIES[max(fits, key=len)] if fits else None


def evaluated(expression: str) -> tuple[set[str], float]:
    """The labels and the score of a licence expression."""
    parts = postfix(expression)
    if not parts:
        return set(), MALFORMED
    stack: list[tuple[set[str], float]] = []
    for part in parts:
        if part in BINDS:
            (right, r), (left, s) = stack.pop(), stack.pop()
            # an exception after "with" changes a licence's terms, not its label
            stack.append((left, s) if part == "with" else (left | right, min(r, s) if part == "and" else max(r, s)))
        else:
            label = label_of(part)
            stack.append(({label}, SURE) if label else (set(), UNKNOWN))
    return stack[0]


def scanned(raw: bytes, finder: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = raw.translate(WORD_BYTES).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    score, tagged = 0.0, False
    at, count = 0, -1  # words before `at`, counted once along the line
    for end, phrase in finder.iter(line):
        if phrase == TAG:
            tagged = True
            continue
        score = max(score, NOTICE)
        if phrase in BASE:
            begin = end - len(phrase) - 1
            if begin < at:
                at, count = 0, -1
            count += line.count(" ", at, begin + 1)
            at = begin + 1
            starts.append(count)
            base.add(BASE[phrase])
        labels.add(BASE.get(phrase) or MORE[phrase])
    if tagged:
        for m in TAGGED.finditer(raw.decode("utf-8", "replace")):
            found, sure = evaluated(m[1])
            labels |= found
            score = max(score, sure)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())


def license_scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its words, the places of the base phrases, labels and score."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        for part, raws in chunks(batches):
            rows = [scanned(raw, finder) for raw in raws]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), TYPES))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return texts(docs, F.col(id).alias("doc_id"), text=text).mapInArrow(scan, SCHEMA)
