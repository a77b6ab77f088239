import hashlib
import random

import numpy as np
import pytest

from quaytally.llm import substring_dedup
from quaytally.llm.words import words_of


def brute(rows, size=20):
    words = [((t or "").encode().split(), i) for i, t in rows]
    earliest = {}
    for own, i in words:
        if i is not None:
            for s in range(len(own) - size + 1):
                key = tuple(own[s : s + size])
                earliest[key] = min(earliest.get(key, (i, s)), (i, s))
    out = []
    for own, i in words:
        gone = set()
        for s in range(len(own) - size + 1):
            if i is not None and earliest[tuple(own[s : s + size])] < (i, s):
                gone.update(range(s, s + size))
        kept = b" ".join(w for j, w in enumerate(own) if j not in gone)
        out.append((i, len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(small_documents):
    expected = brute([(r.doc_id, r.text) for r in small_documents.collect()])
    assert got(substring_dedup.substring_dedup(small_documents)) == expected
    assert sum(x[2] for x in expected) > 1000


def test_hard_rows(docs_frame, hard_rows):
    rows = [*hard_rows, (20, "a b " * 25), (21, "x " * 19 + "y " * 21), (22, "y " * 25), (23, "b a " * 11)]
    assert got(substring_dedup.substring_dedup(docs_frame(rows))) == brute(rows)


def test_empty_table(docs_frame):
    assert got(substring_dedup.substring_dedup(docs_frame([]))) == []


def test_few_words_repeat_much(docs_frame):
    random.seed(3)
    base = [random.choice("abcd") for _ in range(400)]
    rows = []
    for i in range(60):
        at, n = random.randrange(380), random.randrange(5, 60)
        own = [random.choice("ab") for _ in range(random.randrange(30))] + base[at : at + n] + [random.choice("abc") for _ in range(random.randrange(30))]
        rows.append((i, " ".join(own)))
    assert got(substring_dedup.substring_dedup(docs_frame(rows))) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 5, 12, 20, 33, 50, 100])
def test_equal_windows_have_equal_anchors(size):
    random.seed(size)
    for letters in ("ab", "abcdef", "aaaaaaab"):
        for _ in range(40):
            window = [random.choice(letters).encode() for _ in range(size)]
            seen = set()
            for _ in range(6):
                before, after = ([random.choice(letters).encode() for _ in range(random.randrange(12))] for _ in "xy")
                words = words_of([b" ".join(before + window + after), b"a b"])
                first, many, name = substring_dedup.anchored(words, size)
                own = np.flatnonzero((first <= len(before)) & (len(before) < first + many))
                if len(before) in substring_dedup.follows(words, size):
                    assert not own.size
                else:
                    assert own.size == 1
                    seen.add(int(name[own[0]]))
            assert len(seen) <= 1


@pytest.mark.parametrize("size", [3, 12, 50])
def test_other_sizes(docs_frame, size):
    random.seed(size)
    base = [random.choice("abcdefgh") for _ in range(600)]
    rows = []
    for i in range(40):
        at, n = random.randrange(500), random.randrange(2 * size)
        rows.append((i, " ".join([random.choice("ab") for _ in range(9)] + base[at : at + n] + ["x"] * random.randrange(2 * size) + [random.choice("abc") for _ in range(9)])))
    assert got(substring_dedup.substring_dedup(docs_frame(rows), size=size)) == brute(rows, size)


def test_rows_of_one_id_and_null_ids(docs_frame):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (3, text), (None, text), (None, text), (4, "b " + text), (None, "y " * 50)]
    assert got(substring_dedup.substring_dedup(docs_frame(rows))) == brute(rows)
    short = [(3, text), (3, "w0 w1"), (4, text)]
    found = got(substring_dedup.substring_dedup(docs_frame(short)))
    assert [r[:3] for r in found] == [(3, 2, 0), (3, 60, 0), (4, 60, 60)]


def test_words():
    random.seed(2)
    texts = ["".join(random.choice("ab \t\n\x0b\r\u00e9\u3000-") for _ in range(random.randrange(200))).encode() for _ in range(60)] + [b"x" * 200, b"y" * 64 + b" " + b"y" * 65, b""]
    words = words_of(texts)
    expected = [t.split() for t in texts]
    assert words.size.tolist() == [len(x) for x in expected]
    flat = [w for x in expected for w in x]
    assert [words.joined[a:b] for a, b in zip(words.start, words.end)] == flat
    assert len(set(words.code.tolist())) == len(set(flat)) == len(set(zip(flat, words.code.tolist())))
