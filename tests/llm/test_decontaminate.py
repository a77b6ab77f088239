import hashlib
import random

import pytest

from quaytally.llm import decontaminate
from quaytally.llm.decontaminate import words_of_text as words_of


def brute(docs, items):
    out = []
    for key, text in docs:
        words = words_of((text or "").encode())
        hit, names = set(), set()
        for name, body in items:
            own = words_of((body or "").encode())
            n = min(10, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(words) - n + 1):
                if windows and tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names.add(str(name))
        out.append((key, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def bench(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string, n int")


def test_documents(spark, small_documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute([(r.doc_id, r.text) for r in small_documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(decontaminate.decontamination(small_documents, items)) == expected
    assert any(x[-1] for x in expected)


ITEMS = [
    (1, "One two three four five six seven", 0),
    (2, "b", 0),
    (3, None, 0),
    (4, "...", 0),
    (10, "w " * 25, 0),
    (11, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", 0),
    (12, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", 0),
    (13, "x y", 0),
]
DOCS = [
    (20, "w " * 40),
    (21, "ALPHA beta, gamma-delta epsilon zeta eta theta iota kappa nu"),
    (22, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu b"),
    (23, "y x y x, y"),
    (24, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (25, "B"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_windows_blocks_and_hard_rows(docs_frame, hard_rows, bench, block_bytes):
    docs = hard_rows + DOCS
    assert got(decontaminate.decontamination(docs_frame(docs), bench(ITEMS), block_bytes=block_bytes)) == brute(docs, [x[:2] for x in ITEMS])


def test_joined_form_on_documents(spark, small_documents):
    """A benchmark beyond the size that goes to every task."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one, other = (got(decontaminate.decontamination(small_documents, items, block_bytes=n)) for n in (1 << 20, 1))
    assert one == other and any(x[-1] for x in one)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_few_words_repeat_much(docs_frame, bench, block_bytes):
    random.seed(4)
    text = lambda n: " ".join(random.choice("abc") for _ in range(n))
    docs = [(i if i % 5 else None, text(random.randrange(60))) for i in range(40)]
    items = [(i, text(random.choice((1, 2, 3, 5, 9, 10, 11, 14)))) for i in range(40)]
    assert got(decontaminate.decontamination(docs_frame(docs), bench([(*x, 0) for x in items]), block_bytes=block_bytes)) == brute(docs, items)


def test_empty_tables(docs_frame, bench):
    assert got(decontaminate.decontamination(docs_frame([]), bench(ITEMS), block_bytes=1)) == []
    assert got(decontaminate.decontamination(docs_frame([]), bench(ITEMS))) == []
    assert got(decontaminate.decontamination(docs_frame(DOCS), bench([]))) == brute(DOCS, [])
