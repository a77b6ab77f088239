import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaytally.llm import near_dedup
from quaytally.llm.common import dealt_join
from quaytally.llm.graph import components


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, t in rows:
        component = None if i is None else find(i)
        out.append((i, len(shingles(t)), component, i == component))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(small_documents):
    expected = brute([(r.doc_id, r.text) for r in small_documents.collect()])
    assert got(near_dedup.near_groups(small_documents)) == expected
    assert sum(not x[3] for x in expected) > 3
    kept = {r.doc_id for r in near_dedup.near_dedup(small_documents).collect()}
    assert kept == {x[0] for x in expected if x[3]}


def test_hard_rows(docs_frame, hard_rows):
    assert got(near_dedup.near_groups(docs_frame(hard_rows))) == brute(hard_rows)


def test_empty_table(docs_frame):
    assert got(near_dedup.near_groups(docs_frame([]))) == []


def test_groups_around_the_threshold(docs_frame):
    random.seed(5)
    rows = []
    for group in range(4):
        base = [f"w{group}_{i}" for i in range(80)]
        for _ in range(25):
            words = list(base)
            for _ in range(random.randrange(5)):
                words[random.randrange(80)] = f"e{random.randrange(10**6)}"
            rows.append((len(rows), " ".join(words[: random.choice([80, 80, 70, 62])])))
    assert got(near_dedup.near_groups(docs_frame(rows))) == brute(rows)


def test_prefix_join_loses_no_link(spark):
    random.seed(9)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for i in range(60):
        words = passage[: random.randrange(40, 61)] + [f"o{random.randrange(400)}" for _ in range(random.randrange(25))]
        rows.append((i, " ".join(words)))
    bodies = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in rows], "node long, raw binary")
    rest = spark.createDataFrame([(i, i) for i, _ in rows], "node long, component long")
    links = {tuple(sorted(r)) for r in near_dedup.verified(near_dedup._rest(rest, bodies), bodies).collect()}
    sets = [shingles(t) for _, t in rows]
    expected = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert links == expected and expected


def test_sketches_estimate_similarity():
    words = [f"w{i}" for i in range(400)]
    for changed in (0, 10, 40):
        other = [f"x{i}" if i < changed else w for i, w in enumerate(words)]
        elements, sizes = near_dedup.element_sets([" ".join(words).encode(), " ".join(other).encode()])
        state = near_dedup.sketch(elements, sizes, 2048)
        a, b = set(elements[: sizes[0]]), set(elements[sizes[0] :])
        assert abs((state[0] == state[1]).mean() - len(a & b) / len(a | b)) < 0.05
    elements, sizes = near_dedup.element_sets([b"a b c", b"a"])
    assert (near_dedup.sketch(elements, sizes, 64) != np.uint64(2**64 - 1)).all()


@pytest.mark.parametrize("edges", [[], [(5, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 9)] + [(20, 21), (21, 22), (30, 22)], [(1, 2), (2, 1), (1, 2)]])
def test_components(spark, edges):
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = {}
    for u, v in edges:
        if u != v:
            expected.setdefault(u, u), expected.setdefault(v, v)
    for _ in range(60):
        for u, v in edges:
            if u != v:
                expected[u] = expected[v] = min(expected[u], expected[v])
    assert found == expected


@pytest.mark.parametrize("total", [0, 10**7, 4000])
def test_hot_keys_are_dealt_without_loss(spark, total):
    many = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 40).alias("k"), "id")
    one = many.groupBy("k").agg(F.count(F.lit(1)).alias("__many")).withColumn("name", F.concat(F.lit("n"), "k")).where("k <> 3")
    found = dealt_join(many, one, ["k"], F.xxhash64("id"), total, least=1)
    assert found.columns == ["k", "id", "name"]
    assert sorted((r.id, r.name) for r in found.collect()) == sorted((i, f"n{k}") for i in range(3000) if (k := 7 if i < 1500 else i % 40) != 3)
