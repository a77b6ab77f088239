"""Held-out accuracy and hard rows of the two classifiers, and the pipeline's stages."""

import zlib

import numpy as np
import pytest

from quaytally.llm import decontaminate, exact_dedup, near_dedup, quality, toxicity

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity.toxicity, "toxic", 0.8), (quality.quality, "quality", 0.95)])
def test_held_out_rows_are_told_apart(tables, module, label, least):
    docs, labels = tables
    scores = {r.doc_id: r for r in module(docs, labels).collect()}
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 and r.held_out == held_out(i) for i, r in scores.items())
    pairs = [(scores[r.doc_id].score, r[label]) for r in labels.collect() if held_out(r.doc_id)]
    assert auc(pairs) >= least


@pytest.mark.parametrize(("module", "cut"), [(toxicity.toxicity, 0.5), (quality.quality, 0.3)])
def test_hard_rows(tables, docs_frame, hard_rows, module, cut):
    docs, labels = tables
    columns = ["doc_id", "text", "lang"]
    some = docs.select(*columns).where("doc_id >= 100").unionByName(docs_frame([(i, t) for i, t in hard_rows]).select(*columns))
    found = [r for r in module(some, labels).collect() if r.doc_id is None or r.doc_id < 100]
    assert len(found) == len(hard_rows) and all(r.predicted == int(r.score >= cut) for r in found)
    assert [r.held_out for r in found if r.doc_id is None] == [False, False]
    empty = docs.limit(0)
    assert module(empty, labels).count() == 0
    assert len({r.score for r in module(docs_frame([(1, "a"), (2, None)]), labels.limit(0)).collect()}) == 1


@pytest.mark.parametrize("module", [toxicity, quality])
def test_score_needs_neither_id_nor_language_and_is_reproducible(tables, module):
    from pyspark.sql import functions as F

    docs, labels = tables
    a = {r.doc_id: r.score for r in module.scored(docs, module.train(docs, labels)).collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")}).repartition(5)
    b = {r.doc_id: r.score for r in module.scored(other, module.train(docs.repartition(3), labels.repartition(2))).collect()}
    assert a == b


def small_network(n_rows=12):
    network = toxicity.Network(n_rows, np.random.default_rng(3))
    network.p["e"] *= 5
    network.p["e"][0] = 0
    return network


def test_network_gradients_are_those_of_the_loss():
    network, rng = small_network(), np.random.default_rng(4)
    ids = toxicity.padded(rng.integers(0, 12, (9, 3)).astype(np.int32))
    loss = lambda: float(np.log1p(np.exp(-network.forward(ids)[2])))
    places, pooled, logit = network.forward(ids)
    grads, touched = network.gradients(ids, places, pooled, 1 / (1 + np.exp(-logit)) - 1)
    embedding = np.zeros_like(network.p["e"])
    for r, g in touched.items():
        embedding[r] = g
    for name, grad in (grads | {"e": embedding}).items():
        flat = network.p[name].ravel()
        for i in rng.choice(flat.size, min(40, flat.size), replace=False):
            if name == "e" and i < toxicity.DIM:
                continue  # unknown words stay zero
            old, values = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                values.append(loss())
            flat[i] = old
            assert abs((values[0] - values[1]) / 2e-5 - grad.ravel()[i]) < 1e-5, (name, i)


@pytest.mark.parametrize("piece", [4, 1 << 16])
def test_scorer_is_the_network(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE_WORDS", piece)
    monkeypatch.setattr(toxicity, "TRAIN_PIECE", piece)
    words = [f"word{i}" for i in range(6)]
    hashes = sorted({h for w in words for h in toxicity.features(w)})
    network = small_network(len(hashes) + 1)
    p = network.p
    rows = {h: i + 1 for i, h in enumerate(hashes)}
    model = toxicity.Model(rows, p["e"], [p[f"f{w}"].reshape(w, toxicity.DIM, toxicity.FILTERS) for w in toxicity.WIDTHS], p["b"], p["w"], float(p["o"][0]), {})
    rng = np.random.default_rng(5)
    texts = ["", "none", *(" ".join(rng.choice([*words, "x", "y", "z"], n)) for n in (1, 2, 3, 5, 9, 40, 80))]
    expected = []
    for text in texts:
        ids = np.array([(*(rows.get(h, 0) for h in toxicity.features(w)), 0, 0)[:3] for w in toxicity.words_of(text)], np.int32).reshape(-1, 3)
        vectors = np.vstack([np.zeros((2, toxicity.DIM)), p["e"][ids].sum(1), np.zeros((3, toxicity.DIM))])
        pooled = np.concatenate([np.max([vectors[i : i + w].ravel() @ p[f"f{w}"] for i in range(len(ids) + 3)], axis=0) for w in toxicity.WIDTHS])
        logit = float(np.maximum(pooled + p["b"], 0) @ p["w"] + p["o"][0])
        assert abs(network.forward(toxicity.padded(ids))[2] - logit) < 1e-9
        expected.append(1 / (1 + np.exp(-logit)))
    assert np.allclose(toxicity.Scorer(model).of(texts), expected, atol=1e-12)


def test_attention_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(6)
    p, many, labels = quality.start(rng), np.array([1, 3, 2, 5]), np.array([1.0, 0.0, 1.0, 0.0])
    x = rng.normal(0, 1, (many.sum(), quality.WIDTH))

    def loss():
        score = quality.forward(p, x, many)[0]
        return float(-(labels * np.log(score) + (1 - labels) * np.log(1 - score)).mean())

    for name, grad in quality.gradients(p, x, many, labels).items():
        flat = p[name].ravel()
        for i in rng.choice(flat.size, min(30, flat.size), replace=False):
            old, values = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                values.append(loss())
            flat[i] = old
            assert abs((values[0] - values[1]) / 2e-5 - grad.ravel()[i]) < 1e-6, (name, i)


def test_pipeline_stages(spark, tables):
    import corpus_pipeline as pipeline

    docs, labels = tables
    assert [f.__name__ for _, f in pipeline.STAGES] == ["good_documents", "distinct_documents", "different_documents", "clean_documents", "packed_documents"]
    model = quality.train(docs, labels)
    good = {r.doc_id for r in quality.scored(docs, model).collect() if r.predicted}
    kept = pipeline.good_documents(spark, docs, SMALL)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good
    sample = docs.where("doc_id < 200")
    for stage, decide in ((pipeline.distinct_documents, lambda d: exact_dedup.exact_groups(d).where("kept")), (pipeline.different_documents, lambda d: near_dedup.near_groups(d).where("kept")), (pipeline.clean_documents, lambda d: decontaminate.decontamination(d, spark.read.parquet(f"{SMALL}/benchmark.parquet")).where("not contaminated"))):
        out = stage(spark, sample, SMALL)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in decide(sample).collect())


@pytest.fixture(scope="module")
def late(spark):
    """Long documents whose marks all stand at the very end."""
    ids = [i for i in range(400) if not held_out(i)]
    filler = [f"w{i % 97}" for i in range(6000)]
    word = lambda i: "zorgulent" if i % 2 else "plaintiful"
    docs = spark.createDataFrame([(i, " ".join([*filler[i:], *([word(i)] * 130)]), "en") for i in ids], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in ids], "doc_id long, toxic int, quality int")
    return docs, labels


def test_toxic_words_after_a_long_beginning_are_learnt(late):
    docs, labels = late
    model = toxicity.train(docs, labels)
    assert all(h in model.rows for w in ("zorgulent", "plaintiful") for h in toxicity.features(w))
    found = [(r.score, r.doc_id % 2) for r in toxicity.scored(docs, model).collect()]
    assert auc(found) == 1


def test_bad_passages_after_a_long_beginning_are_learnt(late):
    from pyspark.sql import functions as F

    docs, labels = late
    docs = docs.withColumn("text", F.regexp_replace("text", "zorgulent", "#!#!"))
    assert auc([(r.score, 1 - r.doc_id % 2) for r in quality.quality(docs, labels).collect()]) == 1


def test_rare_words_of_a_large_sample_have_embeddings():
    samples = [(np.array([[1, 2, 3], [9 if i < 3 else 8 if i < 5 else 7, 0, 0]], np.uint32), i % 2, "") for i in range(1000)]
    assert {8, 9} & set(toxicity.fit([s if i != 4 else samples[5] for i, s in enumerate(samples)]).rows) == {9}


def test_sample_has_fewer_rows_not_shorter_ones(spark):
    from quaytally.llm.common import whole_rows

    coded = spark.createDataFrame([(k, y, w) for y in (0, 1) for k, w in ((10 * y + 1, 40), (10 * y + 2, 500), (10 * y + 2, 500), (10 * y + 3, 1))], "key long, label int, words long")
    assert sorted((r["key"], r["words"]) for r in whole_rows(coded, 10, 100)) == [(1, 40), (2, 500), (11, 40), (12, 500)]
    assert sorted(r["key"] for r in whole_rows(coded, 1, 100)) == [1, 11]
