"""Quality: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of PASSAGE words. A passage is encoded by the shares of its words' shapes
(runs of capitals, letters, digits and signs, hashed to buckets), its mean word length, the share of
different words and the share of words that repeat their predecessor. A tanh layer and gated attention,
tanh(V h) * sigmoid(U h), weigh the passages; a logistic unit scores their weighted sum. All weights
are learnt in numpy from the texts' labels alone. Words are looked up in a cache by task; passages of
many texts are encoded and weighed at once.

Training uses a bounded sample of labelled rows (`per_class` rows a class, chosen by hash of the id, and
no more rows once they have `train_words` words), all passages of each; the model has a fixed size.

Null and empty texts are one empty passage. Long texts are whole. A null id stays null (held_out
false). Repeated rows score alike. Without labels of both classes the score is 1 for all, so that
nothing is rejected. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaytally.llm.common import TRAIN_WORDS, WordCodes, chunks, hash64, held_out, labelled_sample, whole_rows

PASSAGE, BUCKETS, HIDDEN, ATTENTION = 64, 64, 16, 8
PER_CLASS, STEPS, RATE, DECAY = 1500, 150, 0.04, 1e-3
REJECT_BELOW = 0.3
WIDTH = BUCKETS + 4

SHAPE_BYTES = bytes(0x41 if chr(i).isascii() and chr(i).isupper() else 0x30 if chr(i).isascii() and chr(i).isdigit() else 0x61 if i >= 0x80 or chr(i).isalpha() else i for i in range(256))
RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def word_code(word: bytes) -> int:
    """48 bits of hash, 8 of length, 8 of shape."""
    shape = RUNS.sub(rb"\1+", word.translate(SHAPE_BYTES))
    return (hash64(word) & ((1 << 48) - 1)) << 16 | min(255, len(word)) << 8 | zlib.crc32(shape) % BUCKETS


def passages(raws: list[bytes], codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Passage encodings of all texts, and how many each text has (one at least)."""
    codes.trim()
    documents = [r.split() for r in raws]
    sizes = np.array([len(d) for d in documents], np.int64)
    many = np.maximum(1, -(-sizes // PASSAGE))
    code = np.fromiter(map(codes.__getitem__, chain.from_iterable(documents)), np.uint64, int(sizes.sum()))
    within = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    of = np.repeat(np.cumsum(many) - many, sizes) + within // PASSAGE
    n = int(many.sum())
    words = np.bincount(of, minlength=n)
    share = np.maximum(1, words)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :BUCKETS] = np.bincount(of * BUCKETS + (code & np.uint64(255)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS) / share[:, None]
    out[:, BUCKETS] = np.bincount(of, (code >> np.uint64(8) & np.uint64(255)).astype(float), n) / share / 16
    if len(code):
        order = np.lexsort((code, of))
        new = np.ones(len(code), bool)
        new[1:] = (code[order][1:] != code[order][:-1]) | (of[order][1:] != of[order][:-1])
        out[:, BUCKETS + 1] = np.bincount(of[order], new, n) / share
        same = np.zeros(len(code))
        same[1:] = (code[1:] == code[:-1]) & (of[1:] == of[:-1])
        out[:, BUCKETS + 2] = np.bincount(of, same, n) / share
    out[:, BUCKETS + 3] = np.minimum(words, PASSAGE) / PASSAGE
    return out, many


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {
        "h": rng.normal(0, 0.3, (WIDTH, HIDDEN)), "hb": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "u": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "a": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "cb": np.zeros(1),
    }


def forward(p: dict[str, np.ndarray], x: np.ndarray, many: np.ndarray):
    """Scores by text, and what the gradients need."""
    first = np.cumsum(many) - many
    of = np.repeat(np.arange(len(many)), many)
    h = np.tanh((x - p.get("mean", 0)) / p.get("std", 1) @ p["h"] + p["hb"])
    tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    logit = (tv * su) @ p["a"]
    weight = np.exp(logit - np.maximum.reduceat(logit, first)[of])
    weight /= np.add.reduceat(weight, first)[of]
    bag = np.add.reduceat(h * weight[:, None], first)
    score = 1 / (1 + np.exp(-np.clip(bag @ p["c"] + p["cb"], -30, 30)))
    return score, (first, of, h, tv, su, weight, bag)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, many: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy, by the parameters."""
    score, (first, of, h, tv, su, weight, bag) = forward(p, x, many)
    d = (score - labels) / len(labels)
    db = (d[:, None] * p["c"])[of]
    own = (db * h).sum(1)
    dl = weight * (own - np.add.reduceat(weight * own, first)[of])
    dt, ds = dl[:, None] * p["a"] * su * (1 - tv * tv), dl[:, None] * p["a"] * tv * su * (1 - su)
    dh = (db * weight[:, None] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
    return {"c": bag.T @ d, "cb": d.sum(keepdims=True), "a": (tv * su).T @ dl, "v": h.T @ dt, "u": h.T @ ds, "h": x.T @ dh, "hb": dh.sum(0)}


def fit(x: np.ndarray, many: np.ndarray, labels: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    p = start(np.random.default_rng(seed))
    scale = {"mean": x.mean(0), "std": x.std(0) + 0.02}
    x = (x - scale["mean"]) / scale["std"]
    first_moment, second_moment = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        g = gradients(p, x, many, labels)
        for k in p:
            grad = g[k] + DECAY * p[k] / 10
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * grad
            second_moment[k] = 0.999 * second_moment[k] + 0.001 * grad * grad
            p[k] = p[k] - RATE * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
    return p | scale


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, train_words: int = TRAIN_WORDS, id: str = "doc_id", text: str = "text") -> dict[str, np.ndarray] | None:
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(word_code)
        for part, raws in chunks(batches):
            x, many = passages(raws, codes)
            bags = [b.tobytes() for b in np.split(x, np.cumsum(many)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), part.column(1), part.column(2), pa.array(many * PASSAGE, pa.int64())], names=["bag", "label", "key", "words"])

    rows = whole_rows(labelled_sample(docs, labels, label, per_class, id, text).select("raw", "label", "key").mapInArrow(coded, "bag binary, label int, key long, words long"), per_class, train_words)
    rows.sort(key=lambda r: (zlib.crc32(r["bag"]), r["bag"], r["label"]))
    y = np.array([r["label"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in rows]
    found = fit(np.concatenate(bags).astype(float), np.array([len(b) for b in bags]), y)
    # the sample's balance is not the corpus's: the offset moves to the labels' own balance
    share = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg(F.col(label).cast("double"))).first()[0]
    share, own = (min(0.99, max(0.01, v)) for v in (share, y.mean()))
    found["cb"] = found["cb"] + np.log(share / (1 - share)) - np.log(own / (1 - own))
    return found


def scored(docs: DataFrame, model: dict[str, np.ndarray] | None, id: str = "doc_id", text: str = "text", least: float = REJECT_BELOW) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from `least` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(word_code)
        for part, raws in chunks(batches):
            found = forward(shared.value, *passages(raws, codes))[0] if shared.value else np.ones(len(raws))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(float), pa.float64())], names=["doc_id", "score"])

    own = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    rows = own.mapInArrow(score, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text") -> DataFrame:
    return scored(docs, train(docs, labels, label, id=id, text=text), id, text)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", least: float = REJECT_BELOW) -> DataFrame:
    """The rows of docs whose text scores `least` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, text=text))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(word_code)
        for part, raws in chunks(batches, text):
            found = forward(shared.value, *passages(raws, codes))[0] if shared.value else np.ones(len(raws))
            yield part.filter(pa.array(found >= least))

    return docs.mapInArrow(choose, docs.schema)
