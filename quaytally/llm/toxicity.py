"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (lower-cased) is the sum of the embeddings of its hashed whole and hashed beginnings. Filters of
several widths slide over the words, from before the text's first word to behind its last, each filter
keeps its largest value (max pooling), and a logistic unit scores them. Only hashes that occur in enough training texts have an
embedding, all others are zero, so unknown words say nothing. At scoring time the filters are applied to the embedding table
once, and a text costs table look-ups and sums.

The score sees the text alone. Thresholds by language come from the held-in validation part and feed
the extra column `flagged` only.

Training uses a bounded sample of labelled rows (`per_class` rows a class, chosen by hash of the id, and
no more rows once they have `train_words` words), the whole text of each, pooled in pieces; the model is
broadcast, its size bounded by the sample.

Null and empty texts score as a text without known words. Long texts are whole, scored in overlapping
pieces whose maxima are the text's. A null id stays null (held_out false). Repeated rows score alike.
Without labels of both classes the score is 0 for all. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaytally.llm.common import CACHE_WORDS, TRAIN_WORDS, chunks, held_out, labelled_sample, whole_rows

WIDTHS, FILTERS, DIM, BEGINNINGS = (1, 2, 3), 8, 12, (4, 6)
PER_CLASS, LEAST_TEXTS, EPOCHS, BATCH, RATE, DECAY, DROPPED = 2000, 3, 5, 32, 0.01, 1e-4, 0.5
NO_ROWS = (0,) * (1 + len(BEGINNINGS))
WORD = re.compile(r"\w+")
PIECE_WORDS, TRAIN_PIECE = 1 << 16, 1 << 15


def features(word: str) -> list[int]:
    """The hashes of a word and of its beginnings."""
    return [zlib.crc32(f"{n}:{word[:n] if n else word}".encode()) for n in (0, *(n for n in BEGINNINGS if len(word) >= n))]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Model:
    rows: dict[int, int]  # hash -> row of the embedding
    embedding: np.ndarray  # row 0 is zero: unknown
    filters: list[np.ndarray]  # by width: (width, dim, filters)
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    thresholds: dict[str, float]

    def tables(self) -> list[list[np.ndarray]]:
        """By width and place in the filter: the filter's part of each embedding row."""
        return [[self.embedding @ f[j] for j in range(len(f))] for f in self.filters]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.tables = model.tables()
        self.numbers: dict[str, int] = {}
        self.sums: list[list[list[np.ndarray]]] = []
        self._clear()

    def _clear(self) -> None:
        self.numbers.clear()
        self.known: list[tuple[int, ...]] = [NO_ROWS]
        self.by_rows: dict[tuple[int, ...], int] = {NO_ROWS: 0}
        self.word_tables = [[np.zeros((1, FILTERS)) for _ in own] for own in self.tables]

    def number(self, word: str) -> int:
        """Words of the same embedding rows share a number; 0 has none."""
        rows = tuple(self.model.rows.get(h, 0) for h in features(word))
        rows += NO_ROWS[len(rows) :]
        found = self.by_rows.get(rows)
        if found is None:
            found = self.by_rows[rows] = len(self.known)
            self.known.append(rows)
        return found

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self.numbers) > CACHE_WORDS:
            self._clear()
        documents = [words_of(t) for t in texts]
        for w in set(chain.from_iterable(documents)) - self.numbers.keys():
            self.numbers[w] = self.number(w)
        if (n := len(self.word_tables[0][0])) < len(self.known):
            fresh = np.array(self.known[n:])
            self.word_tables = [[np.vstack([t, table[fresh].sum(1)]) for t, table in zip(own, whole)] for own, whole in zip(self.word_tables, self.tables)]
        return np.array([self.one(d) for d in documents])

    def one(self, words: list[str]) -> float:
        ids = padded(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        pooled = np.zeros(FILTERS * len(WIDTHS))  # a window without known words, as every text ends with one
        for begin in range(0, len(ids) - WIDEST + 1, PIECE_WORDS):
            part = ids[begin : begin + PIECE_WORDS + WIDEST - 1]
            starts = (np.flatnonzero(part)[:, None] - np.arange(WIDEST)).ravel()
            starts = np.unique(starts[(starts >= 0) & (starts <= len(part) - WIDEST)])
            if not starts.size:
                continue
            for k, own in enumerate(self.word_tables):
                value = sum(table[part[starts + j]] for j, table in enumerate(own))
                at = slice(k * FILTERS, (k + 1) * FILTERS)
                pooled[at] = np.maximum(pooled[at], value.max(0))
        pooled = np.maximum(pooled + self.model.bias, 0)
        return float(1 / (1 + np.exp(-(pooled @ self.model.weights + self.model.offset))))


WIDEST = max(WIDTHS)


def padded(ids: np.ndarray) -> np.ndarray:
    """Word ids (by row) with unknown words around them, so that a filter also meets the text's ends, and unknown words alone."""
    out = np.zeros((len(ids) + 2 * WIDEST - 1, *ids.shape[1:]), ids.dtype)
    out[WIDEST - 1 : WIDEST - 1 + len(ids)] = ids
    return out


class Network:
    """The classifier as it is trained: embedding rows, filters by width, bias, weights of the pooled values, offset."""

    def __init__(self, n_rows: int, rng: np.random.Generator):
        many = FILTERS * len(WIDTHS)
        self.p = {"e": rng.normal(0, 0.1, (n_rows, DIM)), "b": np.full(many, 0.1), "w": rng.normal(0, 0.5, many), "o": np.zeros(1)}
        self.p |= {f"f{w}": rng.normal(0, 0.5, (w * DIM, FILTERS)) for w in WIDTHS}
        self.p["e"][0] = 0

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of a padded text: where each filter's largest window starts, the pooled values, and the logit."""
        pooled, places = np.full(FILTERS * len(WIDTHS), -np.inf), np.zeros((len(WIDTHS), FILTERS), np.int64)
        for begin in range(0, len(ids) - WIDEST + 1, TRAIN_PIECE):
            vectors = self.p["e"][ids[begin : begin + TRAIN_PIECE + WIDEST - 1]].sum(1)
            n = len(vectors) - WIDEST + 1
            for k, w in enumerate(WIDTHS):
                windows = np.lib.stride_tricks.sliding_window_view(vectors, w, axis=0)[:n].transpose(0, 2, 1).reshape(n, w * DIM)
                value = windows @ self.p[f"f{w}"]
                best = value.argmax(0)
                most, own = value[best, np.arange(FILTERS)], pooled[k * FILTERS : (k + 1) * FILTERS]
                places[k] = np.where(most > own, best + begin, places[k])
                np.maximum(own, most, out=own)
        pooled += self.p["b"]
        return places, pooled, float(np.maximum(pooled, 0) @ self.p["w"] + self.p["o"][0])

    def gradients(self, ids: np.ndarray, places: np.ndarray, pooled: np.ndarray, delta: float) -> tuple[dict[str, np.ndarray], dict[int, np.ndarray]]:
        """For a logit whose derivative is delta: gradients of the dense parameters, and of the embedding rows met."""
        back = delta * self.p["w"] * (pooled > 0)
        grads = {"w": delta * np.maximum(pooled, 0), "o": np.full(1, delta), "b": back}
        touched: dict[int, np.ndarray] = {}
        for k, w in enumerate(WIDTHS):
            own = back[k * FILTERS : (k + 1) * FILTERS]
            grad = grads[f"f{w}"] = np.zeros_like(self.p[f"f{w}"])
            for f in np.flatnonzero(own):
                at = places[k][f]
                grad[:, f] = own[f] * self.p["e"][ids[at : at + w]].sum(1).ravel()
                shares = own[f] * self.p[f"f{w}"][:, f].reshape(w, DIM)
                for j in range(w):
                    for r in ids[at + j].tolist():
                        if r:
                            touched[r] = touched.get(r, 0) + shares[j]
        return grads, touched


def fit(samples: list[tuple[np.ndarray, int, str]], seed: int = 7) -> Model:
    """From (feature hashes by word, 0 for none, label, language) of each training text."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y, _ in samples], float)
    seen, texts = np.unique(np.concatenate([np.unique(words) for words, _, _ in samples]), return_counts=True)
    vocabulary = seen[(texts >= LEAST_TEXTS) & (seen > 0)]
    rows = {h: i + 1 for i, h in enumerate(vocabulary.tolist())}
    coded = []
    for words, _, _ in samples:
        own = np.zeros(words.shape, np.int32)
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            own = np.where(vocabulary[at] == words, at + 1, 0).astype(np.int32)
        coded.append(padded(own))
    network = Network(len(rows) + 1, rng)
    parameters = network.p
    dense = [k for k in parameters if k != "e"]
    first, second = ({k: np.zeros_like(v) for k, v in parameters.items()} for _ in range(2))
    validation = np.array([zlib.crc32(f"v{i}".encode()) % 8 == 0 for i in range(len(samples))])
    order, step = np.flatnonzero(~validation), 0
    balance = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))

    for _ in range(EPOCHS):
        rng.shuffle(order)
        for begin in range(0, len(order), BATCH):
            batch = order[begin : begin + BATCH]
            grads = {k: np.zeros_like(parameters[k]) for k in dense}
            touched: dict[int, np.ndarray] = {}
            for i in batch:
                # whole words go, so that a text is not known by one of them
                ids = np.where(rng.random((len(coded[i]), 1)) < DROPPED, 0, coded[i])
                places, pooled, logit = network.forward(ids)
                own, rows_met = network.gradients(ids, places, pooled, (1 / (1 + np.exp(-logit)) - labels[i]) * balance[i] / len(batch))
                for k in dense:
                    grads[k] += own[k]
                for r, g in rows_met.items():
                    touched[r] = touched.get(r, 0) + g
            step += 1
            scale = np.sqrt(1 - 0.999 ** min(step, 10**4)) / (1 - 0.9**step)
            for k in dense:
                g = grads[k] + DECAY * parameters[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                parameters[k] -= RATE * scale * first[k] / (np.sqrt(second[k]) + 1e-8)
            if touched:
                at = np.fromiter(touched, np.int64, len(touched))
                g = np.array(list(touched.values())) + DECAY * parameters["e"][at]
                second["e"][at] += g * g  # adaptive by row, as most rows are touched seldom
                parameters["e"][at] -= 0.1 * g / (np.sqrt(second["e"][at]) + 1e-8)
    model = Model(rows, parameters["e"], [parameters[f"f{w}"].reshape(w, DIM, FILTERS) for w in WIDTHS], parameters["b"], parameters["w"], 0.0, {})
    logits = np.array([network.forward(ids)[2] for ids in coded])
    held = validation if len(set(labels[validation])) == 2 else np.ones(len(samples), bool)
    # the score passes 0.5 where the validation texts are told apart best
    model.offset = float(parameters["o"][0] - best_cut(logits[held], labels[held]))
    shifted = logits - best_cut(logits[held], labels[held])
    for language in sorted({x for _, _, x in samples}):
        mine = held & np.array([x == language for _, _, x in samples])
        if mine.sum() >= 20 and len(set(labels[mine])) == 2:
            model.thresholds[language] = float(1 / (1 + np.exp(-best_cut(shifted[mine], labels[mine]))))
    return model


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest stretch of cuts with the largest balanced accuracy."""
    order = np.argsort(logits)
    x, y = logits[order], labels[order]
    right = (np.cumsum(1 - y)[:-1] / max(1, (1 - y).sum()) + (y.sum() - np.cumsum(y)[:-1]) / max(1, y.sum())) / 2
    right = np.where(x[1:] > x[:-1], right, -1)
    if not right.size or right.max() < 0:
        return 0.0
    best = np.flatnonzero(right >= right.max() - 1e-12)
    widest = best[np.argmax(x[best + 1] - x[best])]
    return float((x[widest] + x[widest + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, train_words: int = TRAIN_WORDS, id: str = "doc_id", text: str = "text") -> Model | None:
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in chunks(batches):
            documents = [words_of(r.decode("utf-8", "replace")) for r in raws]
            own = {w: struct.pack(f"<{len(NO_ROWS)}I", *(features(w) + [0, 0])[: len(NO_ROWS)]) for w in set(chain.from_iterable(documents))}
            hashes = pa.array([b"".join(map(own.__getitem__, d)) for d in documents], pa.binary())
            yield pa.RecordBatch.from_arrays([hashes, *part.columns[1:], pa.array([len(d) for d in documents], pa.int64())], names=["hashes", "label", "lang", "key", "words"])

    rows = whole_rows(labelled_sample(docs, labels, label, per_class, id, text).mapInArrow(coded, "hashes binary, label int, lang string, key long, words long"), per_class, train_words)
    rows.sort(key=lambda r: (zlib.crc32(r["hashes"]), r["hashes"], r["label"]))
    if len({r["label"] for r in rows}) < 2:
        return None
    return fit([(np.frombuffer(r["hashes"], "<u4").reshape(-1, len(NO_ROWS)), r["label"], r["lang"]) for r in rows])


SCORES = "doc_id long, score double"


def scored(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, flagged (by the language's own threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for part, raws in chunks(batches):
            found = scorer.of([r.decode("utf-8", "replace") for r in raws]) if scorer else np.zeros(len(raws))
            least = shared.value.thresholds if shared.value else {}
            flagged = [bool(s >= least.get(x, 0.5)) for s, x in zip(found, part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64()), pa.array(flagged, pa.bool_())], names=["doc_id", "score", "flagged"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col(id).alias("doc_id"), lang.alias("lang"), F.col(text).cast("binary").alias("raw"))
    rows = own.mapInArrow(score, "doc_id long, score double, flagged boolean")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text") -> DataFrame:
    return scored(docs, train(docs, labels, label, id=id, text=text), id, text)
