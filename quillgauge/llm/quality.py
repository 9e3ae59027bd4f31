"""Quality classifier: random-indexing word vectors, a two-layer network, a temperature.

Every word has a fixed sparse index vector of +1 and -1, made from its hash. A word's context
vector is the sum of the index vectors around it over the learning texts; added to its own
index vector and scaled to length 1 it is the word's vector. A document is the mean vector of
its words and runs of symbols, next to the mean vector of the shapes of its words (capital,
upper case, digits, symbols, length), whose vectors are index vectors too, and the shares of
repeated and of different words. Both layers of the
network are learned with numpy on the driver, from a sample of `bound` labelled documents at
most; the word vectors come from the texts of that sample, summed by the tasks that read them. A
fifth of the sample sets the temperature that calibrates the probabilities.

Scoring reads every whole text in its own row: no shuffle. Null and empty texts get the score of
a document without words. Repeated rows are scored alike. Without labels of both kinds the score
is 0.5. Other columns of the input are kept; clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgauge.llm.common import PARTIALS, labelled_sample, partial_rows, slices, summed, with_field
from quillgauge.llm.tokens import PIECES, WordIds, bucket
from quillgauge.operators.scale import durable

SAMPLE_ROWS = 8_000
BUCKETS, WIDTH, NONZERO, AROUND = 1 << 15, 48, 6, 2
SHAPES = 12
FEATURES = 2 * WIDTH + 4
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 0.01, 1e-4
THRESHOLD = 0.3
CHUNK = 1 << 16


def index_vectors(rows: int, width: int = WIDTH, seed: int = 5) -> np.ndarray:
    """Sparse vectors of +1 and -1, the same wherever they are made."""
    rng = np.random.default_rng(seed)
    made = np.zeros((rows, width), np.float32)
    places = np.argsort(rng.random((rows, width), np.float32), axis=1)[:, :NONZERO]
    np.put_along_axis(made, places, rng.choice(np.array([-1, 1], np.float32), (rows, NONZERO)), axis=1)
    return made


def shape(word: str) -> int:
    """Class of a word's form: symbols, digits, upper case, capital, mixed or small by length."""
    if not (word[0].isalnum() or word[0] == "_"):
        return min(len(word), 3) - 1
    if any(c.isdigit() for c in word):
        return 3
    if len(word) > 1 and word.isupper():
        return 4
    if word[0].isupper():
        return 5 if word[1:].islower() or len(word) == 1 else 6
    return 7 + min(len(word) // 4, 4)


def coded() -> WordIds:
    """Bucket and shape of a word in one number."""
    return WordIds(lambda w: bucket(w.lower(), BUCKETS) * SHAPES + shape(w))


def codes_of(text: str | None, ids: WordIds) -> np.ndarray:
    return ids.of(PIECES.findall(text or ""))


def context_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index vectors of each word's neighbours, summed over one task's texts."""
    index, ids, total = index_vectors(BUCKETS), coded(), np.zeros((BUCKETS, WIDTH), np.float32)
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            words = codes_of(text, ids) // SHAPES
            for start in range(0, len(words), CHUNK):
                piece = words[start : start + CHUNK]
                near = np.zeros((len(piece), WIDTH), np.float32)
                for gap in range(1, min(AROUND, len(piece) - 1) + 1):
                    near[gap:] += index[piece[:-gap]]
                    near[:-gap] += index[piece[gap:]]
                order = np.argsort(piece, kind="stable")
                firsts = np.flatnonzero(np.diff(piece[order], prepend=-1))
                if len(firsts):
                    total[piece[order][firsts]] += np.add.reduceat(near[order], firsts, axis=0)
    from pyspark import TaskContext

    yield from partial_rows(total, TaskContext.get().partitionId())


def scaled(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-6)


def pooled(texts: list[str | None], vectors: np.ndarray, shapes: np.ndarray, ids: WordIds) -> np.ndarray:
    """Mean word and shape vector of each text, its repeats and the logarithm of its length."""
    made = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in enumerate(texts):
        codes = codes_of(text, ids)
        if not len(codes):
            continue
        for start in range(0, len(codes), CHUNK):
            made[row, :WIDTH] += vectors[codes[start : start + CHUNK] // SHAPES].sum(0)
        made[row, WIDTH : 2 * WIDTH] = np.bincount(codes % SHAPES, minlength=SHAPES) @ shapes
        made[row, : 2 * WIDTH] /= len(codes)
        same = np.count_nonzero(codes[1:] == codes[:-1]) / len(codes)
        made[row, 2 * WIDTH :] = np.log1p(len(codes)), same, np.sqrt(same), len(np.unique(codes)) / len(codes)
    return made


@dataclass(frozen=True)
class Network:
    """Two layers over standardised inputs; the output is divided by the temperature."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1)
        return (hidden @ self.w2 + self.b2) / self.temperature

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def learn(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network | None:
    """Adam on log loss; None without both labels. A fifth of the rows sets the temperature."""
    if len(y) < 10 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    kept = max(len(y) // 5, 1)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    z, zy = (x[kept:] - mean) / spread, y[kept:]
    p = {
        "w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(()),
    }
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(zy)), max(len(zy) // 64, 1)):
            step += 1
            inputs = z[rows]
            hidden = np.tanh(inputs @ p["w1"] + p["b1"])
            off = (1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"], -40, 40))) - zy[rows]) / len(rows)
            back = np.outer(off, p["w2"]) * (1 - hidden**2)
            grads = {"w1": inputs.T @ back, "b1": back.sum(0), "w2": hidden.T @ off, "b2": off.sum()}
            for k, g in grads.items():
                g = g + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, spread, p["w1"], p["b1"], p["w2"], float(p["b2"]))
    logits = net.logits(x[:kept])
    best = min(np.geomspace(0.25, 8, 61), key=lambda t: loss(logits / t, y[:kept]))
    return Network(mean, spread, p["w1"], p["b1"], p["w2"], float(p["b2"]), float(best))


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    shapes: np.ndarray
    network: Network | None

    def scores(self, texts: list[str | None], ids: WordIds) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        return self.network.probabilities(pooled(texts, self.vectors, self.shapes, ids))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE_ROWS) -> Model:
    """Learn from `bound` labelled rows at most; features, not texts, come to the driver."""
    sample = durable(labelled_sample(docs, labels, label, bound))
    sums = summed(sample.select("text").mapInArrow(context_sums, PARTIALS), (BUCKETS, WIDTH))
    vectors = scaled(scaled(sums) + scaled(index_vectors(BUCKETS))).astype(np.float32)
    shapes = scaled(index_vectors(SHAPES, seed=6)).astype(np.float32)
    sent = sample.sparkSession.sparkContext.broadcast((vectors, shapes))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = coded()
        for batch in slices(batches):
            made = pooled(batch.column("text").to_pylist(), *sent.value, ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in made], pa.binary())], ["doc_id", "label", "x"])

    rows = sorted(sample.mapInArrow(features, "doc_id BIGINT, label INT, x BINARY").collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float32).reshape(-1, FEATURES)
    return Model(vectors, shapes, learn(x, np.array([r["label"] for r in rows])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` with `score`: the probability of label 1."""
    kept = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = coded()
        for batch in slices(batches):
            made = sent.value.scores(batch.column("text").to_pylist(), ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], [*batch.schema.names, "score"])

    return kept.mapInArrow(run, with_field(kept, "score", T.DoubleType()))


def predicted(threshold: float = THRESHOLD):
    return (F.col("score") >= threshold).cast("int")
