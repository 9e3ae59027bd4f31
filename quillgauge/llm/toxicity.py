"""Toxicity by a weighted finite-state pattern grammar over the words of a clause.

Five transducers read a clause word by word. The insult and threat transducers accept words of a
lexicon and stems of it (a prefix acceptor) and put out a weight; the target transducer marks
that a person is spoken to or about; the negation and the reported-speech transducer put their
state on for the words that follow in the clause. Their composition is one machine whose state is
(target seen, negated, reported): the weight of a match is scaled by the state it is read in, and
a clause scores the sum of its matches, so a word counts for what its clause says. `GRAMMAR`
names the seeds of each class; weights of words and stems are log odds learned from labelled
documents, so lexicons of other languages need no lists.

What is learned: candidate words and stems come from toxic learning documents and must stand
behind at least MIN_CONTEXTS different words there (copies of one document share their contexts and
so count once); clean learning documents then say how often each occurs without cause. A logistic
model over a document's clause scores gives the probability. The sample of labelled documents is
bounded by `bound`. Scoring reads each whole text in its own row: no shuffle.

Null and empty texts have no clause and get the score of a document without matches. Without
labels of both kinds the score is 0. Repeated rows score alike. Other columns of the input are
kept; a clashing `score` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgauge.llm.common import labelled_sample, slices, with_field
from quillgauge.llm.tokens import WordIds
from quillgauge.operators.scale import durable

SAMPLE_ROWS = 12_000
MIN_CONTEXTS, MIN_ODDS, STEMS = 5, 3.0, (4, 5, 6)
THRESHOLD = 0.5

# Seeds of the grammar's classes (English; learned entries add other languages).
GRAMMAR = {
    "target": frozenset("you your yours yourself he him his she her hers they them their we us people man woman".split()),
    "negation": frozenset("not no never neither nor none nobody without isn't aren't wasn't don't doesn't didn't cannot can't".split()),
    "reported": frozenset("said says say called calls claimed claims quoted quote wrote allegedly reportedly according told".split()),
    "threat": frozenset("kill hurt destroy beat burn shoot stab hang".split()),
}
THREAT_WEIGHT = 2.0
INSULT, THREAT, TARGET, NEGATION, REPORTED = 1, 2, 4, 8, 16
# What a match weighs in a state: with a target near, after a negation, in reported speech.
WITH_TARGET, WHEN_NEGATED, WHEN_REPORTED = 1.5, 0.4, 0.6

CLAUSES = re.compile(r"[.!?;:\n]+")
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass(frozen=True)
class Lexicon:
    """Weights of words and stems; a word takes the larger of its own and its stems'."""

    words: dict[str, float]
    stems: dict[str, float]

    def arc(self, word: str) -> tuple[int, float]:
        """Classes that accept a word, as bits, and the weight it puts out."""
        kinds = 0
        if word in GRAMMAR["target"]:
            kinds |= TARGET
        if word in GRAMMAR["negation"]:
            kinds |= NEGATION
        if word in GRAMMAR["reported"]:
            kinds |= REPORTED
        weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n)])
        if weight > 0:
            return kinds | INSULT, weight
        if word in GRAMMAR["threat"]:
            return kinds | THREAT, THREAT_WEIGHT
        return kinds, 0.0


def clause_score(arcs: Iterable[tuple[int, float]]) -> float:
    """Weight of the best path of the composed machine through one clause's marked words.

    A target counts for the whole clause, whether it comes first or last; a threat needs one.
    """
    target = negated = reported = False
    plain = threats = 0.0
    for kinds, weight in arcs:
        target |= bool(kinds & TARGET)
        negated |= bool(kinds & NEGATION)
        reported |= bool(kinds & REPORTED)
        scale = (WHEN_NEGATED if negated else 1.0) * (WHEN_REPORTED if reported else 1.0)
        if kinds & INSULT:
            plain += weight * scale
        elif kinds & THREAT:
            threats += weight * scale
    return (plain + threats) * WITH_TARGET if target else plain


def document_features(text: str | None, arcs: WordIds) -> tuple[float, float, float]:
    """Largest clause score, logarithm of their sum and number of clauses that match."""
    scores = []
    for clause in CLAUSES.split((text or "").lower()):
        marked = [a for a in map(arcs.__getitem__, LETTERS.findall(clause)) if a[0]]
        if marked:
            score = clause_score(marked)
            if score > 0:
                scores.append(score)
    if not scores:
        return 0.0, 0.0, 0.0
    return min(max(scores), 30.0), float(np.log1p(sum(scores))), float(np.log1p(len(scores)))


def parts_of(word: str) -> list[str]:
    """A word and its stems; stems end in a hyphen."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def toxic_contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (part, word before) pairs of one task's toxic documents."""
    for batch in slices(batches):
        seen = set()
        for text in batch.column("text").to_pylist():
            words = LETTERS.findall((text or "").lower())
            for before, word in zip(["", *words], words, strict=False):
                seen.update((part, before) for part in parts_of(word))
        pairs = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], ["part", "before"])


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that toxic documents have in many contexts and clean ones hardly ever."""
    pairs = sample.filter("label = 1").select("text").mapInArrow(toxic_contexts, "part STRING, before STRING").distinct()
    common = pairs.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_CONTEXTS)
    # Bounded by the sample: a part needs MIN_CONTEXTS places in its toxic texts.
    candidates = sorted(r["part"] for r in common.collect())
    if not candidates:
        return Lexicon({}, {})
    sent = sample.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def documents_with(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = sent.value, {0: Counter(), 1: Counter()}
        for batch in slices(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(LETTERS.findall((text or "").lower()))
                counts[label].update({p for w in words for p in parts_of(w) if p in wanted} | {""})
        rows = [(p, k, n) for k, counter in counts.items() for p, n in counter.items()]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([r[0] for r in rows], pa.string()), "label": pa.array([r[1] for r in rows], pa.int32()),
            "n": pa.array([r[2] for r in rows], pa.int64()),
        })

    counted = sample.select("text", "label").mapInArrow(documents_with, "part STRING, label INT, n BIGINT").groupBy("part", "label").agg(F.sum("n").alias("n"))
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in counted.collect():
        counts[r["part"]][r["label"]] = r["n"]
    clean, toxic = counts.pop("", [0, 0])
    words, stems = {}, {}
    for part, (in_clean, in_toxic) in sorted(counts.items()):
        odds = float(np.log((in_toxic + 0.25) / (in_clean + 0.25) * (clean + 1) / (toxic + 1)))
        if odds >= MIN_ODDS and in_toxic >= MIN_CONTEXTS:
            (stems if part.endswith("-") else words)[part.rstrip("-")] = odds
    return Lexicon(words, stems)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method; weights below zero are set to zero and fitted again."""
    used = list(range(x.shape[1]))
    while True:
        z = np.column_stack([x[:, used], np.ones(len(x))])
        w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * len(used) + [1e-9])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (p * (1 - p))[:, None]).T @ z / len(z) + penalty + 1e-9 * np.eye(z.shape[1])
            w = w - np.linalg.solve(hessian, z.T @ (p - y) / len(z) + penalty @ w)
        below = [k for k, value in zip(used, w[:-1], strict=True) if value < 0]
        if not below:
            weights = np.zeros(x.shape[1])
            weights[used] = w[:-1]
            return weights, float(w[-1])
        used = [k for k in used if k not in below]


def features_of(model_lexicon, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    arcs = WordIds(model_lexicon.arc)
    for batch in slices(batches):
        yield batch, np.array([document_features(t, arcs) for t in batch.column("text").to_pylist()]).reshape(-1, 3)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and weights from `bound` labelled rows at most."""
    sample = durable(labelled_sample(docs, labels, label, bound))
    lexicon = learn_lexicon(sample)
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in features_of(sent.value, batches):
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(c) for c in made.T)], ["label", "a", "b", "c"])

    rows = sorted(map(tuple, sample.mapInArrow(run, "label INT, a DOUBLE, b DOUBLE, c DOUBLE").collect()))
    if len({r[0] for r in rows}) < 2:
        return Model(lexicon, np.zeros(3), -40.0)
    data = np.array(rows, float)
    return Model(lexicon, *logistic(data[:, 1:], data[:, 0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` with `score`: the probability of being toxic."""
    kept = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in features_of(sent.value.lexicon, batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.probability(made), pa.float64())], [*batch.schema.names, "score"])

    return kept.mapInArrow(run, with_field(kept, "score", T.DoubleType()))


def predicted(threshold: float = THRESHOLD):
    return (F.col("score") >= threshold).cast("int")
