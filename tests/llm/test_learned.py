"""Classifiers and language model: held-out accuracy, gradients, states of the grammar, edge cases."""

import numpy as np
import pyarrow as pa
import pytest

from quillgauge.llm import pseudolikelihood as pl
from quillgauge.llm import quality, toxicity
from quillgauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def scored(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


def test_quality_on_held_out_documents(spark, labels):
    rows = scored(spark, "op2_quality")
    held = [(rows[i]["score"], labels[i]["quality"]) for i in labels if rows[i]["held_out"] and labels[i]["quality"] is not None]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert len(rows) == 1000 and np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows.values())


def test_toxicity_on_held_out_documents(spark, labels):
    rows = scored(spark, "op4_toxicity")
    held = [(rows[i]["predicted"], labels[i]["toxic"]) for i in labels if rows[i]["held_out"] and labels[i]["toxic"] is not None]
    assert np.mean([p == y for p, y in held]) > 0.93
    assert sum(p for p, y in held if not y) <= 2
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows.values())


def test_learning_does_not_see_held_out_labels(spark, documents, sf):
    from pyspark.sql import functions as F
    from quillgauge.llm.common import held_out, labelled_sample

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    sample = labelled_sample(documents, labels, "quality", 10**9)
    assert sample.filter(held_out()).count() == 0
    known = labels.filter(F.col("quality").isNotNull() & ~held_out()).count()
    assert sample.count() == known and labelled_sample(documents, labels, "quality", 20).count() < 60


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edge_cases(spark, edge, nothing, module):
    labels = spark.createDataFrame([(1, 1), (5, None), (None, 0)], "doc_id BIGINT, quality INT")
    model = module.fit(edge, labels, "quality")
    rows = module.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert set(edge.columns) == set(module.score(edge, model).columns)
    assert module.score(nothing, model).collect() == []


def test_grammar_states():
    lexicon = toxicity.Lexicon({"oaf": 2.0}, {"blath": 3.0})
    score = lambda clause: toxicity.clause_score([a for a in map(lexicon.arc, toxicity.LETTERS.findall(clause)) if a[0]])
    assert score("the oaf came") == 2.0 and score("blatherish") == 3.0 and score("blath") == 0.0
    assert score("you oaf") == score("oaf you") == 3.0
    assert score("not an oaf") < score("they said oaf") < score("you oaf")
    assert score("kill") == 0.0 and score("kill you") == 3.0 and score("quiet words") == 0.0


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    net = quality.learn(x, y)
    assert abs(net.probabilities(x).mean() - y.mean()) < 0.1 and net.temperature > 0
    assert quality.learn(x, np.ones(600)) is None


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    flat = pl.fresh().astype(np.float64)
    around, target = rng.integers(0, pl.TOKENS + 1, (6, 4)), rng.integers(0, pl.TOKENS, 6)
    loss = lambda f: -pl.log_probabilities(pl.views(f), around, target).mean()
    g = pl.gradient(pl.views(flat), around, target)
    for k in [int(np.argmax(np.abs(g))), *rng.choice(np.flatnonzero(g), 12)]:
        more, less = flat.copy(), flat.copy()
        more[k], less[k] = more[k] + 1e-4, less[k] - 1e-4
        assert abs((loss(more) - loss(less)) / 2e-4 - g[k]) < 1e-4


def test_probabilities_sum_to_one():
    p, around = pl.views(pl.fresh()), np.array([[3, 4, pl.PAD, 5]])
    logs = pl.log_probabilities(p, np.repeat(around, pl.TOKENS, 0), np.arange(pl.TOKENS))
    assert abs(np.exp(logs).sum() - 1) < 1e-3


def test_pseudo_likelihood(spark, edge, nothing):
    own = pl.vocabulary(edge)
    assert own[:2] == ["long", "word"]
    flat = pl.train(edge, own)
    rows = pl.score(edge, own, flat).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge.count() and by[2]["log_probability"] == 0 and by[2]["mean_log_probability"] is None
    ids, p = pl.token_ids(own), pl.views(flat)
    codes = [pl.PAD] * 2 + [ids[w] for w in "same text here today".split()] + [pl.PAD] * 2
    want = sum(float(pl.log_probabilities(p, np.array([[codes[k + o] for o in pl.OFFSETS]]), np.array([codes[k]]))[0]) for k in range(2, 6))
    assert abs(by[6]["log_probability"] - want) < 1e-3 and by[6]["n_tokens"] == 4
    assert by[5]["n_tokens"] == 60_000 and by[5]["mean_log_probability"] > -np.log(pl.TOKENS) + 0.5
    assert pl.pseudo_likelihood(nothing).collect() == []


def test_every_position_is_a_training_case():
    texts = ["one", "b a", None, "", "c d e f " * 30]
    made = np.concatenate(list(pl.cases([pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": texts})], list("abcdef"))))
    ids = pl.token_ids(list("abcdef"))
    want = []
    for text in texts:
        codes = [pl.PAD] * pl.SIDE + [ids[w] for w in pl.words_of(text)] + [pl.PAD] * pl.SIDE
        want += [[*(codes[k + o] for o in pl.OFFSETS), codes[k]] for k in range(pl.SIDE, len(codes) - pl.SIDE)]
    assert len(want) == 123 and sorted(made.tolist()) == sorted(want)
