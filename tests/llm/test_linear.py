"""Whitening, exact top-k and the Merkle manifest against plain versions and edge cases."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgauge.llm import merkle, topk, whitening

EMBEDDINGS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("n", T.StringType()), T.StructField("score", T.StringType()), T.StructField("__x", T.StringType()),
])


def _vectors(rows=120, d=10, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((rows, d)) * np.linspace(3, 0.5, d)
    return [(i, [float(v) for v in base[i]]) for i in range(rows)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], EMBEDDINGS)


def _x(v):
    return np.floor(np.array(v, dtype=np.float64) * 256).astype(np.int64)


def test_whitening_equals_dense_eigen_decomposition(spark):
    rows = _vectors() + [(500, _vectors()[0][1]), (501, None), (502, [1.0, float("nan")] + [0.0] * 8), (503, [None] * 10)]
    out = whitening.whiten(_frame(spark, rows)).toPandas()
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    X = np.array([_x(v) for _, v in kept], dtype=np.float64)
    fit = np.unique(X, axis=0)
    n, S = len(fit), fit.sum(axis=0)
    V = (fit - S / n).T @ (fit - S / n) / n
    e, U = np.linalg.eigh(V)
    order = np.argsort(-e)
    e, U = e[order], U[:, order]
    assert set(out.vec_id) == {i for i, _ in kept} and len(out) == 4 * len(kept)
    assert (out.n == n).all()
    for c in range(1, 5):
        part = out[out.component == c].set_index("vec_id").loc[[i for i, _ in kept]]
        assert abs(part.explained.iloc[0] - e[c - 1] / np.trace(V)) <= 1e-12
        ref = (X - S / n) @ U[:, c - 1] / np.sqrt(e[c - 1])
        assert min(np.abs(part.whitened.values - ref).max(), np.abs(part.whitened.values + ref).max()) < 1e-9
        assert list(part.deviation) == [int(((n * x - S) ** 2).sum()) for x in X.astype(np.int64)]
    assert out.identity_error.iloc[0] <= 1e-4


def test_whitening_edges(spark, ):
    assert whitening.whiten(_frame(spark, [])).count() == 0
    assert whitening.whiten(_frame(spark, [(1, None), (2, [float("inf")])])).count() == 0
    one = whitening.whiten(_frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    # One distinct vector: n = 1, no variance, so nothing to whiten or explain.
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in one)
    short = whitening.whiten(_frame(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, []), (4, [0.0, -1.0, 2.0])])).collect()
    assert {r.component for r in short} == {1, 2, 3} and all(r.n == 4 for r in short)


def test_jacobi_davidson_on_clustered_spectrum():
    rng = np.random.default_rng(1)
    Q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    values = np.concatenate([[10.0, 10.0 - 1e-6, 9.9, 9.8], np.linspace(9.7, 0, 36)])
    V = (Q * values) @ Q.T
    got, vecs, worst = whitening.jacobi_davidson(lambda Y: V @ Y, 40, 4)
    assert np.allclose(got, values[:4], rtol=0, atol=1e-10)
    assert np.abs(V @ vecs - vecs * got).max() < 1e-10 and worst <= 1e-10


def _brute_topk(rows, k=5):
    kept = [(i, _x(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(x) for _, x in kept), default=0)
    pad = [(i, np.pad(x, (0, d - len(x)))) for i, x in kept]
    out = set()
    for qid, qx in {(i, tuple(x)) for i, x in pad if i is not None and i % 50 == 0}:
        scored = sorted(((-int(np.dot(qx, x)), i is None, i if i is not None else 0) for i, x in pad if i != qid))
        out |= {(qid, r + 1, None if isnull else i, -s) for r, (s, isnull, i) in enumerate(scored[:k])}
    return out


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rows = [(i * 10, v) for i, v in _vectors(rows=150, d=19)]
    rows += [(7, rows[0][1]), (None, rows[5][1]), (3, None), (11, [float("nan")] * 19), (13, rows[5][1][:7])]
    rows += [(2000, rows[1][1]), (2050, rows[1][1]), (2100, [0.0] * 19)]
    got = {tuple(r) for r in topk.top_k(_frame(spark, rows)).collect()}
    assert got == _brute_topk(rows)


def test_topk_edges(spark):
    assert topk.top_k(_frame(spark, [])).count() == 0
    assert topk.top_k(_frame(spark, [(50, [1.0])])).count() == 0
    few = topk.top_k(_frame(spark, [(50, [1.0]), (1, [1.0]), (2, [1.0])])).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(few, key=lambda r: r.rank)] == [(1, 1, 65536), (2, 2, 65536)]


def test_branch_and_bound_prunes_but_stays_exact():
    rng = np.random.default_rng(5)
    cands = np.floor(rng.standard_normal((3000, 64)) * 256).astype(np.int64)
    q = cands[17] * 3
    edges = list(range(0, 64, topk.DIMENSION_BLOCK)) + [64]
    rest = np.stack([np.sqrt((cands[:, e:].astype(float) ** 2).sum(1)) for e in edges[1:]])
    q_rest = np.array([math.sqrt(float((q[e:].astype(float) ** 2).sum())) for e in edges[1:]])
    ids = np.arange(3000, dtype=np.int64)
    pos, scores, scored = topk.best(q, q_rest, -1, ids, np.zeros(3000, bool), np.ascontiguousarray(cands.T), rest)
    full = cands @ q
    assert list(scores) == sorted(full, reverse=True)[:5] and scored < 3000


def _H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _brute_manifest(rows):
    def leaf(r, text):
        return _H("".join(_field(v) for v in (r[0], r[3], r[2], r[4], text)))

    def tamper(r):
        if r[0] is None or r[1] is None or zlib.crc32(str(r[0]).encode()) % 3:
            return r[1]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])

    def build(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            cur = levels[-1]
            levels.append([_H("".join(cur[i:i + 8])) for i in range(0, len(cur), 8)])
        return levels

    def proof(levels, i):
        out = []
        for lv in levels[:-1]:
            out.append((lv[i // 8 * 8:i // 8 * 8 + 8], i % 8))
            i //= 8
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(r, r[1]), leaf(r, tamper(r))))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda t: (t[0][0] is not None, t[0][0] or 0, t[1]))
        trees[g] = build([t[1] for t in groups[g]])
    top = build([trees[g][-1][0] for g in langs])
    out = []
    for gi, g in enumerate(langs):
        for i, (r, lf, tl) in enumerate(groups[g]):
            pr = proof(trees[g], i) + proof(top, gi)
            acc = tl
            for run, idx in pr:
                acc = _H("".join(acc if j == idx else d for j, d in enumerate(run)))
            sib = "".join(d for run, idx in pr for j, d in enumerate(run) if j != idx)
            out.append((r[0], lf, trees[g][-1][0], top[-1][0], _H(sib), acc, acc == top[-1][0]))
    return sorted(out, key=str)


MANIFEST = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("leaf", T.StringType()),
])


@pytest.mark.parametrize("top_rows", [merkle.TOP_ROWS, 0])
def test_manifest_equals_brute_force(spark, monkeypatch, top_rows):
    monkeypatch.setattr(merkle, "TOP_ROWS", top_rows)
    rows = [(i, f"Text Number {i} ABC" * (i % 4), ["en", "de", None, "ü"][i % 4], ["web", None][i % 2], i * 3, "x") for i in range(150)]
    rows += [(3, "Same", "en", "web", 1, "x"), (3, "Same", "en", "web", 1, "x"), (None, "No Id", "en", None, None, "x"),
             (7, None, "fr", "web", 0, "x"), (9, "", "solo", None, 0, "x"), (12, "LONG " * 20000, "de", "web", 1, "x")]
    got = merkle.manifest(spark.createDataFrame(rows, MANIFEST)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute_manifest(rows)
    assert not all(r.verified for r in got) and any(r.verified for r in got)


def test_manifest_edges(spark):
    assert merkle.manifest(spark.createDataFrame([], MANIFEST)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(5, "A", "en", "s", 1, "x")], MANIFEST)).collect()[0]
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == _H("")


def test_topk_never_broadcasts_its_copied_queries(spark, monkeypatch):
    # A query block is small to Spark's estimate, but is written once for each candidate block.
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 4)
    found = topk.top_k(_frame(spark, [(i, [float(i % 7), 1.0]) for i in range(200)]))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
