"""Whitening of embeddings: leading eigenvectors of the covariance by Jacobi-Davidson.

The covariance V of the fit list is never formed. Every product V·Y with a block Y of at most
a few vectors is one Spark job over the fit list: each task multiplies its centred rows twice
(X_c^T (X_c Y)) and emits its partial d×b sums, which a grouped sum adds up. On the driver only
d-sized things live: the search basis, its products, the small projected matrix.

The method: a search basis Q orthogonal to the locked eigenvectors; Rayleigh-Ritz on Q^T V Q gives
the Ritz pairs (θ, u) with residuals r = V u − θ u. The leading Ritz pair whose residual is below
TOLERANCE times the largest Ritz value is locked, in order of falling θ. For each of the other
wanted pairs the correction equation (I − Z Z^T)(V − θ I)(I − Z Z^T) t = −r, Z = [locked, u], is
solved by MINRES; the inner solvers of all wanted pairs run in lockstep, so one inner step is one
Spark job for the whole block. The corrections, made orthogonal, widen Q; the basis restarts from
the best Ritz vectors when it grows beyond MAX_BASIS.

Defined results:
  * rows whose vector is null or holds a null, NaN or infinite entry are dropped; all other rows,
    repeated ones too, get a result. Shorter vectors count as zeros in the dimensions they lack
    (d is the longest length); an empty vector is all zeros.
  * the fit list holds each distinct x-vector once (x = floor(256·c) as long). n = its size.
  * components: min(4, d). A component whose eigenvalue is not above zero (n = 1, all rows equal,
    rank below 4) has whitened NULL and is left out of identity_error; explained is NULL when the
    trace is zero. With equal eigenvalues any orthonormal basis of their space may come out.
  * signs: each eigenvector's entry of largest magnitude is positive, so reruns agree.
  * an empty table (or no remaining row) gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.operators.scale import ensure_checkpoint_dir

SCALE = 256
COMPONENTS = 4
# A Ritz pair is locked when its residual norm is below this share of the largest Ritz value:
# near the rounding of a distributed double sum of centred products.
TOLERANCE = 1e-12
INNER_STEPS = 3
INNER_REDUCTION = 1e-2
MAX_BASIS = 24
# Ritz pairs beyond the wanted ones that also get a correction: a wider gap to what is not wanted.
BUFFER = 4
MAX_OUTER = 200
SEED = 20261202


def finite(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a whole, finite vector, and their integer vector x."""
    v = F.col(vector)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(0).cast("long"))
    return embeddings.filter(v.isNotNull() & whole).withColumn("__x", x)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list<int64> Arrow column as a float matrix of d columns, short rows padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    lengths = np.diff(offsets)
    values = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.float64)[offsets[0]:offsets[-1]]
    if len(lengths) and (lengths == d).all():
        return values.reshape(-1, d)
    out = np.zeros((len(lengths), d))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


class CentredProducts:
    """V·Y for blocks Y, each one Spark job over the written fit list."""

    def __init__(self, fit: DataFrame, n: int, sums: np.ndarray) -> None:
        self.fit, self.n, self.d = fit, n, len(sums)
        self.mean = sums / n
        self.jobs = 0

    def __call__(self, block: np.ndarray) -> np.ndarray:
        d, mean = self.d, self.mean
        block = np.ascontiguousarray(block, dtype=np.float64).reshape(d, -1)
        b = block.shape[1]

        def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, b))
            for batch in batches:
                if batch.num_rows:
                    centred = _matrix(batch.column(0), d) - mean
                    total += centred.T @ (centred @ block)
            yield pa.RecordBatch.from_pydict({"j": pa.array(np.arange(d * b), pa.int32()), "v": pa.array(total.ravel())})

        rows = self.fit.mapInArrow(partial, "j INT, v DOUBLE").groupBy("j").agg(F.sum("v").alias("v")).collect()
        self.jobs += 1
        out = np.zeros(d * b)
        for row in rows:
            out[row["j"]] = row["v"]
        return out.reshape(d, b) / self.n


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of `new` made orthogonal to `against` and to each other; those that vanish go."""
    kept: list[np.ndarray] = []
    for column in new.T:
        scale = np.linalg.norm(column)
        if scale == 0:
            continue
        v = column / scale
        for _ in range(2):
            for basis in (against, np.array(kept).T if kept else np.zeros((len(v), 0))):
                v = v - basis @ (basis.T @ v)
        norm = np.linalg.norm(v)
        if norm > 1e-8:
            kept.append(v / norm)
    return np.array(kept).T if kept else np.zeros((new.shape[0], 0))


def _minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, shifts: np.ndarray, frames: list[np.ndarray]) -> np.ndarray:
    """Projected MINRES for all columns at once: (P_j (V - θ_j) P_j) t_j = rhs_j, P_j = I - Z_j Z_j^T.

    `frames[j]` is Z_j; every step applies V to the block of all columns in one job.
    """
    def project(v: np.ndarray) -> np.ndarray:
        out = v.copy()
        for j, z in enumerate(frames):
            out[:, j] -= z @ (z.T @ out[:, j])
        return out

    def operator(v: np.ndarray) -> np.ndarray:
        pv = project(v)
        return project(apply(pv) - pv * shifts)

    d, p = rhs.shape
    b = project(rhs)
    beta1 = np.linalg.norm(b, axis=0)
    live = beta1 > 0
    safe = np.where(live, beta1, 1.0)
    v_prev, v = np.zeros((d, p)), b / safe
    beta = beta1.copy()
    gamma0, gamma1 = np.ones(p), np.ones(p)
    sigma0, sigma1 = np.zeros(p), np.zeros(p)
    eta = beta1.copy()
    w_prev2, w_prev = np.zeros((d, p)), np.zeros((d, p))
    x = np.zeros((d, p))
    for _ in range(INNER_STEPS):
        if not live.any():
            break
        av = operator(v)
        alpha = np.einsum("ij,ij->j", v, av)
        nxt = av - v * alpha - v_prev * beta
        beta_next = np.linalg.norm(nxt, axis=0)
        delta = gamma1 * alpha - gamma0 * sigma1 * beta
        rho1 = np.hypot(delta, beta_next)
        rho2 = sigma1 * alpha + gamma0 * gamma1 * beta
        rho3 = sigma0 * beta
        rho1_safe = np.where(rho1 > 0, rho1, 1.0)
        gamma0, sigma0 = gamma1, sigma1
        gamma1, sigma1 = delta / rho1_safe, beta_next / rho1_safe
        w = (v - w_prev2 * rho3 - w_prev * rho2) / rho1_safe
        step = np.where(live & (rho1 > 0), gamma1 * eta, 0.0)
        x += w * step
        eta = -sigma1 * eta
        w_prev2, w_prev = w_prev, w
        v_prev, v = v, nxt / np.where(beta_next > 0, beta_next, 1.0)
        beta = beta_next
        live = live & (np.abs(eta) > INNER_REDUCTION * beta1) & (beta_next > 0) & (rho1 > 0)
    return project(x)


def jacobi_davidson(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenpairs of the symmetric V that `apply` multiplies; returns (values, vectors, worst residual)."""
    k = min(k, d)
    if k == 0:
        return np.zeros(0), np.zeros((d, 0)), 0.0
    locked_vecs, locked_vals = np.zeros((d, 0)), []
    start = np.random.default_rng(SEED).standard_normal((d, min(d, k + BUFFER)))
    basis = _orthonormal(start, locked_vecs)
    products = apply(basis)
    worst = 0.0
    for _ in range(MAX_OUTER):
        small = basis.T @ products
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        top = max(abs(values[0]) if len(values) else 0.0, max(locked_vals, default=0.0), 1e-300)
        want = k - len(locked_vals)
        ritz, ritz_products = basis @ vectors, products @ vectors
        residuals = ritz_products - ritz * values
        norms = np.linalg.norm(residuals, axis=0)
        lock = 0
        while lock < min(want, len(values)) and norms[lock] <= TOLERANCE * top:
            lock += 1
        if lock:
            worst = max(worst, float(norms[:lock].max()))
            locked_vecs = np.hstack([locked_vecs, ritz[:, :lock]])
            locked_vals.extend(values[:lock].tolist())
            basis, products = ritz[:, lock:], ritz_products[:, lock:]
            values, vectors, residuals, norms = values[lock:], vectors[lock:, lock:], residuals[:, lock:], norms[lock:]
            ritz, ritz_products = basis, products
            want -= lock
        if want == 0:
            break
        if basis.shape[1] == 0:
            more = _orthonormal(np.random.default_rng(SEED + len(locked_vals)).standard_normal((d, want)), locked_vecs)
            basis, products = more, apply(more)
            continue
        active = min(want + BUFFER, basis.shape[1])
        frames = [np.hstack([locked_vecs, ritz[:, j:j + 1]]) for j in range(active)]
        corrections = _minres(apply, -residuals[:, :active], values[:active], frames)
        if basis.shape[1] + active > MAX_BASIS:
            keep = max(want + 1, MAX_BASIS // 2)
            basis, products = ritz[:, :keep], ritz_products[:, :keep]
        fresh = _orthonormal(corrections, np.hstack([locked_vecs, basis]))
        if fresh.shape[1] == 0:
            fresh = _orthonormal(residuals[:, :active], np.hstack([locked_vecs, basis]))
        if fresh.shape[1] == 0:
            fresh = _orthonormal(np.random.default_rng(SEED + basis.shape[1]).standard_normal((d, 1)), np.hstack([locked_vecs, basis]))
        if fresh.shape[1] == 0:
            # The basis and the locked vectors span everything: the Ritz pairs are exact.
            take = min(want, basis.shape[1])
            locked_vecs = np.hstack([locked_vecs, ritz[:, :take]])
            locked_vals.extend(values[:take].tolist())
            worst = max(worst, float(norms[:take].max()) if take else 0.0)
            break
        basis = np.hstack([basis, fresh])
        products = np.hstack([products, apply(fresh)])
    vals = np.array(locked_vals[:k])
    vecs = locked_vecs[:, :k]
    order = np.argsort(-vals, kind="stable")
    vals, vecs = vals[order], vecs[:, order]
    for j in range(vecs.shape[1]):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    return vals, vecs, worst


def _fit_list(rows: DataFrame, folder: str) -> DataFrame:
    """Each distinct x-vector once, written to the shared checkpoint folder and read back."""
    path = f"{folder.rstrip('/')}/whitening-fit-{uuid.uuid4().hex}"
    rows.select("__x").distinct().write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _dot(x: Column, values: np.ndarray, mean: np.ndarray) -> Column:
    """Σ_i (x_i − mean_i) · values_i as a JVM expression; short vectors count as zeros."""
    terms = F.zip_with(
        F.zip_with(x, F.array(*[F.lit(float(m)) for m in mean]), lambda a, m: F.coalesce(a.cast("double"), F.lit(0.0)) - m),
        F.array(*[F.lit(float(u)) for u in values]), lambda a, u: a * u)
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.coalesce(t, F.lit(0.0)))


def whiten(embeddings: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: its id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    ensure_checkpoint_dir(spark)
    rows = finite(embeddings, vector).select(F.col(id_col).alias("__id"), "__x")
    fit = _fit_list(rows, spark.sparkContext.getCheckpointDir())
    seen = fit.agg(F.count("*").alias("n"), F.max(F.size("__x")).alias("d")).first()
    n, d = int(seen["n"]), int(seen["d"] or 0)
    schema = (f"`{id_col}` LONG, component INT, n LONG, deviation LONG, whitened DOUBLE, explained DOUBLE, "
              "identity_error DOUBLE, eigenvalue DOUBLE, residual DOUBLE")
    if n == 0 or d == 0:
        return spark.createDataFrame([], schema)
    moments = (fit.select(F.posexplode("__x").alias("i", "v"))
               .groupBy("i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).collect())
    sums, squares = [0] * d, [0] * d
    for row in moments:
        sums[row["i"]], squares[row["i"]] = int(row["s"]), int(row["q"])
    # trace(V) = Σ_i (n Σ x_i² − S_i²) / n², exact in integers before the one division.
    trace = sum(n * q - s * s for s, q in zip(sums, squares)) / (n * n)
    products = CentredProducts(fit, n, np.array(sums, dtype=np.float64))
    values, vectors, worst = jacobi_davidson(products, d, components)
    positive = values > max(TOLERANCE * (values[0] if len(values) else 0.0), 0.0)
    identity_error = None
    if positive.any():
        u = vectors[:, positive] / np.sqrt(values[positive])
        covariance = u.T @ products(u)
        identity_error = float(np.abs(covariance - np.eye(u.shape[1])).max())
    x = F.col("__x")
    mean = np.array(sums, dtype=np.float64) / n
    deviation = F.aggregate(
        F.zip_with(x, F.array(*[F.lit(int(s)).cast("long") for s in sums]),
                   lambda a, s: F.coalesce(a, F.lit(0).cast("long")) * F.lit(n).cast("long") - s),
        F.lit(0).cast("long"), lambda acc, t: acc + t * t)
    parts = []
    for c in range(len(values)):
        e = float(values[c])
        whitened = _dot(x, vectors[:, c], mean) / F.lit(np.sqrt(e)) if positive[c] else F.lit(None).cast("double")
        parts.append(F.struct(
            F.lit(c + 1).alias("component"), whitened.alias("whitened"),
            F.lit(e / trace if trace > 0 else None).cast("double").alias("explained"),
            F.lit(e).alias("eigenvalue")))
    return rows.select(
        F.col("__id").alias(id_col), F.lit(n).cast("long").alias("n"), deviation.alias("deviation"),
        F.explode(F.array(*parts)).alias("__c"),
    ).select(
        id_col, "__c.component", "n", "deviation", "__c.whitened", "__c.explained",
        F.lit(identity_error).cast("double").alias("identity_error"), "__c.eigenvalue",
        F.lit(worst).cast("double").alias("residual"))
