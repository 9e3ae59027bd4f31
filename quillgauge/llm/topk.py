"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates are written once (so a lost executor recomputes the same blocks), dealt into blocks of
about CANDIDATE_ROWS rows by a hash of their row number, and packed per block in vertical layout:
one contiguous array per dimension, plus for every dimension block the norm of each candidate's
remaining dimensions. Queries are packed per block of about QUERY_ROWS rows. Each query block is
joined to every candidate block (the stated query set against all rows, in blocks; the query side,
a fiftieth of the rows, is the one that is copied), and one task searches a pair:

  per query, scores are accumulated one dimension block at a time over the surviving candidates;
  after a block, a candidate's final score lies within partial ± |q_rest|·|c_rest|; the k-th best
  lower bound is a threshold, and every candidate whose upper bound falls below it is dropped and
  the survivors compacted. After the last block the survivors hold exact integer scores.

Each pair yields at most k rows per query; a window keeps the k best per query over all blocks
(Spark limits each window group before its shuffle).

Defined results:
  * vectors that are null or hold a null, NaN or infinite entry take no part, as query or candidate.
  * x = floor(256·c) as long; score = integer inner product, shorter vectors count as zeros.
  * a query is each distinct (vec_id, x) whose vec_id is divisible by QUERY_EVERY; a query never
    meets a candidate with its own vec_id. Repeated candidate rows are candidates each.
  * ties go to the smaller vec_id; a null vec_id comes after all others. Fewer than k candidates:
    all of them. No query or no candidate: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.llm.whitening import finite
from quillgauge.operators.scale import durable

K = 5
QUERY_EVERY = 50
CANDIDATE_ROWS = 8192
QUERY_ROWS = 2048
DIMENSION_BLOCK = 8
NULL_ID = np.iinfo(np.int64).max

PACKED = "block LONG, ids BINARY, nulls BINARY, data BINARY, rest BINARY, rows INT, dims INT"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    values = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.int64)
    return offsets, values, np.diff(offsets)


def _dense(batch_lists: list[pa.Array], d: int) -> np.ndarray:
    """Rows of x as an int64 matrix of d columns, short rows padded with zeros."""
    parts = []
    for column in batch_lists:
        offsets, values, lengths = _lists(column)
        out = np.zeros((len(lengths), d), np.int64)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        cols = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], lengths)
        out[rows, cols] = values[offsets[0]:offsets[-1]]
        parts.append(out)
    return np.vstack(parts) if parts else np.zeros((0, d), np.int64)


def _pack(d: int):
    """A block's rows as one row: ids, vertical data, and rest norms after each dimension block."""
    def run(table: pa.Table) -> pa.Table:
        nulls = np.asarray(table.column("id").is_null().to_numpy(zero_copy_only=False), dtype=np.bool_)
        ids = np.where(nulls, NULL_ID, pc.fill_null(table.column("id"), 0).to_numpy()).astype(np.int64)
        x = _dense([c for c in table.column("__x").chunks], d)
        squares = (x.astype(np.float64) ** 2)
        edges = list(range(0, d, DIMENSION_BLOCK)) + [d]
        rest = np.stack([np.sqrt(squares[:, end:].sum(axis=1)) for end in edges[1:]]) if d else np.zeros((0, len(ids)))
        return pa.table({
            "block": pa.array([int(table.column("block")[0].as_py())], pa.int64()),
            "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
            "nulls": pa.array([nulls.tobytes()], pa.binary()),
            "data": pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary()),
            "rest": pa.array([np.ascontiguousarray(rest).tobytes()], pa.binary()),
            "rows": pa.array([len(ids)], pa.int32()), "dims": pa.array([d], pa.int32()),
        })
    return run


def _unpack(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, d = row[f"{prefix}rows"], row[f"{prefix}dims"]
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    nulls = np.frombuffer(row[f"{prefix}nulls"], np.bool_)
    data = np.frombuffer(row[f"{prefix}data"], np.int64).reshape(d, n)
    rest = np.frombuffer(row[f"{prefix}rest"], np.float64).reshape(-1, n)
    return ids, nulls, data, rest


def best(query: np.ndarray, query_rest: np.ndarray, own: int, ids: np.ndarray, nulls: np.ndarray,
         vertical: np.ndarray, rest: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best candidates of one query: (positions, scores, candidates scored in full)."""
    d, m = vertical.shape
    exact_float = d == 0 or float(np.abs(vertical).max(initial=0)) * float(np.abs(query).max(initial=0)) * d < 2.0 ** 52
    active = np.flatnonzero(nulls | (ids != own))
    partial = np.zeros(len(active), np.float64 if exact_float else np.int64)
    edges = list(range(0, d, DIMENSION_BLOCK)) + [d]
    for b in range(len(edges) - 1):
        lo, hi = edges[b], edges[b + 1]
        if len(active) == 0:
            break
        block = vertical[lo:hi][:, active]
        q = query[lo:hi]
        partial = partial + (block.T.astype(np.float64) @ q.astype(np.float64) if exact_float else block.T @ q)
        if hi == d or len(active) <= k:
            continue
        bound = query_rest[b] * rest[b][active]
        lower, upper = partial - bound, partial + bound
        tau = np.partition(lower, len(lower) - k)[len(lower) - k]
        keep = upper + 1e-9 * np.abs(upper) + 0.5 >= tau
        active, partial = active[keep], partial[keep]
    scores = np.rint(partial).astype(np.int64) if exact_float else partial.astype(np.int64)
    order = np.lexsort((ids[active], nulls[active], -scores))[:k]
    return active[order], scores[order], len(active)


def _search(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qids, _, qdata, _ = _unpack(row, "q_")
                ids, nulls, vertical, rest = _unpack(row, "c_")
                d = vertical.shape[0]
                queries = qdata.T
                edges = list(range(0, d, DIMENSION_BLOCK)) + [d]
                out_q, out_id, out_null, out_score = [], [], [], []
                for qi in range(queries.shape[0]):
                    q = queries[qi]
                    q_rest = np.array([math.sqrt(float((q[end:].astype(np.float64) ** 2).sum())) for end in edges[1:]])
                    pos, scores, _ = best(q, q_rest, int(qids[qi]), ids, nulls, vertical, rest, k)
                    out_q.append(np.full(len(pos), qids[qi], np.int64))
                    out_id.append(ids[pos])
                    out_null.append(nulls[pos])
                    out_score.append(scores)
                if out_q:
                    ids_out = np.concatenate(out_id)
                    yield pa.RecordBatch.from_pydict({
                        "query_id": pa.array(np.concatenate(out_q), pa.int64()),
                        "vec_id": pa.array(ids_out, pa.int64(), mask=np.concatenate(out_null)),
                        "score": pa.array(np.concatenate(out_score), pa.int64()),
                    })
    return run


def top_k(embeddings: DataFrame, vector: str = "embedding", id_col: str = "vec_id", k: int = K,
          every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products."""
    spark = embeddings.sparkSession
    rows = durable(finite(embeddings, vector).select(F.col(id_col).cast("long").alias("id"), "__x")
                   .withColumn("__row", F.monotonically_increasing_id()))
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("__x")).alias("d"),
                    F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    schema = "query_id LONG, rank INT, vec_id LONG, score LONG"
    n, d = int(seen["n"]), int(seen["d"] or 0)
    if n == 0 or int(seen["q"]) == 0:
        return spark.createDataFrame([], schema)
    candidate_blocks = max(1, math.ceil(n / CANDIDATE_ROWS))
    query_blocks = max(1, math.ceil(int(seen["q"]) / QUERY_ROWS))
    packed_schema = PACKED
    candidates = (rows.withColumn("block", F.pmod(F.xxhash64("__row"), F.lit(candidate_blocks)))
                  .groupBy("block").applyInArrow(_pack(d), packed_schema))
    queries = (rows.filter(F.col("id") % every == 0).select("id", "__x").distinct()
               .withColumn("block", F.pmod(F.xxhash64("id", "__x"), F.lit(query_blocks)))
               .groupBy("block").applyInArrow(_pack(d), packed_schema))
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]).withColumn(
        "c_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(candidate_blocks - 1).cast("long"))))
    c = candidates.select(*[F.col(col).alias(f"c_{col}") for col in candidates.columns])
    # Each query block is written once per candidate block, which Spark's estimate does not see: never broadcast, whatever it says.
    pairs = q.hint("merge").join(c, "c_block")
    found = pairs.mapInArrow(_search(k), "query_id LONG, vec_id LONG, score LONG")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
