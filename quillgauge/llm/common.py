"""Helpers of the training-data operators: reading tables, Arrow slices, sums of arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_ROWS = 256
TRAIN_FOLDS, HELD_FOLD = 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept back from learning, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % TRAIN_FOLDS == HELD_FOLD, F.lit(False))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the Python objects of only a few texts live at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """Texts with a label, from learning folds only, `bound` rows at most in expectation.

    Which rows are taken depends on their id alone, so reruns agree. The ids of the sample are
    bounded by `bound`, which is why they may be broadcast.
    """
    usable = (
        labels.filter(F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    known = usable.count()
    if known > bound:
        cut = int((1 << 30) * (bound / known))
        usable = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < cut)
    return docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").filter(F.col("text").isNotNull())


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of `df` and one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


PARTIALS = "part INT, block INT, data BINARY"


def partial_rows(array: np.ndarray, part: int, blocks: int = 16) -> Iterator[pa.RecordBatch]:
    """One task's array as rows, cut into blocks that are summed apart from each other."""
    for k, piece in enumerate(np.array_split(array, blocks)):
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "block": pa.array([k], pa.int32()),
            "data": pa.array([np.ascontiguousarray(piece, np.float32).tobytes()], pa.binary()),
        })


def add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sum of a group's arrays, which all belong to one block."""
    total, block = None, 0
    for batch in batches:
        for data, of in zip(batch.column("data"), batch.column("block"), strict=True):
            piece, block = np.frombuffer(data.as_py(), np.float32), of.as_py()
            total = piece.astype(np.float64) if total is None else total + piece
    yield pa.RecordBatch.from_pydict({
        "part": pa.array([0], pa.int32()), "block": pa.array([block], pa.int32()),
        "data": pa.array([total.astype(np.float32).tobytes()], pa.binary()),
    })


def summed(partials: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the tasks' arrays in two levels; the size of the result is fixed by `shape`."""
    first = partials.withColumn("part", F.pmod("part", F.lit(32))).groupBy("part", "block").applyInArrow(add_pieces, PARTIALS)
    rows = first.groupBy("block").applyInArrow(add_pieces, PARTIALS).collect()
    if not rows:
        return np.zeros(shape, np.float32)
    return np.concatenate([np.frombuffer(r["data"], np.float32) for r in sorted(rows, key=lambda r: r["block"])]).reshape(shape)
