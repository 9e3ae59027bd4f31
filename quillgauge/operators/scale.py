"""Helpers that keep group-wise operators even when one group holds much of the data."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A group of up to this many rows is ranked by one task; larger ones are cut in ranges.
HOT_GROUP_ROWS = 2_000_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; one of this machine only if all work is done here."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillgauge-"))


def durable(df: DataFrame) -> DataFrame:
    """Written once to the checkpoint folder; a lost executor cannot change its rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the table stays under both bounds; counted where the rows are."""
    width = F.octet_length(F.to_json(F.struct("*")))
    seen = df.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")
    ).first()
    return seen["n"] <= max_rows and seen["size"] <= max_bytes


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A broadcast hint behind a check; a larger side is left to a shuffled join."""
    return F.broadcast(df) if small(df) else df


# monotonically_increasing_id(): the task's number above these bits, the row within the task below.
ROW_BITS = 33


def position(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "pos",
    hot_rows: int = HOT_GROUP_ROWS, size: str | None = None,
) -> DataFrame:
    """1-based position of each row in its group, and the group's `size` if it is named.

    One plan for every group, large or small: the rows are range-partitioned and sorted by
    (keys, order) and written once, so a lost executor cannot renumber them; each task's rows
    are counted per group; prefix sums of those counts (a row per task and group it touches,
    joined back by broadcast only when `small` says so) give each row its offset. No task
    holds more than its range, however large a group is. Null keys are a group of their own.
    `order` must be unique in a group. `hot_rows` is accepted for callers and not used.
    """
    sort = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    ranked = durable(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__mid", F.monotonically_increasing_id())
    )
    ranked = ranked.withColumn("__task", F.shiftright("__mid", ROW_BITS)).withColumn(
        "__local", F.col("__mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    alias = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    named = [f"__k{i}" for i in range(len(keys))]
    counts = ranked.groupBy(*alias, "__task").agg(F.count("*").alias("__n"), F.min("__local").alias("__first"))
    before = Window.partitionBy(*named).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    offsets = offsets.withColumn("__size", F.sum("__n").over(Window.partitionBy(*named))).drop("__n")
    offsets = broadcast_if_small(offsets)
    same = [ranked[k].eqNullSafe(offsets[f"__k{i}"]) for i, k in enumerate(keys)] + [ranked["__task"] == offsets["__task"]]
    numbered = ranked.join(offsets, same).select(
        *[ranked[c] for c in df.columns],
        (F.col("__offset") + F.col("__local") - F.col("__first") + 1).cast("bigint").alias(name),
        F.col("__size").alias("__size"),
    )
    if size:
        numbered = numbered.withColumn(size, F.col("__size"))
    return numbered.drop("__size")


# Spark's default spark.sql.optimizer.windowGroupLimitThreshold: a rank filter up to it is cut
# in every task before the shuffle.
GROUP_LIMIT = 1000


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "pos") -> DataFrame:
    """First `n` rows per group; Spark drops the others before the shuffle.

    Up to GROUP_LIMIT rows this is one ranked window. Beyond it the rows are taken in rounds of
    GROUP_LIMIT, with no session setting: each round ranks what is left of every group, keeps its
    first GROUP_LIMIT rows (cut before the shuffle), and the next round starts after the last
    row a group gave; a group that gave fewer has nothing left. `order` must then be ascending
    columns that are unique in a group. The result is exact and numbered 1..n in every group.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if n <= GROUP_LIMIT:
        return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    rest, parts = df, []
    for start in range(0, n, GROUP_LIMIT):
        size = min(GROUP_LIMIT, n - start)
        ranked = rest.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= size)
        parts.append(ranked.withColumn(name, F.col(name) + start))
        if start + size >= n:
            break
        last = ranked.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
            F.max(F.struct(*order)).alias("__last"))
        joined = rest.join(last, [rest[k].eqNullSafe(last[f"__k{i}"]) for i, k in enumerate(keys)])
        rest = joined.filter(F.struct(*order) > F.col("__last")).select(*[rest[c] for c in df.columns])
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def concat_rows(df: DataFrame, keys: list[str], pos: str, texts: list[str]) -> DataFrame:
    """Each text column joined by LF in `pos` order; NULL where a group has no such text."""
    grouped = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(pos, *texts))).alias("_rows")
    )

    def joined(field: str) -> Column:
        text = F.array_join(F.transform("_rows", lambda r: r[field]), "\n")
        return F.nullif(text, F.lit("")).alias(field)

    return grouped.select(*keys, *[joined(t) for t in texts])
