"""Change batching: weights, directory-local order, bounded batches, halves and scoping.

Input is `changes(repo, path, status, added, deleted, is_binary, untracked, size, diff)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions import fixed as v
from quillgauge.functions import text as t
from quillgauge.operators.scale import HOT_GROUP_ROWS, position


def weighted(changes: DataFrame) -> DataFrame:
    """Adds the size estimate that decides about batching; untracked files weigh by size."""
    by_size = F.col("is_binary") | F.col("untracked")
    return changes.withColumn(
        "weight", t.change_weight(F.col("added"), F.col("deleted"), by_size, F.col("size"))
    )


def change_units(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """Tracked changes followed by untracked files, each with its weight."""
    binary_weight = t.change_weight(
        F.col("added"), F.col("deleted"), F.col("is_binary"), F.col("size")
    )
    first = tracked.select("repo", "path", binary_weight.alias("weight"), F.lit(0).alias("source"))
    size = F.greatest(F.lit(1), F.coalesce(F.col("size"), F.lit(1))).cast("bigint")
    second = untracked.select("repo", "path", size.alias("weight"), F.lit(1).alias("source"))
    return first.unionByName(second)


def distinct_paths(paths: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Each path once per group at its first place; counted map-side, no window."""
    return paths.groupBy(*keys, "path").agg(F.min(seq).alias(seq))


def directory_order() -> list[Column]:
    """Files of one directory next to each other; the path itself settles equal spellings."""
    return [F.lower(t.parent_dir(F.col("path"))), F.lower(F.col("path")), F.col("path")]


def is_large(
    changes: DataFrame, max_files: int = v.MAX_BATCH_FILES, max_chars: int = v.MAX_BATCH_CHARS,
    batching: bool = True,
) -> DataFrame:
    """Per repository: files, total weight, and whether it is to be summarised in batches."""
    too_big = (F.col("n_files") > max_files) | (F.col("weight") > max_chars)
    return (
        changes.groupBy("repo")
        .agg(F.count("*").alias("n_files"), F.sum("weight").alias("weight"))
        .withColumn("large", too_big if batching and max_files > 0 else F.lit(False))
    )


def assign_batches(
    changes: DataFrame, max_files: int = v.MAX_BATCH_FILES, max_batches: int = v.MAX_BATCHES,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Adds `batch_id`, `batch_n` and `batch_pos`: contiguous, directory-local, equal batches.

    Everything follows by arithmetic from a row's position and its repository's size, so the
    position is the only ordered step and nothing is joined back.
    """
    n = F.col("_n")
    count = F.greatest(F.lit(1), F.least(F.ceil(n / max_files), F.lit(max_batches)))
    placed = position(changes, ["repo"], directory_order(), "_pos", hot_rows, size="_n")
    return (
        placed.withColumn("_size", F.ceil(n / count))
        .withColumn("batch_id", F.floor((F.col("_pos") - 1) / F.col("_size")).cast("bigint"))
        .withColumn("batch_pos", F.col("_pos") - F.col("batch_id") * F.col("_size"))
        .withColumn("batch_n", F.least(F.col("_size"), n - F.col("batch_id") * F.col("_size")))
        .drop("_n", "_size", "_pos")
    )


def halve(batches: DataFrame) -> DataFrame:
    """Adds `half`: 0 for the first max(1, n div 2) files of a batch, 1 for the rest."""
    middle = F.greatest(F.lit(1), F.floor(F.col("batch_n") / 2))
    return batches.withColumn("half", F.when(F.col("batch_pos") <= middle, 0).otherwise(1))


def scope(changes: DataFrame, paths: DataFrame) -> DataFrame:
    """Changes limited to the given (repo, path) pairs."""
    return changes.join(paths.select("repo", "path"), ["repo", "path"], "left_semi")


def modal_top_dir(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent first path segment per group, the smallest name on a tie.

    Counted per (group, directory) first, so a large group is spread over its directories.
    """
    counts = (
        changes.select(*keys, t.top_dir(F.col("path")).alias("top"))
        .filter(F.col("top").isNotNull())
        .groupBy(*keys, "top")
        .agg(F.count("*").alias("n"))
    )
    # The smallest name among equals: min over (-count, name).
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("top"))).alias("b")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("b.top").alias("modal_dir"))
