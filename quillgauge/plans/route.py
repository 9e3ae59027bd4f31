"""One commit message per repository, by the route its size sets: one bundle, or batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.functions import fixed as v
from quillgauge.operators.batching import is_large, weighted
from quillgauge.operators.budget import compact
from quillgauge.operators.messages import bundles
from quillgauge.operators.scale import HOT_GROUP_ROWS, broadcast_if_small, durable
from quillgauge.plans.generate import Generator, generate_with_escalation
from quillgauge.plans.summarize import summarize_changes


def commit_messages(
    changes: DataFrame, fn: Generator, system: str = "", systems: Mapping[str, str] | None = None,
    max_files: int = v.MAX_BATCH_FILES, max_chars: int = v.MAX_BATCH_CHARS, batching: bool = True,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """`(repo, route, n_files, weight, level, attempt_no, n_items, message, call_error)`, one row a repository.

    A repository with more than `max_files` change units, or more than `max_chars` of weighted
    diff, is summarised in batches and reduced to one message (`route` 'batches', `level`
    'reduce'); any other is one change record taken through the escalation levels (`route`
    'bundle'). With `batching` off, or `max_files` 0, every repository takes the bundle route.
    Sizes are one aggregation over all changes, without their diffs; the split is a semi and an anti join on
    the written sizes, broadcast if they are few, so both routes run in the same plan over their own
    repositories only, each change is written by its own route alone, and a
    repository of a third of all rows is cut by the batches and bundle runs as before. A
    repository without changes has no row. A failed call leaves `message` null with its
    `call_error`, as on each route alone.
    """
    units = weighted(compact(changes))
    sizes = durable(is_large(units, max_files, max_chars, batching))
    large = broadcast_if_small(sizes.filter("large").select("repo"))
    small = durable(units.join(large, "repo", "left_anti"))
    one = generate_with_escalation(bundles(small, ["repo"], hot_rows=hot_rows), fn, ["repo"], system).select(
        "repo", F.lit("bundle").alias("route"), "level", "attempt_no",
        F.lit(None).cast("bigint").alias("n_items"), "message", "call_error",
    )
    many = summarize_changes(changes.join(large, "repo", "left_semi"), fn, systems, max_files, hot_rows).select(
        "repo", F.lit("batches").alias("route"), F.lit("reduce").alias("level"),
        F.lit(None).cast("int").alias("attempt_no"), "n_items", "message", "call_error",
    )
    return one.unionByName(many).join(sizes.select("repo", "n_files", "weight"), "repo").select(
        "repo", "route", "n_files", "weight", "level", "attempt_no", "n_items", "message", "call_error",
    )
