"""Batched summaries of large change sets, reduced to one message per repository."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions import fixed as v
from quillgauge.functions import text as t
from quillgauge.operators.batching import assign_batches, halve
from quillgauge.operators.budget import capped_array, compact
from quillgauge.operators.messages import bundles, dedupe_keep_first, render_bundle
from quillgauge.operators.scale import HOT_GROUP_ROWS, durable
from quillgauge.plans.generate import Generator, generate


def _fallback_line() -> Column:
    return t.fallback_summary(
        F.col("repo"), F.col("name_status"), F.col("diff_stat"), F.col("untracked_note"),
        F.col("modal_dir"),
    )


def _summaries(groups: DataFrame, keys: list[str], fn: Generator, system: str, hot_rows: int) -> DataFrame:
    """One generated line per group of changes, its problem, and the line to fall back to."""
    records = bundles(groups, keys, hot_rows=hot_rows)
    prompts = records.select(
        *keys, _fallback_line().alias("fallback"),
        t.summary_prompt(F.col("repo"), render_bundle("full")).alias("prompt"),
        F.lit(system).alias("system"),
    )
    answers = durable(generate(prompts, fn, blank=True).drop("prompt", "system"))
    line = t.clean_summary_line(F.coalesce("raw", F.lit("")))
    return answers.withColumn("line", line).withColumn(
        "problem", t.summary_problem(F.col("line"), F.col("repo"))
    )


def batch_lines(
    changes: DataFrame, fn: Generator, system: str = "", max_files: int = v.MAX_BATCH_FILES,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """`lines(repo, seq, line, call_error)`: one line per batch, two for a batch that was halved.

    All batches of all repositories are summarised at once. A batch whose line is rejected is
    halved once; a half, or a batch of one file, falls back to a line made from its paths.
    """
    batches = durable(assign_batches(compact(changes), max_files, hot_rows=hot_rows))
    keys = ["repo", "batch_id"]
    first = _summaries(batches, keys, fn, system, hot_rows)
    sizes = batches.groupBy(*keys).agg(F.max("batch_n").alias("batch_n"))
    called = F.col("call_error").isNull()
    bad = F.col("problem").isNotNull() & called
    first = first.join(sizes, keys)
    keep = ["repo", "seq", "line", "call_error"]
    seq = (F.col("batch_id") * 2).alias("seq")
    whole = first.filter(~bad | (F.col("batch_n") == 1)).select(
        "repo", seq, F.when(bad, F.col("fallback")).otherwise(F.col("line")).alias("line"), "call_error"
    )
    again = first.filter(bad & (F.col("batch_n") > 1)).select(*keys)
    halves = halve(batches.join(again, keys, "left_semi"))
    second = _summaries(halves, [*keys, "half"], fn, system, hot_rows)
    split = second.select(
        "repo", (F.col("batch_id") * 2 + F.col("half")).alias("seq"),
        F.when(bad, F.col("fallback")).otherwise(F.col("line")).alias("line"), "call_error",
    )
    return whole.select(*keep).unionByName(split.select(*keep))


def reduce_lines(
    lines: DataFrame, sizes: DataFrame, fn: Generator, systems: Mapping[str, str]
) -> DataFrame:
    """One message per repository from its lines; `sizes` gives `n_files` per repository.

    One line is the message; up to six get a generated subject; more get a whole generated
    message. Output that is rejected is replaced by a subject made from the counts. A
    repository has at most two lines per batch, so its lines are a short array.
    """
    failed = lines.filter(F.col("call_error").isNotNull()).groupBy("repo").agg(
        F.min("call_error").alias("line_error")
    )
    items = (
        dedupe_keep_first(lines.filter(F.col("call_error").isNull()), ["repo"], "seq", "line")
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("_rows"))
    )
    # Every repository of `sizes` gets a row, also one without a line.
    rows = sizes.join(items, "repo", "left").join(failed, "repo", "left").select(
        "repo", "n_files", "line_error",
        F.coalesce(F.transform("_rows", lambda r: r["line"]), F.array().cast("array<string>")).alias("items"),
    )
    n = F.size("items")
    listed = F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x)), "\n")
    prompt = F.when(
        F.col("line_error").isNull(),
        F.when((n >= 2) & (n <= 6), t.subject_prompt(listed)).when(
            n > 6, t.reduce_prompt(listed, F.col("n_files"), n)
        ),
    )
    system = F.when(n <= 6, F.lit(systems.get("subject", ""))).otherwise(
        F.lit(systems.get("reduce", ""))
    )
    answers = durable(
        generate(rows.withColumn("prompt", prompt).withColumn("system", system), fn, blank=True).drop("prompt", "system")
    )
    raw = F.coalesce("raw", F.lit(""))
    answers = answers.withColumn("subject", t.clean_summary_line(raw)).withColumn(
        "whole", t.normalize_message(raw)
    ).withColumn("body", capped_array(F.col("items")))
    repo, count = F.col("repo"), n.cast("string")
    subject, whole, body = F.col("subject"), F.col("whole"), F.col("body")
    poor = t.summary_problem(subject, repo).isNotNull() | (
        F.length(subject) > v.MAX_REDUCED_SUBJECT_CHARS
    )
    made = F.when(
        poor, F.concat(F.lit("Update "), repo, F.lit(" across "), count, F.lit(" areas"))
    ).otherwise(subject)
    counted = F.concat(
        F.lit("Update "), repo, F.lit(": "), F.col("n_files").cast("string"),
        F.lit(" files across "), count, F.lit(" areas"),
    )

    def with_body(head: Column) -> Column:
        return F.concat(head, F.lit("\n\n"), body)

    empty = F.lit("")
    message = (
        F.when(n == 0, t.fallback_message(repo, empty, empty, empty))
        .when(n == 1, with_body(F.get("items", F.lit(0))))
        .when(n <= 6, with_body(made))
        .when(t.message_problem(whole, repo).isNull(), whole)
        .otherwise(with_body(counted))
    )
    error = F.coalesce("line_error", "call_error")
    return answers.select(
        "repo", "n_files", n.cast("bigint").alias("n_items"),
        F.when(error.isNull(), message).alias("message"), error.alias("call_error"),
    )


def summarize_changes(
    changes: DataFrame, fn: Generator, systems: Mapping[str, str] | None = None,
    max_files: int = v.MAX_BATCH_FILES, hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """One message per repository of a set of changes, through bounded batches."""
    systems = systems or {}
    lines = batch_lines(changes, fn, systems.get("summary", ""), max_files, hot_rows)
    sizes = changes.groupBy("repo").agg(F.count("*").alias("n_files"))
    return reduce_lines(lines, sizes, fn, systems)
