"""Generated messages: first acceptable attempt, ordered dedupe and change bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions import fixed as v
from quillgauge.functions import text as t
from quillgauge.operators.batching import modal_top_dir
from quillgauge.operators.budget import pack_excerpts, untracked_snippets
from quillgauge.operators.scale import HOT_GROUP_ROWS, concat_rows, position

BUNDLE_FIELDS = ["porcelain", "name_status", "diff_stat", "diff_sample", "untracked_note"]


def judged(attempts: DataFrame, repo: Column, raw: str = "raw") -> DataFrame:
    """Adds the cleaned `message` and its `problem` (NULL when accepted)."""
    cleaned = attempts.withColumn("message", t.normalize_message(F.col(raw)))
    return cleaned.withColumn("problem", t.message_problem(F.col("message"), repo))


def first_acceptable(judged: DataFrame, key: str, fallback: Column | None = None) -> DataFrame:
    """Per item the message of its lowest accepted attempt, else the fallback.

    An aggregation with map-side combine, so an item with very many attempts is no hot task.
    """
    good = F.col("problem").isNull()
    picked = judged.groupBy(key).agg(
        F.min_by(F.when(good, F.col("message")), F.when(good, F.col("attempt_no"))).alias("picked"),
        F.min(F.when(good, F.col("attempt_no"))).alias("attempt_no"),
    )
    return picked.select(
        key, "attempt_no",
        F.coalesce("picked", fallback if fallback is not None else F.lit(None)).alias("message"),
    )


def dedupe_keep_first(lines: DataFrame, keys: list[str], seq: str, line: str) -> DataFrame:
    """First spelling of each line per group, compared without case and spacing; no empties."""
    keyed = lines.withColumn("_key", t.collapse_key(F.col(line))).filter(F.col("_key") != "")
    return keyed.groupBy(*keys, "_key").agg(
        F.min_by(line, seq).alias(line), F.min(seq).alias(seq)
    ).drop("_key")


# --- bundles ----------------------------------------------------------------------------


def log_lines(changes: DataFrame) -> DataFrame:
    """Adds the three listing lines of a change; untracked files have a status line only."""
    letter = F.substring("status", 1, 1)
    tracked = ~F.col("untracked")
    count = F.when(F.col("is_binary"), F.lit("Bin")).otherwise(
        (F.col("added") + F.col("deleted")).cast("string")
    )
    return (
        changes.withColumn(
            "porcelain",
            F.when(tracked, F.concat(letter, F.lit("  "), F.col("path"))).otherwise(
                F.concat(F.lit("?? "), F.col("path"))
            ),
        )
        .withColumn("name_status", F.when(tracked, F.concat("status", F.lit("\t"), "path")))
        .withColumn("diff_stat", F.when(tracked, F.concat(F.lit(" "), "path", F.lit(" | "), count)))
    )


def bundle_runs(changes: DataFrame, keys: list[str], hot_rows: int = HOT_GROUP_ROWS, run: int = 2000) -> DataFrame:
    """Listings of each group as ordered runs of lines: whole at any size of a group.

    Runs are put together by many tasks even for one group. Only the lines are moved, never a diff.
    """
    lines = log_lines(changes).select(*keys, *[c for c in ["path"] if c not in keys], *BUNDLE_FIELDS[:3])
    placed = position(lines, keys, [F.col("path")], "_p", hot_rows).withColumn(
        "run", F.floor((F.col("_p") - 1) / run).cast("bigint")
    )
    return concat_rows(placed, [*keys, "run"], "_p", BUNDLE_FIELDS[:3])


def bundles(
    changes: DataFrame, keys: list[str], branch: str = "main",
    max_diff_chars: int = v.MAX_DIFF_CHARS, hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """One change record per group: listings, diff excerpts, untracked note and modal directory.

    `changes` are compacted, and best written out, as several branches read them; `keys`
    starts with `repo`. Listings are whole at any size: a prompt is one text, so what goes
    into it is one cell; `bundle_runs` gives the same as ordered runs.
    """
    listing = BUNDLE_FIELDS[:3]
    joined = concat_rows(bundle_runs(changes, keys, hot_rows), keys, "run", listing)
    listings = joined.select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in listing])
    tracked = changes.filter(~F.col("untracked"))
    notes = untracked_snippets(changes.filter("untracked"), keys)
    return (
        listings.join(pack_excerpts(tracked, keys, max_diff_chars), keys, "left")
        .join(notes, keys, "left")
        .join(modal_top_dir(tracked, keys), keys, "left")
        .withColumn("branch", F.lit(branch))
        .withColumn("diff_sample", t.rstrip(F.coalesce("diff_sample", F.lit(""))))
        .withColumn("untracked_note", F.coalesce("untracked_note", F.lit("")))
        .withColumn("untracked_paths", F.coalesce("untracked_paths", F.array().cast("array<string>")))
    )


def render_bundle(level: str, repo: Column | None = None) -> Column:
    """Bundle text at a level: full, lite (cut excerpts and note) or paths-only (no excerpts)."""
    name, titles = repo if repo is not None else F.col("repo"), v.BUNDLE_TITLES
    before, between, after = titles["repo"]
    head = [F.concat(F.lit(before), name, F.lit(between), F.col("branch"), F.lit(after))]
    for listing in BUNDLE_FIELDS[:3]:
        head += [F.lit(titles[listing]), F.col(listing)]
    note = F.nullif(t.rstrip(F.col("untracked_note")), F.lit(""))
    sample = F.col("diff_sample")
    if level == "full":
        tail = [F.lit(titles[level]), sample, note]
    elif level == "lite":
        tail = [
            F.lit(titles[level]), t.truncate(sample, v.LITE_EXCERPT_CHARS),
            t.truncate(note, v.LITE_NOTE_CHARS),
        ]
    else:
        paths = F.array_join(F.slice("untracked_paths", 1, v.MAX_UNTRACKED), "\n")
        tail = [F.concat(F.lit(titles[level] + "\n"), F.nullif(paths, F.lit("")))]
    return F.concat_ws("\n", *head, *tail)
