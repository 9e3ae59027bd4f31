"""Text budgets: diff excerpts, untracked notes and capped lists per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.functions import fixed as v
from quillgauge.functions import text as t
from quillgauge.operators.scale import first_n


def cap_per_group(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First `n` rows per group in the given order."""
    return first_n(df, keys, [F.col(o) for o in order], n, "_rank").drop("_rank")


def compact(changes: DataFrame) -> DataFrame:
    """Swaps each diff for what any excerpt or note can show of it, before any shuffle.

    `diff_head` is NULL for a blank diff, else its first characters, `diff_len` its length;
    `snippet` is the trimmed start of a text file. Rows are of bounded size from here on.
    """
    filled = t.strip(F.col("diff")) != ""
    snippet = F.when(
        t.is_text_path(F.col("path")),
        F.nullif(t.truncate(t.strip(F.col("diff")), v.MAX_SNIPPET_CHARS), F.lit("")),
    )
    return (
        changes.withColumn("diff_head", F.when(filled, F.substring("diff", 1, v.MAX_FILE_CHARS)))
        .withColumn("diff_len", F.length("diff"))
        .withColumn("snippet", F.when(F.col("untracked"), snippet))
        .drop("diff")
    )


def pack_excerpts(
    changes: DataFrame, keys: list[str], max_chars: int = v.MAX_DIFF_CHARS, order: str = "path"
) -> DataFrame:
    """One text of diff excerpts per group, within a budget, from compacted changes.

    There is one row per path, and `order` is unique in a group. Only a bounded number of
    leading non-empty diffs can fit (each costs at least its heading), so all others are
    dropped before the shuffle. The budget is then a running sum over those few rows.
    """
    head, tail = v.DIFF_TITLE
    least_cost = len(head) + len(tail) + 1 + 2
    candidates = max_chars // least_cost + 2
    totals = changes.groupBy(*keys).agg(
        F.count("*").alias("_paths"), F.max(order).alias("_last")
    )
    filled = changes.filter(F.col("diff_head").isNotNull()).select(
        *keys, "path", F.col(order).alias("_ord"), F.col("diff_len").alias("_len"),
        F.col("diff_head").alias("_cut"),
    )
    few = first_n(filled, keys, [F.col("_ord")], candidates, "_rn").join(totals, keys)
    per_file = F.greatest(
        F.lit(v.MIN_FILE_CHARS),
        F.least(F.lit(v.MAX_FILE_CHARS), F.floor(F.lit(max_chars) / F.col("_paths")).cast("int")),
    )
    cost = (
        F.lit(len(head) + len(tail) + 2) + F.length("path") + F.least(F.col("_len"), per_file)
        + F.when(F.col("_len") > per_file, len(v.TRUNCATED)).otherwise(0)
    )
    upto = Window.partitionBy(*keys).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    spent = (
        few.withColumn("_per", per_file)
        .withColumn("_cost", cost)
        .withColumn("_left", F.lit(max_chars) - F.sum("_cost").over(upto) + F.col("_cost"))
        .filter(F.col("_left") > 0)
    )
    limit = F.least(F.col("_per"), F.col("_left")).cast("int")
    body = F.when(
        F.col("_len") > limit, F.concat(F.substring(F.col("_cut"), F.lit(1), limit), F.lit(v.TRUNCATED))
    ).otherwise(F.col("_cut"))
    section = F.concat(F.lit(head), F.col("path"), F.lit(tail), body)
    # The row that uses the budget up; a later path, if any, is then announced as omitted.
    ends = F.when((F.col("_left") - F.col("_cost") <= 0), F.col("_ord"))
    packed = spent.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rn"), section.alias("s")))).alias("_rows"),
        F.min(ends).alias("_end"), F.max("_last").alias("_last"),
    )
    omitted = F.when(F.col("_last") > F.col("_end"), F.array(F.lit(v.FILES_OMITTED))).otherwise(
        F.array().cast("array<string>")
    )
    sections = F.concat(F.transform("_rows", lambda r: r["s"]), omitted)
    return packed.select(*keys, F.array_join(sections, "\n\n").alias("diff_sample"))


def untracked_snippets(
    files: DataFrame, keys: list[str], max_files: int = v.MAX_UNTRACKED, order: str = "path"
) -> DataFrame:
    """One note per group: its first paths, a snippet of each text file, and what is left out.

    The files are compacted; all but the first paths are dropped before the shuffle.
    """
    listed = first_n(
        files.select(*keys, "path", F.col(order).alias("_ord"), F.col("snippet").alias("_snippet")),
        keys, [F.col("_ord")], max_files, "_rn",
    )
    entry = F.concat_ws(
        "\n", F.col("path"),
        F.concat(F.lit(v.FENCE + "\n"), F.col("_snippet"), F.lit("\n" + v.FENCE)),
    )
    notes = listed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_rn", entry.alias("s"), "path"))).alias("_rows")
    )
    counts = files.groupBy(*keys).agg(F.count("*").alias("n_untracked"))
    more = F.when(
        F.col("n_untracked") > max_files,
        F.array(F.concat(
            F.lit(v.OMITTED_PATHS[0]), (F.col("n_untracked") - max_files).cast("string"),
            F.lit(v.OMITTED_PATHS[1]),
        )),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.lit(""), F.lit(v.UNTRACKED_TITLE)), F.transform("_rows", lambda r: r["s"]), more
    )
    return notes.join(counts, keys).select(
        *keys, F.array_join(lines, "\n").alias("untracked_note"),
        F.transform("_rows", lambda r: r["path"]).alias("untracked_paths"), "n_untracked",
    )


def cap_list(
    items: DataFrame, keys: list[str], seq: str, item: str, max_chars: int = v.MAX_BODY_CHARS
) -> DataFrame:
    """One `- item` list per group within a budget, with a last line for what is left.

    An entry costs at least three characters, which bounds how many leading items can fit;
    the others are only counted.
    """
    counts = items.groupBy(*keys).agg(F.count("*").alias("_n"))
    few = first_n(
        items.select(*keys, F.col(seq).alias("_seq"), F.col(item).alias("_item")),
        keys, [F.col("_seq")], max_chars // 3 + 2, "_rn",
    )
    upto = Window.partitionBy(*keys).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    kept = few.withColumn("_sum", F.sum(F.length("_item") + 3).over(upto)).filter(
        (F.col("_rn") == 1) | (F.col("_sum") <= max_chars)
    )
    lists = kept.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_rn", "_item"))).alias("_rows")
    )
    return lists.join(counts, keys).select(*keys, capped_text(F.transform("_rows", lambda r: r["_item"]), F.col("_n")).alias("body"))


def capped_text(kept: Column, total: Column) -> Column:
    """List text of the kept items, followed by the number of items left out."""
    left = total - F.size(kept)
    more = F.when(
        left > 0,
        F.array(F.concat(F.lit(v.MORE_AREAS[0]), left.cast("string"), F.lit(v.MORE_AREAS[1]))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_join(
        F.concat(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), more), "\n"
    )


def capped_array(items: Column, max_chars: int = v.MAX_BODY_CHARS) -> Column:
    """`cap_list` for a short array inside a row, such as a repository's batch lines."""
    fits = F.aggregate(
        items,
        F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda s, x: F.struct(
            (s["used"] + F.length(x) + 3).alias("used"),
            F.when(s["open"] & ((s["n"] == 0) | (s["used"] + F.length(x) + 3 <= max_chars)), s["n"] + 1)
            .otherwise(s["n"]).alias("n"),
            (s["open"] & ((s["n"] == 0) | (s["used"] + F.length(x) + 3 <= max_chars))).alias("open"),
        ),
        lambda s: s["n"],
    )
    return capped_text(F.slice(items, F.lit(1), fits), F.size(items))
