"""Places of pattern matches in texts, with Spark functions alone.

A text is cut at the matches of a pattern; the lengths of the pieces between and of the matches
give the places. The cut happens in the row, the running sums of the lengths in a window over the
matches of one row, so cost grows with text and matches, never with their square. Only matches
are shuffled, not texts. All lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW, CONTEXT = "_row", 12


def matches(text: Column, pattern: str, kind: str, needs: Column | None = None) -> Column:
    """Array of (kind, nth, gap, value, left, right): each match, the length of the text between
    it and the match before, and the characters around it (CONTEXT at most).

    The text is cut only if there is a match, and read only if the cheap test `needs` holds.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(
            found.alias("value"), F.slice(pieces, 1, F.size(found)).alias("piece"), F.slice(pieces, 2, F.size(found)).alias("next")
        ),
        lambda m, k: F.struct(
            F.lit(kind).alias("kind"), k.cast("int").alias("nth"), F.char_length(m["piece"]).cast("bigint").alias("gap"),
            m["value"].alias("value"), F.right(m["piece"], F.lit(CONTEXT)).alias("left"), F.left(m["next"], F.lit(CONTEXT)).alias("right"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,nth:int,gap:bigint,value:string,left:string,right:string>>")
    usable = F.regexp_like(text, F.lit(pattern))
    return F.when(usable if needs is None else needs & usable, rows).otherwise(none)


def placed(docs: DataFrame, patterns: Column) -> DataFrame:
    """A row for each match of each row of `docs`: _row, doc_id, kind, value, start, stop (exclusive).

    Rows without a match stay, with null kind. `_row` tells rows apart that share their id; it
    is made once and lives in one lineage, so a task that is run again gives the same numbers.
    """
    # The number is made below the explosion: beside it, each match would get its own.
    keyed = docs.withColumn(ROW, F.monotonically_increasing_id())
    cut = keyed.select(ROW, "doc_id", F.explode_outer(patterns).alias("m")).select(ROW, "doc_id", "m.*")
    before = Window.partitionBy(ROW, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("value").cast("bigint")
    return (
        cut.withColumn("_end", F.sum(F.col("gap") + length).over(before))
        .select(ROW, "doc_id", "kind", "value", "left", "right", (F.col("_end") - length).alias("start"), F.col("_end").alias("stop"))
    )


def near(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Pairs of spans of one row whose gap is at most `reach`: an interval join by bins.

    Each span of `left` is in the bins that it touches, each of `right` also in the bins next to
    them, so the join is an equality of (row, bin) and a bin holds what fits into `reach`
    characters. The columns of `right` get the prefix `o_`.
    """
    def bins(start: Column, stop: Column, more: int) -> Column:
        return F.explode(F.sequence(F.floor(start / reach) - more, F.floor(stop / reach) + more))

    other = right.select(*[F.col(c).alias(f"o_{c}") for c in right.columns])
    gap = F.greatest(F.col("o_start") - F.col("stop"), F.col("start") - F.col("o_stop"))
    return (
        left.withColumn("_bin", bins(F.col("start"), F.col("stop"), 0))
        .join(other.withColumn("_o_bin", bins(F.col("o_start"), F.col("o_stop"), 1)), (F.col(ROW) == F.col(f"o_{ROW}")) & (F.col("_bin") == F.col("_o_bin")))
        .filter(gap <= reach).withColumn("overlaps", gap < 0).drop("_bin", "_o_bin", f"o_{ROW}")
    )


def joined_spans(spans: Column) -> Column:
    """kind:start:end of an array of (.., kind, start, stop) in its own order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
