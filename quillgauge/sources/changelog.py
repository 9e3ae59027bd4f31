"""Change logs: tab-separated text lines to typed change tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions import text as t


def parse_numstat(lines: DataFrame, value: str = "value") -> DataFrame:
    """`added⇥deleted⇥path` lines; `-` marks a binary file, further tabs belong to the path.

    Lines of fewer than three fields or with an empty path are dropped.
    """
    parts = F.split(t.rstrip(F.col(value)), "\t", 3)
    rest = [F.col(c) for c in lines.columns if c != value]
    rows = lines.select(*rest, parts.alias("_f")).filter(
        F.get("_f", F.lit(2)) != ""
    )
    added, deleted, path = (F.get("_f", F.lit(i)) for i in range(3))
    binary = (added == "-") | (deleted == "-")

    def count(text: Column) -> Column:
        return F.coalesce(text.try_cast("bigint"), F.lit(0))

    return rows.select(
        *rest,
        path.alias("path"),
        F.when(~binary, count(added)).alias("added"),
        F.when(~binary, count(deleted)).alias("deleted"),
        binary.alias("is_binary"),
    )


def parse_name_status(lines: DataFrame, value: str = "value") -> DataFrame:
    """`status⇥path[⇥newpath]` lines; a rename or copy keeps the new path."""
    rest = [F.col(c) for c in lines.columns if c != value]
    rows = lines.select(*rest, F.split(t.strip(F.col(value)), "\t+").alias("_f"))
    status, second = F.get("_f", F.lit(0)), F.get("_f", F.lit(1))
    path = F.when(status.rlike("^[RC]"), F.element_at("_f", -1)).otherwise(second)
    return rows.filter(F.size("_f") >= 2).select(
        *rest, status.alias("status"), path.alias("path")
    )
