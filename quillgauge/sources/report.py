"""Reports: fixed line formats per mode, and typed or text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render_report(df: DataFrame, mode: str) -> DataFrame:
    """Adds `line`, the report text of a row: cc, raw, halstead, mi or check."""
    return df.withColumn("line", report_line(mode))


def report_line(mode: str) -> Column:
    """Report text over the columns of one row."""
    if mode == "cc":
        return F.format_string("%s:%d %s (complexity=%d)", "path", "block_line", "name", "value")
    if mode == "raw":
        names = ["sloc", "lloc", "loc", "comments", "blank", "multi"]
        return F.format_string("%s " + " ".join(f"{n}=%d" for n in names), "path", *names)
    if mode == "halstead":
        return F.format_string(
            "%s volume=%.1f difficulty=%.1f effort=%.1f h1=%d h2=%d N1=%d N2=%d",
            "path", "volume", "difficulty", "effort", "h1", "h2", "N1", "N2",
        )
    if mode == "mi":
        return F.format_string("%s mi=%.2f", "path", "mi")
    if mode == "check":
        return F.format_string(
            "  %s:%d %s (%s=%d)", "path", "block_line", "name", "metric", "value"
        )
    raise ValueError(f"unknown report mode {mode!r}")


def write_report(df: DataFrame, mode: str, path: str, fmt: str = "parquet") -> None:
    """Write the rows (parquet, json) or their report lines in path order (text)."""
    order = ["path", "block_line"] if "block_line" in df.columns else ["path"]
    if fmt == "text":
        render_report(df, mode).orderBy(*order).select("line").write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
