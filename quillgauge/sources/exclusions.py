"""Exclusion lists: a JSON object of `[path part, block name]` pairs per metric."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "cyclomatic ARRAY<ARRAY<STRING>>, cognitive ARRAY<ARRAY<STRING>>, _corrupt_record STRING"
)
ROWS = "metric STRING, part STRING, block STRING"


def exclusion_rows(lists: DataFrame) -> DataFrame:
    """`exclusions(metric, part, block)` from rows of the two lists."""

    def tagged(metric: str):
        pairs = F.coalesce(F.col(metric), F.array().cast("array<array<string>>"))
        return F.transform(
            F.filter(pairs, lambda p: F.size(p) == 2),
            lambda p: F.struct(
                F.lit(metric).alias("metric"), p[0].alias("part"), p[1].alias("block")
            ),
        )

    return lists.select(F.inline(F.concat(tagged("cyclomatic"), tagged("cognitive"))))


def read_exclusions(spark: SparkSession, path: str | None) -> DataFrame:
    """Exclusions of a file; a missing or malformed one gives no rows and a warning."""
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], ROWS)
    lists = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    # The file is one JSON object, hence one row.
    if lists.filter(F.col("_corrupt_record").isNotNull()).take(1):
        logging.getLogger(__name__).warning("could not load exclusions from %s", path)
        return spark.createDataFrame([], ROWS)
    return exclusion_rows(lists)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
