"""Placement of rows, checked against sizes the planner knows without running a job."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of an input too small to fill the cores.

    A Parquet scan cannot be split below a row group, so a small file keeps one core busy
    with all the per-row text work. An input of at least one full split per core is left as
    it is: it is parallel already, and dealing it out would be a needless shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    ))
    return df.repartition(cores) if size < cores * split else df
