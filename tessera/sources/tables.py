"""Parquet table scans with a parallelism floor.

A file written as one row group is read by one task, and everything up to the
first shuffle (tokenising, regex extraction, the wide profile aggregate) then
runs single-threaded.  ``spread`` round-robins such a scan over the session's
default parallelism.  On a cluster reading many files the scan already has
more splits than cores and ``spread`` is a no-op; column pruning and filter
pushdown still reach the parquet scan (they pass through the repartition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    return df.repartition(target) if n < target else df


def read_parquet(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    return spread(spark.read.parquet(path), min_partitions)
