"""Tables written to the shared folder so that lineage is cut and executors can be lost."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let the driver collect garbage: Spark deletes the shuffle files of jobs that nothing holds any more."""
    for _ in range(2):  # the listeners of the last job hold its plan for a moment
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


class Scratch:
    """Tables written to the shared folder that go when the ``with`` block ends, and the shuffles that made them."""

    def __init__(self):
        self.paths: list[tuple[str, SparkSession]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(df.sparkSession, name)
        self.paths.append((path, df.sparkSession))
        df.write.parquet(path)
        drop_shuffles(df.sparkSession)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path, spark in self.paths:
            remove(path, spark)
            drop_shuffles(spark)


def remove(df_path: str, spark: SparkSession) -> None:
    """Delete a scratch table that no remaining plan reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
