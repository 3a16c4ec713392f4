"""Experiment table and run log.

The experiment table is JSON lines with a fixed schema; malformed lines are
dropped instead of hiding the whole history (decision S11).  The run log is a
long parquet table ``(run_id, experiment, run_name, kind, key, value)``.
Both are written with appends — no read-modify-write of the whole table.
"""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPERIMENT_SCHEMA = T.StructType([
    T.StructField("created_at", T.TimestampType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("task_type", T.StringType()),
    T.StructField("n_samples", T.LongType()),
    T.StructField("n_features", T.LongType()),
    T.StructField("is_imbalanced", T.BooleanType()),
    T.StructField("architecture", T.StringType()),
    T.StructField("hyperparams", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("approved", T.BooleanType()),
    T.StructField("critic_score", T.DoubleType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("best_val_loss", T.DoubleType()),
    T.StructField("training_time", T.DoubleType()),
    T.StructField("planner_flags", T.ArrayType(T.StringType())),
    T.StructField("analyst_risks", T.ArrayType(T.StringType())),
    T.StructField("critic_reasoning", T.StringType()),
])

RUN_LOG_SCHEMA = "run_id string, experiment string, run_name string, kind string, key string, value string"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """All past runs; a missing table is an empty DataFrame."""
    if not _exists(spark, path):
        return spark.createDataFrame([], EXPERIMENT_SCHEMA)
    return (spark.read.schema(EXPERIMENT_SCHEMA).option("mode", "DROPMALFORMED")
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path))


def experiment_row(spark: SparkSession, record: dict) -> DataFrame:
    """K5: one run record (a driver-side dict of bounded size) as a typed row."""
    rec = {f.name: record.get(f.name) for f in EXPERIMENT_SCHEMA.fields}
    if rec["created_at"] is None:
        rec["created_at"] = datetime.now(timezone.utc).replace(tzinfo=None)
    rec["hyperparams"] = {str(k): str(v) for k, v in (rec["hyperparams"] or {}).items()}
    rec["metrics"] = {str(k): float(v) for k, v in (rec["metrics"] or {}).items() if v is not None}
    return spark.createDataFrame([tuple(rec[f.name] for f in EXPERIMENT_SCHEMA.fields)],
                                 EXPERIMENT_SCHEMA)


def append_experiments(df: DataFrame, path: str) -> None:
    """Append rows (JSON lines; one part file per task, the reader takes the folder)."""
    (df.select(*[f.name for f in EXPERIMENT_SCHEMA.fields]).write.mode("append")
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path))


def clear_experiments(spark: SparkSession, path: str) -> None:
    """Replace the table by an empty one."""
    spark.createDataFrame([], EXPERIMENT_SCHEMA).write.mode("overwrite").json(path)


def log_run(spark: SparkSession, path: str, run_id: str, experiment: str, run_name: str,
            params: dict, metrics: dict) -> None:
    """A10: params and metrics of one run appended to the long run log."""
    rows = [(run_id, experiment, run_name, "param", str(k), str(v)) for k, v in params.items()]
    rows += [(run_id, experiment, run_name, "metric", str(k), repr(float(v))) for k, v in metrics.items()]
    spark.createDataFrame(rows, RUN_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def log_runs(runs: DataFrame, path: str, experiment: str, run_name: str, params: str,
             metrics: list[str]) -> None:
    """A10 for many runs at once: every run's params (a ``map<string,string>`` column) and
    metric columns exploded into the long run log by Spark and appended."""
    head = [F.col("run_id").cast("string").alias("run_id"),
            F.col(experiment).alias("experiment"), F.col(run_name).alias("run_name")]
    p = runs.select(*head, F.lit("param").alias("kind"), F.explode(params).alias("key", "value"))
    m = runs.select(*head, F.lit("metric").alias("kind"), F.explode(F.create_map(*[
        x for c in metrics for x in (F.lit(c), F.col(c).cast("double").cast("string"))]))
        .alias("key", "value"))
    p.unionByName(m).where(F.col("value").isNotNull()).write.mode("append").parquet(path)


def get_runs(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    """One row per run of an experiment, params and metrics as columns (empty if unknown)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "run_id string, run_name string")
    log = spark.read.parquet(path).where(F.col("experiment") == experiment)
    keys = [r[0] for r in log.select(F.concat_ws(".", "kind", "key")).distinct().collect()]  # bounded
    wide = log.withColumn("_k", F.concat_ws(".", "kind", "key")).groupBy("run_id", "run_name") \
              .pivot("_k", sorted(keys)).agg(F.first("value"))
    return wide


def new_run_id() -> str:
    return os.urandom(16).hex()
