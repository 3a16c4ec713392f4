"""Streaming scoring and the end-to-end run() (slow)."""
import os

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tessera.operators import features as FT
from tessera.operators import split as SP
from tessera.streaming.score import score_stream
from tests.conftest import SF


def test_score_stream_equals_batch(spark, tmpdir_path):
    rows = [(float(i), "abc"[i % 3], f"{i % 7}GB", float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, c string, ram string, y double")
    src = os.path.join(tmpdir_path, "in")
    df.write.parquet(src)
    fitted = FT.FeaturePipeline(target="y").fit(df)
    model = LogisticRegression(labelCol="y").fit(fitted.transform(df.withColumn("_row_id", SP.row_hash(df.columns))))
    batch = {tuple(r[:3]): r["prediction"] for r in score_stream(df, fitted, model).collect()}
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = score_stream(stream, fitted, model).writeStream.format("memory").queryName("scored") \
        .outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r[:3]): r["prediction"] for r in spark.sql("SELECT * FROM scored").collect()}
    assert got == batch and len(got) == 60


def test_run_end_to_end(spark, tmpdir_path):
    from tessera.plans import pipeline as PL
    from tessera.plans.catalog import table
    docs = table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").drop("toxic")
    runs = os.path.join(tmpdir_path, "experiments")
    r = PL.run(docs, "quality", "docs_quality", runs, work_dir=os.path.join(tmpdir_path, "work"),
               n_trials=2, max_retries=1)
    assert r.facts["task_type"] == "classification"
    assert 0.0 <= r.metrics["accuracy"] <= 1.0 and r.retry_count <= 1
    assert r.report.startswith("# Experiment Report: docs_quality")
    from tessera.sources.experiments import read_experiments
    stored = read_experiments(spark, runs)
    assert stored.count() == 1 and stored.first()["architecture"] == r.architecture
    # a second run of the same dataset finds the first one in memory
    from tessera.operators.memory import find_similar
    assert find_similar(stored, "docs_quality", "classification").count() == 1
