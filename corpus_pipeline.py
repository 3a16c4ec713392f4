"""The corpus pipeline: stages of corpus operators, each written and read again.

Every stage takes all that its predecessor kept; all but the last return the
columns of ``documents``.  ``n_chars`` follows the text where a stage shortens it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import byte_bpe, mixing, ngram_jaccard, substring_dedup, weak_quality
from tessera.llm.store import written
from tessera.session import ship_package


def stage(fn):
    """A stage whose Python workers have the package."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, docs, sf_dir)
    run_stage.__doc__, run_stage.__name__ = fn.__doc__, fn.__name__
    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier rejects go."""
    return weak_quality.keep_good(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return ngram_jaccard.keep_one(docs)


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents stay in one document."""
    left = substring_dedup.remove_repeats(docs)
    if "n_chars" in left.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left, checked by decoding: digests of ids and bytes."""
    return byte_bpe.round_trip(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies),
          ("substring dedup", repeats), ("mixing sources to target weights", mixed),
          ("byte-level BPE encoding and decoding", encoded)]

#: No SQL form: the stages train a model and search near duplicates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES:
        docs = written(apply(spark, docs, sf_dir), "stage")
    return docs
