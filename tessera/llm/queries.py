"""Registered queries of the corpus operators and their DuckDB SQL.

Each query reads its whole table and applies one operator with production
parameters; nothing is limited, sampled or filtered by id here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (byte_bpe, embedding_dedup, lexical_search, license_scan, line_rules, merkle, mixing,
                         ngram_jaccard, shuffle_shards, substring_dedup, token_counts, vantage, weak_quality)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class, group and number of links of every document."""
    found = ngram_jaccard.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "class_id", "component_id", "n_links", "kept")


@query()
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that the paragraphs of every document grant."""
    return license_scan.scan(documents(spark, sf_dir))


@query()
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with cosine of 0.98 or more inside a label."""
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query(mixing.SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, repeats counted."""
    return mixing.mix_table(documents(spark, sf_dir))


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, by a run that starts an empty cache."""
    return token_counts.count_tokens(documents(spark, sf_dir))


@query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the scorer that weak labels have trained."""
    return weak_quality.classify(documents(spark, sf_dir))


@query(line_rules.SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict of line-first cleaning."""
    return line_rules.quality_table(documents(spark, sf_dir))


@query()
def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot after the external shuffle."""
    return shuffle_shards.shard_table(documents(spark, sf_dir))


@query()
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents: place, kept occurrence, removal."""
    return substring_dedup.repeats(documents(spark, sf_dir)).drop("key")


@query()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the public rank file and decoded again, as digests."""
    return byte_bpe.round_trip(documents(spark, sf_dir))


@query(lexical_search.SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item by integer impact scores."""
    return lexical_search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query(vantage.SQL)
def op12_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, by inner product."""
    return vantage.nearest_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query(merkle.SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the check that finds tampered rows."""
    return merkle.manifest_table(documents(spark, sf_dir))
