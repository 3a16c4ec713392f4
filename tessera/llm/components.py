"""Connected components by alternating large-star and small-star rounds.

Every round is a few joins and aggregations on the edge table; the table is
checkpointed to the shared folder after each round, so lineage stays short and
a lost executor costs one round.  Edges and components never reach the driver,
only two sums that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.session import ensure_checkpoint_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (edges.join(least, "u").where("v <> m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that has an edge; the root is the smallest node.

    Null ends and loops are ignored; repeated edges count once.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    work = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct())
    before = None
    while True:
        work = _small_star(_large_star(work)).checkpoint()
        now = work.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return (work.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(work.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
