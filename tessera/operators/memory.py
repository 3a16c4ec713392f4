"""Experiment-memory queries (K1–K5, C5) over the ``experiment`` table.

One current dataset is scored against every past run with a projection (no
join); the ``n`` most similar runs are a salted top-k, so a table where one
dataset name holds a third of all runs still never sorts in one task.  Many new
datasets at once find the past names that contain theirs, or lie in them, through
an inverted index of letter groups (no theta join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import ranks

# Same name +10, one name inside the other +5, same task +3;
# keep runs scoring >= 3, the 3 best (score desc, oldest first).
SAME_NAME, PART_NAME, SAME_TASK = 10.0, 5.0, 3.0
MIN_SCORE, TOP_N = 3.0, 3


def similarity(dataset_name: str | Column, task_type: str | Column | None) -> Column:
    """K1: similarity of each past run to the current dataset (names lower/trimmed)."""
    cur = F.lower(F.trim(F.lit(dataset_name) if isinstance(dataset_name, str) else dataset_name))
    past = F.lower(F.trim(F.coalesce(F.col("dataset_name"), F.lit(""))))
    name = (F.when(past == cur, F.lit(SAME_NAME))
            .when((past != "") & (cur != "")
                  & (cur.contains(past) | past.contains(cur)), F.lit(PART_NAME))
            .otherwise(F.lit(0.0)))
    if task_type is None:
        return name
    t = F.lit(task_type) if isinstance(task_type, str) else task_type
    return name + F.when(F.col("task_type") == t, F.lit(SAME_TASK)).otherwise(F.lit(0.0))


def find_similar(runs: DataFrame, dataset_name: str, task_type: str | None,
                 n: int = TOP_N, min_score: float = MIN_SCORE) -> DataFrame:
    """K2: the ``n`` most similar runs (score >= min_score), score desc then oldest first."""
    scored = runs.withColumn("similarity", similarity(dataset_name, task_type)) \
                 .where(F.col("similarity") >= min_score)
    total = runs.count()
    order = [F.desc("similarity"), F.asc("created_at"), F.asc("run_id")]
    return ranks.top_k(scored.withColumn("_q", F.lit(0)), ["_q"], order, n,
                       max_group_rows=total, rank_col="similar_rank").drop("_q")


GRAM = 3


def _name(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def _grams(names: DataFrame, sizes) -> DataFrame:
    """``(name, gram)``: all groups of the given numbers of letters in each name."""
    def of_size(q: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("name") - q + 1)
        return F.when(F.length("name") >= q, F.transform(starts, lambda i: F.substring("name", i, F.lit(q)))).otherwise(
            F.array().cast("array<string>"))
    parts = [of_size(q) for q in sizes]
    return names.select("name", F.explode(F.array_distinct(F.concat(*parts))).alias("gram"))


def contained_names(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``(inner, outer)``: pairs of names (distinct, not empty) of which one lies in the other.

    A name can only lie in those that hold each of its groups of ``GRAM`` letters (itself, if it
    is shorter), so it looks up the rarest of them in the index of the others and is compared
    with what it finds."""
    index = _grams(outer, range(1, GRAM + 1))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    own = _grams(inner.where(F.length("name") >= GRAM), [GRAM]).unionByName(
        inner.where((F.length("name") < GRAM) & (F.length("name") > 0)).select("name", F.col("name").alias("gram")))
    rarest = (own.join(often, "gram", "left").groupBy("name")
              .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("r"))
              .where("r.often > 0").select(F.col("name").alias("inner"), F.col("r.gram").alias("gram")))
    found = rarest.join(index.withColumnRenamed("name", "outer"), "gram")
    return found.where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def find_similar_many(runs: DataFrame, datasets: DataFrame, n: int = TOP_N, min_score: float = MIN_SCORE) -> DataFrame:
    """K2 for every row of ``datasets`` (``dataset_name``, ``task_type``) at once: the columns of ``runs`` with
    ``new_name``, ``new_task``, ``similarity`` and ``similar_rank``.

    Only the ``n`` oldest runs of each past name and task can be chosen, and of the runs of
    unrelated names only the ``n`` oldest of the task; so a popular name or task adds ``n`` rows."""
    ensure_checkpoint_dir(runs.sparkSession)
    rows = runs.count()
    past = ranks.top_k(runs.withColumns({"_name": _name("dataset_name"), "_task": F.col("task_type")}), ["_name", "_task"],
                       [F.asc("created_at"), F.asc("run_id")], n, max_group_rows=rows, rank_col="_r").drop("_r").checkpoint()
    wanted = datasets.select(F.col("dataset_name").alias("new_name"), F.col("task_type").alias("new_task"),
                             _name("dataset_name").alias("_new")).distinct().checkpoint()
    new_names, names = (df.select(F.col(c).alias("name")).distinct() for df, c in ((wanted, "_new"), (past, "_name")))
    same = new_names.join(names, "name").select(F.col("name").alias("_new"), F.col("name").alias("_name"),
                                                F.lit(SAME_NAME).alias("_score"))
    part = contained_names(new_names, names).select(F.col("inner").alias("_new"), F.col("outer").alias("_name")).unionByName(
        contained_names(names, new_names).select(F.col("outer").alias("_new"), F.col("inner").alias("_name")))
    part = part.where("_new <> _name").distinct().withColumn("_score", F.lit(PART_NAME))
    by_name = wanted.join(same.unionByName(part), "_new").join(past, "_name")
    oldest = ranks.top_k(past, ["_task"], [F.asc("created_at"), F.asc("run_id")], n, max_group_rows=rows, rank_col="_r")
    # the same run may come by its name as well; its largest score counts
    by_task = (wanted.join(oldest.drop("_r"), F.col("new_task") == F.col("_task")).withColumn("_score", F.lit(0.0)))
    scored = by_name.unionByName(by_task).withColumn("similarity", F.col("_score") + F.when(
        F.col("_task") == F.col("new_task"), F.lit(SAME_TASK)).otherwise(F.lit(0.0)))
    keys = ["new_name", "new_task", "run_id"]
    best = Window.partitionBy(*keys).orderBy(F.desc("similarity"))
    scored = scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").where(F.col("similarity") >= min_score)
    out = ranks.top_k(scored, ["new_name", "new_task"], [F.desc("similarity"), F.asc("created_at"), F.asc("run_id")], n,
                      rank_col="similar_rank")
    return out.select("new_name", "new_task", *runs.columns, "similarity", "similar_rank")


def metric_key() -> Column:
    """accuracy if non-zero, else R² (the reference's ``or`` fallback)."""
    acc = F.col("metrics").getItem("accuracy")
    r2 = F.col("metrics").getItem("r2")
    return F.coalesce(F.when(acc != 0, acc), r2, F.lit(0.0))


def best_past_run(similar: DataFrame, dataset_name: str) -> DataFrame:
    """K3: among similar runs, those on the same dataset (else the approved ones),
    the one with the best accuracy / R² (earliest on ties)."""
    same = F.lower(F.col("dataset_name")) == dataset_name.lower()
    flagged = similar.withColumn("_same", same).withColumn("_key", metric_key())
    has_same = flagged.where("_same").limit(1).count() > 0
    pool = flagged.where("_same") if has_same else flagged.where(F.col("approved"))
    return (pool.orderBy(F.desc("_key"), F.asc("created_at"), F.asc("run_id")).limit(1)
            .drop("_same", "_key"))


def past_summary(runs: DataFrame) -> DataFrame:
    """K4: the projection used for planning and model selection."""
    return runs.select("dataset_name", "task_type", "architecture", "approved", "critic_score",
                       "metrics", "hyperparams")


def latest(runs: DataFrame, n: int = 5) -> DataFrame:
    """Newest ``n`` runs first (distributed top-k)."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)
