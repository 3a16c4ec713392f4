"""Evaluation aggregations (I1–I9) over ``(label, prediction[, score/probability])``.

Pairs of (true, predicted) classes that occur are counted in one shuffle and
summed per class in a second, small one; only I1 itself builds the full grid.  ROC-AUC
is the Mann–Whitney statistic: counts per distinct score, then exclusive
running totals of negatives laid out by range (``ranks.running_totals``), so
no task ever sorts all scores.  All metrics are rounded to 4 places.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranks

ND = 4


def _cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, count)`` of the pairs that occur, both in one type (double if both
    are numeric, else string); rows without a label are not part of the truth and drop out."""
    types = [df.schema[c].dataType for c in (label, prediction)]
    if types[0] == types[1]:
        common = types[0]
    else:
        common = T.DoubleType() if all(isinstance(t, (T.NumericType, T.BooleanType)) for t in types) else T.StringType()
    return (df.where(F.col(label).isNotNull())
            .groupBy(F.col(label).cast(common).alias("label"), F.col(prediction).cast(common).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("count")))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, count)`` over the union of classes, zero cells kept; rows with a
    null prediction are in no cell.  Classes squared rows by definition, made by Spark."""
    cells = _cells(df, label, prediction).where("prediction IS NOT NULL").persist()
    classes = cells.select(F.explode(F.array("label", "prediction")).alias("label")).distinct()
    grid = classes.crossJoin(classes.withColumnRenamed("label", "prediction"))
    return grid.join(cells, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """I5 rows: ``(class, precision, recall, f1, support)`` — zero division gives 0, a null
    prediction is a miss of its label.  Sums per class straight from the occurring pairs."""
    zero, n = F.lit(0).cast("long"), F.col("count")
    sides = F.array(
        F.struct(F.col("label").alias("class"),
                 F.when(F.col("label") == F.col("prediction"), n).otherwise(zero).alias("tp"),
                 n.alias("support"), zero.alias("predicted")),
        F.struct(F.col("prediction").alias("class"), zero.alias("tp"), zero.alias("support"), n.alias("predicted")))
    t = (_cells(df, label, prediction).select(F.inline(sides)).where(F.col("class").isNotNull())
         .groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    t = t.select("class", p.alias("precision"), r.alias("recall"), "support", "tp")
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(F.lit(0.0))
    return t.select("class", "precision", "recall", f1.alias("f1"), "support", "tp")


def classification_report(df: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg``, ``weighted avg`` (rounded)."""
    pc = per_class(df, label, prediction).cache()
    rows = pc.select(F.col("class").cast("string").alias("row"), "precision", "recall", "f1",
                     F.col("support").cast("long").alias("support"))
    n = F.sum("support")
    macro = pc.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                   n.cast("long").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("row"),
                      (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"),
                      n.cast("long").alias("support"))
    acc = pc.agg(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.sum("tp") / n).alias("f1"),
                 n.cast("long").alias("support"))
    out = rows.unionByName(macro).unionByName(weighted).unionByName(acc)
    return out.select("row", *[F.round(c, ND).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           positive=1) -> DataFrame:
    """One row of accuracy, macro / weighted precision, recall, F1, recall of class 1."""
    pc = per_class(df, label, prediction)
    n = F.sum("support")
    one = pc.agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("precision_weighted"),
        F.avg("recall").alias("recall_macro"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("recall_weighted"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
        F.coalesce(F.max(F.when(F.col("class") == F.lit(positive), F.col("recall"))),
                   F.lit(0.0)).alias("recall_class_1"))
    return one.select(*[F.round(c, ND).alias(c) for c in one.columns])


def _auc_from_counts(g: DataFrame, group_cols: list[str]) -> DataFrame:
    """``g``: (group..., score, pos, neg) with distinct score per group → (group..., auc)."""
    rt = ranks.running_totals(g, group_cols, "score", ["neg"])
    part = rt.groupBy(*group_cols).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return part.select(*group_cols, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                           F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """One row ``roc_auc`` — ties count one half (NULL with a single class)."""
    g = df.groupBy(F.lit(0).alias("_g"), F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == F.lit(positive), 1).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(F.col(label) == F.lit(positive), 0).otherwise(1)).cast("double").alias("neg"))
    return _auc_from_counts(g, ["_g"]).select(F.round("auc", ND).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """Macro one-vs-rest AUC over ``probability`` (vector or array); classes without
    both positives and negatives are left out."""
    dt = df.schema[probability].dataType
    arr = F.col(probability) if isinstance(dt, T.ArrayType) else vector_to_array(F.col(probability))
    # outer: for a plain posexplode the optimizer would filter on the array's size below a
    # repartition, that is, run the model twice
    long = df.select(F.col(label).cast("double").alias("_y"),
                     F.posexplode_outer(arr).alias("k", "score")).where("score IS NOT NULL")
    g = long.groupBy("k", "score").agg(
        F.sum(F.when(F.col("_y") == F.col("k"), 1).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(F.col("_y") == F.col("k"), 0).otherwise(1)).cast("double").alias("neg"))
    per = _auc_from_counts(g, ["k"])
    return per.agg(F.round(F.avg("auc"), ND).alias("roc_auc_ovr"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """I8: one row ``rmse, mae, r2``."""
    e = F.col(prediction).cast("double") - F.col(label).cast("double")
    y = F.col(label).cast("double")
    # total sum of squares = n · population variance (Spark's stable central-moment
    # aggregate): one pass, no scalar subquery over the (possibly non-deterministic) input
    one = df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                 F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).otherwise(
        F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return one.select(F.round("rmse", ND).alias("rmse"), F.round("mae", ND).alias("mae"),
                      F.round(r2, ND).alias("r2"))


def weighted_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    """H4 (classification): weighted F1 as a Python float (one small job)."""
    return float(classification_metrics(df, label, prediction).first()["f1_weighted"])


def r2_score(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    """H4 (regression): R², floored at -1 by the caller."""
    return float(regression_metrics(df, label, prediction).first()["r2"])
