"""Hyper-parameter search (H1–H7).

The search space is a small table; candidates are drawn with seeded md5
uniforms (a projection over ``spark.range(n_trials)``), so a search is
reproducible.  Trials are fitted concurrently from a driver thread pool on the
one persisted prepared table (each fit is itself a distributed Spark job, as
``TrainValidationSplit(parallelism=…)`` does).  Scores: weighted F1
(classification) or R² floored at -1 (regression), on the validation rows.
"""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import evaluate as EV
from . import models as MD

# The reference's search space per architecture.
# (param, kind, low, high, choices); kind: int | float | logfloat | choice
_TREE = [("max_depth", "int", 2, 12, None), ("min_samples_split", "int", 2, 20, None)]
_FOREST = [("n_estimators", "int", 50, 400, None), ("max_depth", "int", 3, 20, None),
           ("min_samples_split", "int", 2, 10, None)]
_GB = [("n_estimators", "int", 50, 300, None), ("learning_rate", "logfloat", 0.01, 0.3, None),
       ("max_depth", "int", 2, 8, None), ("subsample", "float", 0.6, 1.0, None)]
_HIST = [("max_iter", "int", 50, 300, None), ("learning_rate", "logfloat", 0.01, 0.3, None),
         ("max_depth", "int", 2, 10, None), ("l2_regularization", "float", 0.0, 1.0, None)]
_XGB = [("n_estimators", "int", 50, 400, None), ("learning_rate", "logfloat", 0.01, 0.3, None),
        ("max_depth", "int", 2, 8, None), ("subsample", "float", 0.6, 1.0, None),
        ("colsample_bytree", "float", 0.6, 1.0, None)]
_LGBM = [("n_estimators", "int", 50, 400, None), ("learning_rate", "logfloat", 0.01, 0.3, None),
         ("max_depth", "int", -1, 12, None), ("num_leaves", "int", 15, 127, None),
         ("subsample", "float", 0.6, 1.0, None)]
_KNN = [("n_neighbors", "int", 2, 20, None), ("weights", "choice", None, None, ["uniform", "distance"])]
SEARCH_SPACE = {
    "LogisticRegression": [("C", "logfloat", 0.01, 10.0, None)],
    "LinearSVC": [("C", "logfloat", 0.01, 10.0, None)],
    "DecisionTree": _TREE, "DecisionTreeRegressor": _TREE,
    "RandomForest": _FOREST, "ExtraTrees": _FOREST,
    "RandomForestRegressor": _FOREST, "ExtraTreesRegressor": _FOREST,
    "GradientBoosting": _GB, "GradientBoostingRegressor": _GB,
    "HistGradientBoosting": _HIST, "HistGradientBoostingRegressor": _HIST,
    "XGBoost": _XGB, "XGBoostRegressor": _XGB,
    "LightGBM": _LGBM, "LightGBMRegressor": _LGBM,
    "KNN": _KNN, "KNNRegressor": _KNN,
    "GaussianNB": [("var_smoothing", "logfloat", 1e-12, 1e-6, None)],
    "Ridge": [("alpha", "logfloat", 0.001, 100.0, None)],
    "Lasso": [("alpha", "logfloat", 0.0001, 1.0, None)],
    "ElasticNet": [("alpha", "logfloat", 0.0001, 1.0, None), ("l1_ratio", "float", 0.1, 0.9, None)],
}
SEARCH_SCHEMA = ("architecture string, param string, kind string, low double, high double, "
                 "choices array<string>")


def search_space(spark: SparkSession) -> DataFrame:
    """H1: ``(architecture, param, kind, low, high, choices)``."""
    rows = [(a, p, k, None if lo is None else float(lo), None if hi is None else float(hi), ch)
            for a, ps in sorted(SEARCH_SPACE.items()) for p, k, lo, hi, ch in ps]
    return spark.createDataFrame(rows, SEARCH_SCHEMA)


def draw_candidates(spark: SparkSession, architecture: str, n_trials: int, seed: int = 42,
                    narrow: dict | None = None) -> DataFrame:
    """H2: ``(trial, param, value)`` — seeded uniforms, log scale where asked.

    ``narrow`` caps upper bounds (decision S7: a critic's suggestion narrows the space).
    """
    narrow = narrow or {}
    params = SEARCH_SPACE.get(architecture, [])
    trials = spark.range(n_trials).withColumnRenamed("id", "trial")
    cols = []
    for p, kind, lo, hi, ch in params:
        if p in narrow and hi is not None:
            hi = max(lo, min(hi, narrow[p]))
        u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("trial").cast("string"),
                                                  F.lit(p), F.lit(str(seed)))), 1, 8), 16, 10)
             .cast("double") / float(2 ** 32))
        if kind == "int":
            v = F.floor(F.lit(lo) + u * (hi - lo + 1)).cast("long").cast("string")
        elif kind == "float":
            v = (F.lit(float(lo)) + u * float(hi - lo)).cast("string")
        elif kind == "logfloat":
            v = F.exp(F.lit(math.log(lo)) + u * (math.log(hi) - math.log(lo))).cast("string")
        else:
            v = F.element_at(F.array(*[F.lit(c) for c in ch]), (F.floor(u * len(ch)) + 1).cast("int"))
        cols.append(F.struct(F.lit(p).alias("param"), v.alias("value")))
    if not cols:
        return trials.select("trial", F.lit(None).cast("string").alias("param"),
                             F.lit(None).cast("string").alias("value")).where("false")
    return trials.select("trial", F.inline(F.array(*cols)))


def _parse(v: str):
    try:
        f = float(v)
        return int(f) if f.is_integer() and "." not in v and "e" not in v.lower() else f
    except (TypeError, ValueError):
        return v


def candidates(spark: SparkSession, architecture: str, n_trials: int, seed: int = 42,
               narrow: dict | None = None) -> list[dict]:
    rows = draw_candidates(spark, architecture, n_trials, seed, narrow).collect()   # <= 50 x params
    out: dict = {}
    for r in rows:
        out.setdefault(r["trial"], {})[r["param"]] = _parse(r["value"])
    return [out.get(i, {}) for i in range(n_trials)]


def score_model(model, df: DataFrame, task: str, label: str = "label") -> float:
    """H4: weighted F1, or R² floored at -1."""
    pred = predictions(model, df)
    if task == "classification":
        return EV.weighted_f1(pred, label, "prediction")
    return max(EV.r2_score(pred, label, "prediction"), -1.0)


def predictions(model, df: DataFrame) -> DataFrame:
    if hasattr(model, "predict") and not hasattr(model, "transform"):
        return model.predict(df)
    if model.__class__.__name__ == "KNNModel":
        return model.transform(df, "_row_id")
    return model.transform(df)


def fit(architecture: str, hp: dict, task: str, train: DataFrame, n_classes: int, stats: dict,
        weight: str | None):
    est = MD.build_model(architecture, hp, task, n_classes=n_classes, stats=stats, weight=weight)
    return est.fit(MD.dealt(train) if "RandomForest" in architecture else train)


def run_search(train: DataFrame, val: DataFrame, architecture: str, task: str, n_trials: int,
               base_params: dict | None = None, n_classes: int = 2, weight: str | None = None,
               seed: int = 42, parallelism: int = 4, narrow: dict | None = None):
    """H3: fit and score every candidate; returns ``(trials DataFrame, best params)``.
    An error of a trial ends the search with that error."""
    spark = train.sparkSession
    stats = MD.training_stats(train, weight=weight)
    cands = candidates(spark, architecture, n_trials, seed, narrow)

    def one(i_hp):
        i, hp = i_hp
        params = {**(base_params or {}), **hp}
        t0 = time.time()
        m = fit(architecture, params, task, train, n_classes, stats, weight)
        return i, params, score_model(m, val, task), time.time() - t0

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        res = list(pool.map(one, enumerate(cands)))
    rows = [(i, {k: str(v) for k, v in p.items()}, s, t) for i, p, s, t in res]
    trials = spark.createDataFrame(rows, "trial long, params map<string,string>, score double, "
                                         "seconds double")
    best = max(res, key=lambda r: (r[2], -r[0]))[1] if res else {}
    searched = [p[0] for p in SEARCH_SPACE.get(architecture, [])]
    return trials, {k: best[k] for k in searched if k in best}


def trial_table(trials: DataFrame) -> DataFrame:
    """H6: trials with the running best score (bounded by the trial count)."""
    w = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best_so_far", F.max("score").over(w))


def curves(spark: SparkSession, train_score: float, val_score: float) -> DataFrame:
    """H7: single-point loss and score curves ``(step, train_loss, val_loss, train_score, val_score)``."""
    return spark.createDataFrame([(0, 1 - train_score, 1 - val_score, train_score, val_score)],
                                 "step int, train_loss double, val_loss double, "
                                 "train_score double, val_score double")


def boosting_curves(model, train: DataFrame, val: DataFrame, label: str = "label") -> DataFrame:
    """H7 for boosting: ``(step, train_loss, val_loss, train_score, val_score)`` after every round, one
    pass over either table (log loss and accuracy, or squared error and R²)."""
    side = lambda df, name: model.staged(df, label).select(
        F.col("iteration").alias("step"), F.col("loss").alias(f"{name}_loss"), F.col("score").alias(f"{name}_score"))
    return side(train, "train").join(side(val, "val"), "step").select(
        "step", "train_loss", "val_loss", "train_score", "val_score")
