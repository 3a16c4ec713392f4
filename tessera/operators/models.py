"""Model builder (G0–G6, G9–G13): architecture names mapped to ``pyspark.ml`` estimators.

Parameters follow scikit-learn's meaning; where Spark's objective is scaled
differently the mapping converts (``C`` → ``regParam = 1 / (C · Σw)``, ridge
``alpha`` → ``regParam = alpha · sd(y) / n``, elastic net split into L1 / L2).
Boosting names (GradientBoosting, HistGradientBoosting, XGBoost, LightGBM) and
extra trees map to the histogram trees of ``trees.py``: regularised leaves, growth by
depth or by leaves, softmax for several classes, random cuts for extra trees.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import BoostedTrees, ExtraTrees

# The architecture names of the reference (classification, regression).
CLASSIFICATION_MODELS = frozenset({
    "LogisticRegression", "LinearSVC", "DecisionTree", "RandomForest", "ExtraTrees",
    "GradientBoosting", "HistGradientBoosting", "KNN", "GaussianNB", "XGBoost", "LightGBM"})
REGRESSION_MODELS = frozenset({
    "Ridge", "Lasso", "ElasticNet", "DecisionTreeRegressor", "RandomForestRegressor",
    "ExtraTreesRegressor", "GradientBoostingRegressor", "HistGradientBoostingRegressor",
    "KNNRegressor", "XGBoostRegressor", "LightGBMRegressor"})
ARCHITECTURES = CLASSIFICATION_MODELS | REGRESSION_MODELS
BALANCED = frozenset({"LogisticRegression", "LinearSVC", "DecisionTree", "RandomForest",
                      "ExtraTrees", "LightGBM"})
BOOSTERS = frozenset({"GradientBoosting", "HistGradientBoosting", "XGBoost", "LightGBM",
                      "GradientBoostingRegressor", "HistGradientBoostingRegressor",
                      "XGBoostRegressor", "LightGBMRegressor"})

SVC_ITERATIONS, SVC_TOLERANCE = 2000, 1e-4
# Rows of a forest's part (some 320 bytes each with 50 trees).
FOREST_ROWS = 500_000
MAX_DEPTH = 30                # Spark's largest tree depth; "unlimited" depth becomes this


def available_models(task: str) -> list[str]:
    return sorted(CLASSIFICATION_MODELS if task == "classification" else REGRESSION_MODELS)


def balanced_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """``n / (k · n_class)`` per row; the class table (one row per class) is broadcast
    when its counted size is under the bound, shuffle-joined otherwise."""
    from .split import bounded
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = df.agg(F.count(F.lit(1))).scalar()
    k = counts.count()
    w = counts.select(label, (n / (F.lit(k) * F.col("_nc"))).alias(weight))
    return df.join(bounded(w, k), label, "left")


def _depth(hp, default):
    """Tree depth; None or a negative value means no limit, default or searched alike."""
    d = hp.get("max_depth", default)
    if d is None or d < 0:
        d = MAX_DEPTH
    return int(min(max(int(d), 1), MAX_DEPTH))


def _min_inst(hp, default_split=2):
    return max(1, math.ceil(int(hp.get("min_samples_split", default_split)) / 2),
               int(hp.get("min_samples_leaf", 1)))


def _boosting(family: str, hp: dict) -> dict:
    """Parameters of a boosting family in the terms of ``BoostedTrees``; what a search leaves open has the
    default of the family's library (all public)."""
    rounds = {"GradientBoosting": 100, "HistGradientBoosting": 100}.get(family, 200)
    out = dict(rounds=int(hp.get("n_estimators", hp.get("max_iter", rounds))), rate=float(hp.get("learning_rate", 0.1)),
               subsample=float(hp.get("subsample", 1.0 if family == "HistGradientBoosting" else 0.8)),
               colsample=float(hp.get("colsample_bytree", 0.8 if family == "XGBoost" else 1.0)))
    if family == "GradientBoosting":
        return out | dict(max_depth=_depth(hp, 3), first_order=True, min_split=int(hp.get("min_samples_split", 2)))
    if family == "XGBoost":
        return out | dict(max_depth=_depth(hp, 4), l2=float(hp.get("reg_lambda", 1.0)), min_hessian=1.0)
    if family == "LightGBM":
        return out | dict(max_depth=_depth(hp, None), max_leaves=max(2, int(hp.get("num_leaves", 31))), min_leaf=20,
                          l2=float(hp.get("reg_lambda", 0.0)), min_hessian=1e-3)
    return out | dict(max_depth=_depth(hp, None), max_leaves=31, min_leaf=20, l2=float(hp.get("l2_regularization", 0.0)))


def build_model(architecture: str, hyperparams: dict | None, task: str, n_classes: int = 2,
                stats: dict | None = None, features: str = "features", label: str = "label",
                weight: str | None = None, seed: int = 42) -> Estimator:
    """Return an unfitted estimator.  ``stats`` carries ``n``, ``sum_w`` and ``sd_y`` from
    the training rows (needed to translate regularisation strengths)."""
    hp = dict(hyperparams or {})
    stats = stats or {}
    if architecture not in ARCHITECTURES:
        raise ValueError(f"Unknown architecture '{architecture}'. Valid: {sorted(ARCHITECTURES)}")
    common = dict(featuresCol=features, labelCol=label)
    wcol = dict(weightCol=weight) if weight and architecture in BALANCED else {}
    n = max(int(stats.get("n", 1)), 1)
    sum_w = float(stats.get("sum_w", n))
    if architecture == "LogisticRegression":
        c = float(hp.get("C", 1.0))
        return LogisticRegression(regParam=1.0 / (c * sum_w), maxIter=int(hp.get("max_iter", 2000)),
                                  standardization=False, elasticNetParam=0.0, **common, **wcol)
    if architecture == "LinearSVC":
        c = float(hp.get("C", 1.0))
        if n_classes <= 2:
            return CalibratedLinearSVC(1.0 / (c * sum_w), features=features, label=label,
                                       weight=wcol.get("weightCol"))
        return OneVsRest(classifier=LinearSVC(regParam=1.0 / (c * sum_w), maxIter=SVC_ITERATIONS,
                                              tol=SVC_TOLERANCE, standardization=False, **wcol),
                         **common, **wcol)
    if architecture in ("DecisionTree", "DecisionTreeRegressor"):
        cls = DecisionTreeClassifier if task == "classification" else DecisionTreeRegressor
        return cls(maxDepth=_depth(hp, 6), minInstancesPerNode=_min_inst(hp, 5), seed=seed,
                   **common, **wcol)
    if architecture in ("RandomForest", "RandomForestRegressor"):
        cls = RandomForestClassifier if task == "classification" else RandomForestRegressor
        return cls(numTrees=int(hp.get("n_estimators", 200)), maxDepth=_depth(hp, None),
                   minInstancesPerNode=_min_inst(hp), featureSubsetStrategy="sqrt" if task == "classification" else "all",
                   seed=seed, **common, **wcol)
    own = dict(n_classes=n_classes, features=features, label=label, weight=wcol.get("weightCol"), seed=seed)
    if architecture in ("ExtraTrees", "ExtraTreesRegressor"):
        return ExtraTrees(task, trees=int(hp.get("n_estimators", 200)), max_depth=_depth(hp, None),
                          min_split=int(hp.get("min_samples_split", 2)), min_leaf=int(hp.get("min_samples_leaf", 1)),
                          subset=None if task == "classification" else 1.0, **own)
    if architecture in BOOSTERS:
        return BoostedTrees(task, **_boosting(architecture.removesuffix("Regressor"), hp), **own)
    if architecture in ("Ridge", "Lasso", "ElasticNet"):
        sd_y = float(stats.get("sd_y", 1.0) or 1.0)
        alpha = float(hp.get("alpha", 1.0 if architecture == "Ridge" else 0.01))
        if architecture == "Ridge":
            # the normal equations of one pass over the rows (beyond 4096 features Spark iterates)
            return LinearRegression(regParam=alpha * sd_y / n, elasticNetParam=0.0,
                                    standardization=False, solver="auto", maxIter=1000, **common)
        if architecture == "Lasso":
            return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False,
                                    maxIter=int(hp.get("max_iter", 2000)), **common)
        r = float(hp.get("l1_ratio", 0.5))
        l1, l2 = alpha * r, alpha * (1 - r) * sd_y
        return LinearRegression(regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0,
                                standardization=False, solver="l-bfgs", maxIter=2000, **common)
    if architecture == "GaussianNB":
        from .naive_bayes import GaussianNB
        return GaussianNB(var_smoothing=float(hp.get("var_smoothing", 1e-9)), features=features,
                          label=label)
    if architecture in ("KNN", "KNNRegressor"):
        from .neighbors import KNN
        return KNN(k=int(hp.get("n_neighbors", 5)), weights=str(hp.get("weights", "uniform")),
                   task=task, features=features, label=label)
    raise ValueError(architecture)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as hold ``FOREST_ROWS`` rows each, or as it is if it has them: a forest
    keeps every row with its count in every tree and reads them once a level, part by part."""
    parts = math.ceil(df.count() / FOREST_ROWS)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def training_stats(df: DataFrame, label: str = "label", weight: str | None = None) -> dict:
    """n, Σw and sample sd of the label on the training rows (one small job)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.stddev_samp(label).alias("sd_y")]
    if weight:
        aggs.append(F.sum(weight).alias("sum_w"))
    r = df.agg(*aggs).first().asDict()
    r.setdefault("sum_w", r["n"])
    return r


def feature_importances(model, names: list[str], top: int = 20):
    """G13 + C6: ``[(name, importance)]`` sorted descending (None if unavailable)."""
    m = getattr(model, "featureImportances", None)
    if m is None:
        return None
    vals = m.toArray().tolist()
    if len(vals) != len(names):
        return None
    return sorted(zip(names, vals), key=lambda t: (-t[1], t[0]))[:top]


class CalibratedLinearSVC:
    """G2 (binary): linear SVC with 3-fold sigmoid (Platt) calibration.

    Each fold's SVC is fitted on the other folds; a one-feature logistic
    regression maps its margins on the held-out fold to probabilities; the
    final probability is the mean of the fold models' calibrated outputs.
    Folds come from a hash of the row (deterministic, no shuffle).
    """

    def __init__(self, reg_param: float, folds: int = 3, features: str = "features",
                 label: str = "label", weight: str | None = None,
                 max_iter: int = SVC_ITERATIONS, tol: float = SVC_TOLERANCE):
        self.reg_param, self.folds, self.features = reg_param, folds, features
        self.label, self.weight, self.max_iter, self.tol = label, weight, max_iter, tol

    def fit(self, df: DataFrame) -> "CalibratedLinearSVCModel":
        from pyspark.ml.functions import vector_to_array
        from pyspark.ml.feature import VectorAssembler
        fold = F.pmod(F.xxhash64(F.col(self.label), vector_to_array(F.col(self.features))),
                      F.lit(self.folds))
        d = df.withColumn("_fold", fold)

        def one(k):
            kw = dict(weightCol=self.weight) if self.weight else {}
            # tol 1e-4 is scikit-learn's stopping tolerance (Spark's default 1e-6 runs
            # many more passes, each a job over the training rows)
            svc = LinearSVC(regParam=self.reg_param, maxIter=self.max_iter, tol=self.tol,
                            standardization=False, featuresCol=self.features, labelCol=self.label,
                            rawPredictionCol=f"_raw{k}", predictionCol=f"_p{k}", **kw
                            ).fit(d.where(F.col("_fold") != k))
            held = svc.transform(d.where(F.col("_fold") == k)).withColumn(
                "_m", vector_to_array(F.col(f"_raw{k}"))[1])
            held = VectorAssembler(inputCols=["_m"], outputCol="_mv").transform(held)
            platt = LogisticRegression(featuresCol="_mv", labelCol=self.label, regParam=0.0,
                                       maxIter=100).fit(held)
            return svc, float(platt.coefficients[0]), float(platt.intercept)

        # the folds are independent fits: run them as concurrent Spark jobs
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=self.folds) as pool:
            parts = list(pool.map(one, range(self.folds)))
        return CalibratedLinearSVCModel(parts, self.features)


class CalibratedLinearSVCModel:
    def __init__(self, parts, features: str = "features"):
        self.parts, self.features = parts, features

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        out = df
        probs = []
        for k, (svc, a, b) in enumerate(self.parts):
            out = svc.transform(out)
            m = vector_to_array(F.col(f"_raw{k}"))[1]
            probs.append(1.0 / (1.0 + F.exp(-(F.lit(a) * m + F.lit(b)))))
            out = out.withColumn(f"_c{k}", probs[-1])
        p1 = sum((F.col(f"_c{k}") for k in range(len(self.parts))), F.lit(0.0)) / len(self.parts)
        out = out.withColumn("_p1", p1)
        out = out.withColumn("probability", array_to_vector(F.array(1 - F.col("_p1"), F.col("_p1")))) \
                 .withColumn("prediction", (F.col("_p1") > 0.5).cast("double"))
        drop = [c for c in out.columns if c.startswith(("_raw", "_p", "_c")) and c not in df.columns]
        return out.drop(*drop)
