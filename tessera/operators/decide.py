"""Decision rules (J1–J11) as Column expressions over a ``runs`` table.

The reference applies these rules to one run at a time; here they are columns,
so any number of runs is judged in one projection (no shuffle).  Expected
input columns: ``architecture, task_type, train_score, val_score`` plus metric
columns ``accuracy, f1_weighted, roc_auc, r2`` (NULL when absent) and a
``hyperparams map<string,string>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (rules of the reference):
#   overfit gap threshold: name contains Forest or Trees 0.35; Boosting, XGBoost or
#   LightGBM 0.20; DecisionTree 0.25; anything else 0.15
#   classification passes with accuracy >= 0.70 or weighted F1 >= 0.70 or ROC-AUC >= 0.75,
#   and no overfitting; regression passes with R2 >= 0.75, or R2 >= 0.60 without overfitting
#   critic: start 8.0, minus 1.5 for overfitting, minus 1.5 for not passing; regression with
#   R2 >= 0.75 is approved with score at least 7.5; otherwise approved iff score >= 6.5,
#   passed and not overfitting
#   search budget: 10 trials / 1 retry; any approved similar run -> 5 trials; >= 2 failed
#   similar runs -> 2 retries; clamp 5..50 trials, 1..5 retries; retry trials max(5, n // 2)
#   model choice without history: < 1000 rows -> XGBoost (RandomForest when absent),
#   else LightGBM (HistGradientBoosting when absent), with Regressor names for regression
FOREST_KEYS = ("Forest", "Trees")
BOOST_KEYS = ("Boosting", "XGBoost", "LightGBM")
THRESH_FOREST, THRESH_BOOST, THRESH_TREE, THRESH_OTHER = 0.35, 0.20, 0.25, 0.15
CLASS_ACC, CLASS_F1, CLASS_AUC = 0.70, 0.70, 0.75
REG_STRONG, REG_OK = 0.75, 0.60
SCORE_START, SCORE_PENALTY, SCORE_APPROVE, SCORE_REG_FLOOR = 8.0, 1.5, 6.5, 7.5


def _has(arch: Column, keys) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | arch.contains(k)
    return out


def overfit_threshold(arch: Column) -> Column:
    """J1."""
    return (F.when(_has(arch, FOREST_KEYS), F.lit(THRESH_FOREST))
            .when(_has(arch, BOOST_KEYS), F.lit(THRESH_BOOST))
            .when(arch.contains("DecisionTree"), F.lit(THRESH_TREE))
            .otherwise(F.lit(THRESH_OTHER)))


def family(arch: Column) -> Column:
    return (F.when(_has(arch, FOREST_KEYS), F.lit("forest"))
            .when(_has(arch, BOOST_KEYS), F.lit("boosting"))
            .when(arch.contains("DecisionTree"), F.lit("tree"))
            .otherwise(F.lit("other")))


def _hp(name: str, default: float) -> Column:
    return F.coalesce(F.col("hyperparams").getItem(name).try_cast("double"), F.lit(float(default)))


def judge(runs: DataFrame) -> DataFrame:
    """Adds threshold, gap, flags, critic score, approval, suggestions."""
    arch = F.col("architecture")
    gap = F.round(F.col("train_score") - F.col("val_score"), 4)
    out = runs.withColumn("threshold", overfit_threshold(arch)) \
              .withColumn("overfit_gap", gap) \
              .withColumn("is_overfit", F.col("overfit_gap") > F.col("threshold"))
    is_reg = F.col("task_type") == "regression"
    r2 = F.coalesce(F.col("r2"), F.lit(0.0))
    class_ok = ((F.coalesce(F.col("accuracy"), F.lit(0.0)) >= CLASS_ACC)
                | (F.coalesce(F.col("f1_weighted"), F.lit(0.0)) >= CLASS_F1)
                | (F.coalesce(F.col("roc_auc"), F.lit(0.0)) >= CLASS_AUC))
    passed = (F.when(is_reg, F.when(r2 >= REG_STRONG, F.lit(True))
                     .when(r2 >= REG_OK, ~F.col("is_overfit")).otherwise(F.lit(False)))
              .otherwise(class_ok & ~F.col("is_overfit")))
    out = out.withColumn("passed", passed)
    raw = (F.lit(SCORE_START) - F.when(F.col("is_overfit"), SCORE_PENALTY).otherwise(0.0)
           - F.when(~F.col("passed"), SCORE_PENALTY).otherwise(0.0))
    strong = is_reg & (r2 >= REG_STRONG)
    score = F.when(strong, F.greatest(raw, F.lit(SCORE_REG_FLOOR))).otherwise(raw)
    out = out.withColumn("critic_score", F.greatest(F.round(score, 2), F.lit(0.0)))
    out = out.withColumn("approved", F.when(strong, F.lit(True)).otherwise(
        (score >= SCORE_APPROVE) & F.col("passed") & ~F.col("is_overfit")))
    fam = family(arch)
    forest_s = F.col("is_overfit") & (fam == "forest")
    boost_s = F.col("is_overfit") & (fam == "boosting")
    out = (out
           .withColumn("suggest_max_depth",
                       F.when(forest_s, F.greatest(F.lit(3.0), _hp("max_depth", 10) - 3))
                       .when(boost_s, F.greatest(F.lit(2.0), _hp("max_depth", 4) - 1)))
           .withColumn("suggest_min_samples_split",
                       F.when(forest_s, _hp("min_samples_split", 2) + 3))
           .withColumn("suggest_min_samples_leaf",
                       F.when(forest_s, _hp("min_samples_leaf", 1) + 1))
           .withColumn("suggest_learning_rate",
                       F.when(boost_s, F.round(_hp("learning_rate", 0.1) * 0.7, 4))))
    strategy = (F.when(forest_s, F.lit("Constrain tree depth and increase min samples."))
                .when(boost_s, F.lit("Lower learning rate and reduce depth."))
                .when(~F.col("passed"), F.lit("Increase model capacity."))
                .otherwise(F.lit("")))
    out = out.withColumn("retry_strategy", F.when(strong, F.lit("")).otherwise(strategy))
    if "retry_count" in runs.columns and "max_retries" in runs.columns:
        out = out.withColumn("should_retry", ~F.col("approved")
                             & (F.col("retry_count") < F.col("max_retries")))
    return out


def retry_params(runs: DataFrame) -> DataFrame:
    """Fallback hyper-parameters for a retry when nothing was suggested."""
    arch = F.col("architecture")
    fam = family(arch)
    of = F.col("is_overfit")
    return (runs
            .withColumn("retry_max_depth",
                        F.when(of & (fam == "forest"), F.greatest(F.lit(3.0), _hp("max_depth", 10) - 3))
                        .when(of & (fam == "boosting"), F.greatest(F.lit(2.0), _hp("max_depth", 4) - 1)))
            .withColumn("retry_min_samples_split",
                        F.when(of & (fam == "forest"), F.least(F.lit(10.0), _hp("min_samples_split", 2) + 2)))
            .withColumn("retry_min_samples_leaf",
                        F.when(of & (fam == "forest"), F.least(F.lit(5.0), _hp("min_samples_leaf", 1) + 1)))
            .withColumn("retry_n_estimators",
                        F.when(~of & (fam == "forest"), F.least(F.lit(500.0), _hp("n_estimators", 200) + 100))
                        .when(~of & (fam == "boosting"), F.least(F.lit(500.0), _hp("n_estimators", 100) + 100)))
            .withColumn("retry_learning_rate",
                        F.when(of & (fam == "boosting"), F.round(_hp("learning_rate", 0.1) * 0.7, 4))
                        .when(~of & (fam == "boosting"), F.round(_hp("learning_rate", 0.1) * 0.8, 4))))


def search_budget(similar: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Per query ``(n_approved, n_failed, optuna_trials, max_retries)`` from similar runs."""
    group_cols = group_cols or []
    agg = similar.groupBy(*group_cols).agg(
        F.count_if(F.col("approved")).alias("n_approved"),
        F.count_if(~F.col("approved")).alias("n_failed"))
    trials = F.when(F.col("n_approved") > 0, F.lit(5)).otherwise(F.lit(10))
    retries = F.when(F.col("n_failed") >= 2, F.lit(2)).otherwise(F.lit(1))
    return agg.select(*group_cols, "n_approved", "n_failed",
                      F.least(F.greatest(trials, F.lit(5)), F.lit(50)).alias("optuna_trials"),
                      F.least(F.greatest(retries, F.lit(1)), F.lit(5)).alias("max_retries"))


def retry_trials(n_trials: Column) -> Column:
    """J10 on a retry: max(5, n // 2)."""
    return F.greatest(F.lit(5), F.floor(n_trials / 2).cast("int"))


def default_architecture(task: Column, n_samples: Column, xgboost: bool = False,
                         lightgbm: bool = False) -> Column:
    """J11 without history (Spark: the boosted-tree and forest families, G4/G6)."""
    small_c = F.lit("XGBoost" if xgboost else "RandomForest")
    big_c = F.lit("LightGBM" if lightgbm else "HistGradientBoosting")
    small_r = F.lit("XGBoostRegressor" if xgboost else "RandomForestRegressor")
    big_r = F.lit("LightGBMRegressor" if lightgbm else "HistGradientBoostingRegressor")
    return (F.when(task == "classification", F.when(n_samples < 1000, small_c).otherwise(big_c))
            .otherwise(F.when(n_samples < 1000, small_r).otherwise(big_r)))


def evaluation_findings(runs: DataFrame) -> DataFrame:
    """``strengths`` and ``critical_failures`` arrays and the ``interpretation`` sentence."""
    is_reg = F.col("task_type") == "regression"
    acc = F.coalesce(F.col("accuracy"), F.lit(0.0))
    f1 = F.coalesce(F.col("f1_weighted"), F.lit(0.0))
    auc = F.coalesce(F.col("roc_auc"), F.lit(0.0))
    rec = F.coalesce(F.col("recall_class_1"), F.lit(0.0)) if "recall_class_1" in runs.columns \
        else F.lit(0.0)
    r2 = F.coalesce(F.col("r2"), F.lit(0.0))
    dec = lambda x, n: F.round(x, n).cast(f"decimal(18,{n})").cast("string")  # noqa: E731  half up
    pct1 = lambda x: F.concat(dec(x.cast("decimal(18,6)") * 100, 1), F.lit("%"))
    n2 = lambda x: dec(x.cast("decimal(18,6)"), 2)
    extra = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in runs.columns else F.lit(0.0)
    # The wording of strengths, failures and the interpretation.
    ends = F.concat(F.when(F.col("is_overfit"), F.lit(" Overfitting detected.")).otherwise(F.lit("")),
                    F.when(F.col("passed"), F.lit(" Passed threshold.")).otherwise(F.lit(" Did not pass threshold.")))
    said = F.when(is_reg, F.concat(F.lit("Regression model: R2="), n2(r2), F.lit(", RMSE="), n2(extra("rmse")),
                                   F.lit(", MAE="), n2(extra("mae")), F.lit("."), ends)).otherwise(
        F.concat(F.lit("Model achieved "), pct1(acc), F.lit(" accuracy and "), n2(f1), F.lit(" weighted F1."),
                 F.when(auc != 0, F.concat(F.lit(" ROC-AUC="), n2(auc), F.lit("."))).otherwise(F.lit("")), ends))
    cs = F.array(
        F.when(acc >= 0.75, F.concat(F.lit("Accuracy "), pct1(acc), F.lit(" is above 75% baseline."))),
        F.when(f1 >= 0.70, F.concat(F.lit("Weighted F1 "), n2(f1), F.lit(" shows balanced class performance."))),
        F.when(auc >= 0.80, F.concat(F.lit("ROC-AUC "), n2(auc), F.lit(" shows strong discrimination ability."))))
    cf = F.array(
        F.when(rec < 0.60, F.concat(F.lit("Recall on positive class is "), pct1(rec),
                                    F.lit(" — many true positives are being missed."))),
        F.when(F.col("is_overfit"), F.lit("Train/val score gap exceeds threshold — model may not generalise well.")),
        F.when(~F.col("passed"), F.lit("Model did not meet minimum quality threshold.")))
    rs = F.array(
        F.when(r2 >= 0.75, F.concat(F.lit("R2="), n2(r2), F.lit(" indicates strong predictive power.")))
        .when(r2 >= 0.50, F.concat(F.lit("R2="), n2(r2), F.lit(" is acceptable with room to improve."))))
    rf = F.array(
        F.when(r2 < 0.50, F.concat(F.lit("R2="), n2(r2), F.lit(" is below acceptable threshold of 0.50."))),
        F.when(F.col("is_overfit"), F.lit("Train/val score gap exceeds model-specific threshold.")))
    nn = lambda a: F.filter(a, lambda x: x.isNotNull())
    return runs.withColumn("interpretation", said) \
               .withColumn("strengths", F.when(is_reg, nn(rs)).otherwise(nn(cs))) \
               .withColumn("critical_failures", F.when(is_reg, nn(rf)).otherwise(nn(cf)))
