"""J and K rules (FIXTURES.md §3 J, K)."""
from tessera.operators import decide as DC
from tessera.operators import memory as MM

SCHEMA = ("architecture string, task_type string, train_score double, val_score double, accuracy double, "
          "f1_weighted double, roc_auc double, r2 double, hyperparams map<string,string>")


def _judge(spark, rows):
    return {r["architecture"]: r for r in DC.judge(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_rule_cases(spark):
    rows = [
        ("RandomForest", "classification", 0.95, 0.65, 0.8, 0.8, None, None, {}),
        ("Ridge", "regression", 1.10, 0.80, None, None, None, 0.80, {}),
        ("XGBoost", "classification", 1.15, 0.90, 0.9, 0.9, None, None,
         {"learning_rate": "0.1", "max_depth": "4"}),
        ("Lasso", "regression", 0.56, 0.55, None, None, None, 0.55, {}),
    ]
    j = _judge(spark, rows)
    assert not j["RandomForest"]["is_overfit"] and j["RandomForest"]["threshold"] == 0.35
    r = j["Ridge"]
    assert r["is_overfit"] and r["passed"] and r["approved"] and r["critic_score"] >= 7.5
    b = j["XGBoost"]
    assert b["is_overfit"] and not b["passed"] and b["critic_score"] == 5.0 and not b["approved"]
    assert b["suggest_learning_rate"] == 0.07 and b["suggest_max_depth"] == 3.0
    assert not j["Lasso"]["passed"]


def test_thresholds_by_family(spark):
    from pyspark.sql import functions as F
    names = ["ExtraTreesRegressor", "HistGradientBoosting", "DecisionTreeRegressor", "KNN", "LightGBMRegressor"]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    got = {r[0]: r[1] for r in df.select("a", DC.overfit_threshold(F.col("a"))).collect()}
    assert got == {"ExtraTreesRegressor": 0.35, "HistGradientBoosting": 0.20, "DecisionTreeRegressor": 0.25,
                   "KNN": 0.15, "LightGBMRegressor": 0.20}


def test_retry_fallback(spark):
    rows = [("RandomForestRegressor", "regression", 0.5, 0.4, None, None, None, 0.4,
             {"n_estimators": "450"})]
    j = DC.retry_params(DC.judge(spark.createDataFrame(rows, SCHEMA))).first()
    assert not j["is_overfit"] and j["retry_n_estimators"] == 500.0


def test_similarity_cases(spark):
    from datetime import datetime
    runs = spark.createDataFrame(
        [("r1", datetime(2024, 1, 1), "heart_disease", "classification", True),
         ("r2", datetime(2024, 1, 2), "wine", "classification", False),
         ("r3", datetime(2024, 1, 3), "wine", "regression", False)],
        "run_id string, created_at timestamp, dataset_name string, task_type string, approved boolean")
    sim = {r["run_id"]: r["similarity"] for r in
           runs.select("run_id", MM.similarity("heart_disease_data", "classification").alias("similarity")).collect()}
    assert sim == {"r1": 8.0, "r2": 3.0, "r3": 0.0}
    top = MM.find_similar(runs, "heart_disease_data", "classification").orderBy("similar_rank").collect()
    assert [r["run_id"] for r in top] == ["r1", "r2"]
    budget = DC.search_budget(MM.find_similar(runs, "heart_disease_data", "classification")).first()
    assert budget["optuna_trials"] == 5 and budget["max_retries"] == 1


def test_similar_runs_of_many_datasets_equal_one_at_a_time(spark):
    """Names inside names, shorter than a letter group, equal, empty and null; ties by age."""
    import random

    from tessera.operators import memory as MM
    rnd = random.Random(3)
    names = ["heart", "heart_v2", "Heart ", "art", "he", "h", "", None, "titanic", "titan", "iris", "xxheartxx", "x"]
    rows = [(f"r{i:03}", rnd.choice(names), rnd.choice(["classification", "regression", None]), i // 3) for i in range(150)]
    runs = spark.createDataFrame(rows, "run_id string, dataset_name string, task_type string, created_at int")
    asked = [(n, t) for n in ["heart", "HEART_V2_new", "ti", "t", "zz", "", "x heart"] for t in ("classification", None)]
    got = {}
    datasets = spark.createDataFrame(asked, "dataset_name string, task_type string")
    many = MM.find_similar_many(runs, datasets)
    for r in many.collect():
        got.setdefault((r["new_name"], r["new_task"]), []).append((r["similar_rank"], r["run_id"], r["similarity"]))
    for name, task in asked:
        one = [(r["similar_rank"], r["run_id"], r["similarity"])
               for r in MM.find_similar(runs, name, task if task else "no such task").collect()]
        assert sorted(got.get((name, task), [])) == sorted(one), (name, task)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CartesianProduct" not in many._jdf.queryExecution().executedPlan().toString()
