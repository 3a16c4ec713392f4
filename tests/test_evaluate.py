"""I1–I8 hand cases."""
from tessera.operators import evaluate as EV


def test_auc_hand_cases(spark):
    a = spark.createDataFrame([(0, .1), (0, .4), (1, .35), (1, .8)], "label int, score double")
    b = spark.createDataFrame([(0, .5), (1, .5), (0, .2), (1, .9)], "label int, score double")
    assert EV.roc_auc(a).first()["roc_auc"] == 0.75
    assert EV.roc_auc(b).first()["roc_auc"] == 0.875


def test_never_predicted_class_counts_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (2, 2)], "label int, prediction int")
    pc = {r["class"]: r for r in EV.per_class(df).collect()}
    assert pc[1]["precision"] == 0.0 and pc[1]["f1"] == 0.0
    m = EV.classification_metrics(df).first()
    # macro averages include the never-predicted class
    assert m["precision_macro"] == round((0.5 + 0.0 + 1.0) / 3, 4)
    assert m["recall_class_1"] == 0.0


def test_confusion_zero_cells(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, prediction string")
    cells = {(r["label"], r["prediction"]): r["count"] for r in EV.confusion_counts(df).collect()}
    assert cells == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 0}


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "label double, prediction double")
    r = EV.regression_metrics(df).first()
    assert r["rmse"] == round((1 / 3) ** 0.5, 4) and r["mae"] == round(1 / 3, 4) and r["r2"] == 0.5


def test_auc_invariant_to_monotone_transform(spark):
    import random
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), rnd.random()) for _ in range(500)]
    a = spark.createDataFrame(rows, "label int, score double")
    b = spark.createDataFrame([(y, s ** 3 * 10) for y, s in rows], "label int, score double")
    assert EV.roc_auc(a).first()["roc_auc"] == EV.roc_auc(b).first()["roc_auc"]


def test_r2_matches_numpy(spark):
    import numpy as np
    rnd = np.random.default_rng(1)
    y = rnd.normal(1e5, 3e4, size=500)
    p = y + rnd.normal(0, 1e4, size=500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "label double, prediction double")
    r = EV.regression_metrics(df).first()
    want = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(r["r2"] - round(want, EV.ND)) < 1e-9
    assert abs(r["rmse"] - round(float(np.sqrt(((y - p) ** 2).mean())), EV.ND)) < 1e-6


def test_mixed_types_nulls_and_many_classes(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0), (1, 1.0), (1, None), (None, 1.0)], "label int, prediction double")
    m = EV.classification_metrics(df).first()
    assert m["accuracy"] == 0.5 and m["recall_class_1"] == round(1 / 3, 4)
    many = spark.range(20000).selectExpr("id % 10000 AS label", "(id + (id % 2)) % 10000 AS prediction")
    assert EV.classification_metrics(many).first()["accuracy"] == 0.5
