"""G0, G7, G8, G9 against closed forms / brute force."""
import math
import random

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import models as MD
from tessera.operators.naive_bayes import GaussianNB
from tessera.operators.neighbors import KNN


def _data(spark, n=300, d=4, seed=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    rows = [(i, float(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label double, x array<double>")
    return df.withColumn("features", array_to_vector("x")), x, y


def test_gaussian_nb_matches_numpy(spark):
    df, x, y = _data(spark)
    pred = {r["id"]: r["prediction"] for r in GaussianNB().fit(df).transform(df).collect()}
    eps = 1e-9 * x.var(axis=0).max()
    jll = []
    for c in (0.0, 1.0):
        xc = x[y == c]
        mu, var = xc.mean(axis=0), xc.var(axis=0) + eps
        jll.append(math.log(len(xc) / len(x)) - 0.5 * np.log(2 * np.pi * var).sum()
                   - 0.5 * (((x - mu) ** 2) / var).sum(axis=1))
    want = np.argmax(np.stack(jll, axis=1), axis=1).astype(float)
    assert all(pred[i] == want[i] for i in range(len(x)))


def test_knn_matches_brute_force(spark):
    df, x, y = _data(spark, n=200)
    train, query = df.where("id >= 50"), df.where("id < 50")
    got = {r["id"]: r["prediction"] for r in KNN(k=5, row_id="id").fit(train).predict(query, "id").collect()}
    xt, yt = x[50:], y[50:]
    for i in range(50):
        d = np.sqrt(((xt - x[i]) ** 2).sum(axis=1))
        nn = np.lexsort((np.arange(len(d)), d))[:5]
        votes = {}
        for j in nn:
            votes[yt[j]] = votes.get(yt[j], 0) + 1
        best = sorted(votes.items(), key=lambda t: (-t[1], t[0]))[0][0]
        assert got[i] == best


def test_ridge_equals_closed_form(spark):
    rnd = random.Random(4)
    rows = [(rnd.uniform(0, 10), rnd.uniform(-1, 1)) for _ in range(200)]
    ys = [3 * a - 2 * b + 1 + rnd.gauss(0, 0.5) for a, b in rows]
    df = spark.createDataFrame([(a, b, y) for (a, b), y in zip(rows, ys)], "a double, b double, label double")
    df = df.withColumn("features", array_to_vector(F.array("a", "b")))
    st = MD.training_stats(df)
    m = MD.build_model("Ridge", {"alpha": 1.0}, "regression", stats=st).fit(df)
    X = np.array(rows)
    Y = np.array(ys)
    Xc, Yc = X - X.mean(axis=0), Y - Y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(2), Xc.T @ Yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-3)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0.0,)] * 8 + [(1.0,)] * 2, "label double")
    w = {r["label"]: round(r["weight"], 4) for r in MD.balanced_weights(df).distinct().collect()}
    assert w == {0.0: 0.625, 1.0: 2.5}


def test_unknown_architecture_raises(spark):
    import pytest
    with pytest.raises(ValueError):
        MD.build_model("Nope", {}, "classification")


def test_calibrated_svc_probabilities(spark):
    df, x, y = _data(spark, n=400)
    m = MD.build_model("LinearSVC", {"C": 1.0}, "classification", n_classes=2,
                       stats={"n": 400, "sum_w": 400}).fit(df)
    out = m.transform(df).select("label", "prediction", "probability").collect()
    acc = sum(r["label"] == r["prediction"] for r in out) / len(out)
    assert acc > 0.85
    assert all(abs(sum(r["probability"]) - 1.0) < 1e-9 and 0 <= r["probability"][1] <= 1 for r in out)


def test_knn_many_blocks_matches_single_block(spark, monkeypatch):
    from tessera.operators import neighbors as NB
    df, x, y = _data(spark, n=200, seed=5)
    train, query = df.where("id >= 60"), df.where("id < 60")
    one = {r["id"]: r["prediction"] for r in KNN(k=3, row_id="id", weights="distance").fit(train)
           .predict(query, "id").collect()}
    monkeypatch.setattr(NB, "BLOCK_ROWS", 25)      # 6 x 3 block pairs
    many = {r["id"]: r["prediction"] for r in KNN(k=3, row_id="id", weights="distance").fit(train)
            .predict(query, "id").collect()}
    assert one == many and len(one) == 60


def test_every_family_fits_and_scores(spark):
    """Every classification architecture learns a separable rule."""
    from tessera.operators import search as SR
    df, _, _ = _data(spark, n=400, d=3, seed=3)
    df = df.withColumn("_row_id", F.col("id"))
    stats = MD.training_stats(df)
    for a in sorted(MD.CLASSIFICATION_MODELS):
        m = SR.fit(a, {"n_estimators": 10, "max_depth": 4}, "classification", df, 2, stats, None)
        assert SR.score_model(m, df, "classification") > 0.8, a


def test_regression_families_fit(spark):
    """Linear target, every non-KNN regressor reaches R² > 0.8 on train."""
    from tessera.operators import search as SR
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.1 * rnd.normal(size=400)
    rows = [(i, float(y[i]), [float(v) for v in x[i]]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label double, x array<double>") \
        .withColumn("features", array_to_vector("x"))
    stats = MD.training_stats(df)
    for a in sorted(MD.REGRESSION_MODELS - {"KNNRegressor"}):
        m = SR.fit(a, {"n_estimators": 20, "max_depth": 6, "alpha": 0.01}, "regression", df, 0,
                   stats, None)
        assert SR.score_model(m, df, "regression") > 0.8, a


def test_knn_ties_zero_distances_and_repeated_ids(spark):
    import pytest
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 16)) * 100
    train = [(i, float(i), base[i % 40].tolist()) for i in range(200)]          # five equal rows each
    df = spark.createDataFrame(train, "id long, label double, x array<double>").withColumn("features", array_to_vector("x"))
    q = spark.createDataFrame([(i, base[i].tolist()) for i in range(40)], "q long, x array<double>") \
        .withColumn("features", array_to_vector("x"))
    model = KNN(k=3, row_id="id", task="regression", weights="distance").fit(df)
    got = {}
    for r in model.neighbours(q, "q").collect():
        got.setdefault(r["q"], []).append((r["rank"], r["neighbor"], r["distance"]))
    assert all(sorted(v) == [(1, k, 0.0), (2, k + 40, 0.0), (3, k + 80, 0.0)] for k, v in got.items())
    assert {r["q"]: r["prediction"] for r in model.predict(q, "q").collect()} == {k: k + 40.0 for k in range(40)}
    with pytest.raises(ValueError):
        model.neighbours(q.unionByName(q), "q")


def test_weights_reach_one_vs_rest_and_unlimited_depth(spark):
    svc = MD.build_model("LinearSVC", {}, "classification", n_classes=3, weight="weight")
    assert svc.getWeightCol() == "weight" and svc.getClassifier().getMaxIter() == 2000
    lgbm = [MD.build_model("LightGBMRegressor", hp, "regression") for hp in ({}, {"max_depth": -1, "num_leaves": 9})]
    assert [(m.max_depth, m.max_leaves) for m in lgbm] == [(MD.MAX_DEPTH, 31), (MD.MAX_DEPTH, 9)]
    assert MD.build_model("RandomForest", {}, "classification").getMaxDepth() == MD.MAX_DEPTH


def test_search_raises_the_error_of_a_trial(spark):
    import pytest

    from tessera.operators import search as SR
    df, _, _ = _data(spark, n=60)
    with pytest.raises(Exception):
        SR.run_search(df, df.drop("features"), "Ridge", "regression", 2)


def test_pivot_blocks_give_the_exact_neighbours_and_skip_pairs(spark, monkeypatch):
    """Clustered rows, copies of one row for a third, ties; regression and distance weights."""
    from tessera.operators import neighbors as NB
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(8, 5)) * 20
    x = np.round(centre[rng.integers(8, size=600)] + rng.normal(size=(600, 5)), 1)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, float(i % 17), x[i].tolist()) for i in range(600)],
                               "id long, label double, x array<double>").withColumn("features", array_to_vector("x"))
    train, query = df.where("id >= 90"), df.where("id < 90")
    for weights in ("uniform", "distance"):
        for task in ("regression", "classification"):
            model = KNN(k=4, row_id="id", task=task, weights=weights).fit(train)
            want = {r["id"]: r["prediction"] for r in model.predict(query, "id").collect()}
            monkeypatch.setattr(NB, "BLOCK_ROWS", 40)
            got = {r["id"]: r["prediction"] for r in model.predict(query, "id").collect()}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
            pairs, searched = model.pairs
            assert searched < 0.6 * pairs
            monkeypatch.undo()
    monkeypatch.setattr(NB, "BLOCK_ROWS", 40)
    near = {(r["id"], r["rank"]): (r["neighbor"], r["distance"]) for r in model.neighbours(query, "id").collect()}
    for i in range(90):
        d = np.sqrt(((x[90:] - x[i]) ** 2).sum(axis=1))
        best = np.lexsort((np.arange(len(d)), d))[:4]
        assert [near[i, n + 1] for n in range(4)] == [(b + 90, d[b]) for b in best]


def test_knn_block_holds_a_bounded_part_of_the_distances():
    """a task held 1024 x 20,000 distances several times over."""
    import tracemalloc

    import pandas as pd
    from tessera.operators import neighbors as NB
    x = np.random.default_rng(1).normal(size=(6000, 4))
    q = pd.DataFrame({"_qid": range(1500), "_qx": list(x[:1500])})
    t = pd.DataFrame({"_tid": range(6000), "_tx": list(x), "_ty": 1.0})
    tracemalloc.start()
    out = NB._block_topk(3)(q, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 4500 and (out["_qid"][::3] == out["_tid"][::3]).all()
    assert peak < 6 * 8 * NB.CELLS


def test_ridge_takes_one_pass():
    """F8: every candidate iterated over the rows until it converged."""
    assert MD.build_model("Ridge", {"alpha": 2.0}, "regression", stats={"n": 10, "sd_y": 2.0}).getSolver() == "auto"


def test_forest_parts_grow_with_the_rows(spark, monkeypatch):
    """a forest's largest task read a part of the table that grew with it."""
    monkeypatch.setattr(MD, "FOREST_ROWS", 50)
    df = spark.range(400).coalesce(1)
    assert MD.dealt(df).rdd.getNumPartitions() == 8
    assert MD.dealt(df.limit(40)).rdd.getNumPartitions() == 1


def test_knn_skips_cells_of_a_block_and_finds_the_same_rows():
    """Queries are held against few of a block's rows, with ties by the smallest id; evenly spread rows are all searched."""
    import pandas as pd
    from tessera.operators import neighbors as NB
    rng = np.random.default_rng(11)
    grid = lambda n: np.c_[rng.integers(0, 50, n), rng.integers(0, 10, n) / 100, rng.integers(0, 7, n)].astype(float)
    ball = lambda n: rng.normal(size=(n, 24))
    for make, share in ((grid, 0.2), (ball, 1.0)):
        t, q, ids = make(3000), make(200), rng.permutation(3000)
        pairs = [(b, rows) for b, rows in NB._cells(t, q, 4)]
        assert sorted(np.concatenate([b for b, _ in pairs]).tolist()) == list(range(200))
        assert sum(len(b) * len(rows) for b, rows in pairs) <= share * 200 * 3000
        got = NB._block_topk(4)(pd.DataFrame({"_qid": np.arange(200), "_qx": list(q)}),
                                pd.DataFrame({"_tid": ids, "_tx": list(t), "_ty": ids * 1.0}))
        found = {i: (g["_tid"].tolist(), g["_d"].tolist()) for i, g in got.groupby("_qid")}
        for i in range(200):
            d = np.sqrt(((t - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids, d))[:4]
            assert found[i] == (ids[best].tolist(), d[best].tolist())
