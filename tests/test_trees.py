"""Extra trees and boosting against hand computations of one cut, and their parameters' effects."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tessera.operators import trees as TR
from tessera.operators import models as MD
from tessera.sources.artifacts import load_model, save_model


def frame(spark, x, y, w=None):
    rows = [(i, float(y[i]), float(w[i]) if w is not None else 1.0, [float(v) for v in x[i]]) for i in range(len(x))]
    return (spark.createDataFrame(rows, "_row_id long, label double, weight double, x array<double>")
            .withColumn("features", array_to_vector("x")).repartition(3))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 3)), 1)
    return x, 2 * x[:, 0] - x[:, 1] ** 2 + 0.1 * rng.normal(size=300), rng.integers(1, 4, 300).astype(float)


def best_cut(x, g, h, l2, by=None):
    """Largest gain over all features and values: (feature, value, gain, left leaf, right leaf)."""
    by = h if by is None else by
    best = (-1,)
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            a = x[:, f] <= v
            part = lambda m: g[m].sum() ** 2 / (by[m].sum() + l2)
            gain = part(a) + part(~a) - g.sum() ** 2 / (by.sum() + l2)
            leaf = lambda m: -g[m].sum() / (h[m].sum() + l2)
            if gain > best[0] + 1e-9:
                best = (gain, f, v, leaf(a), leaf(~a))
    return best


def check(tree, start, want, rate, x):
    gain, f, v, left, right = want
    assert tree.feature[0] == f and tree.gain[0] == pytest.approx(gain)
    assert x[x[:, f] <= v, f].max() <= tree.border[0] < x[x[:, f] > v, f].min()
    assert tree.value[1][0] == pytest.approx(rate * left) and tree.value[2][0] == pytest.approx(rate * right)


@pytest.mark.parametrize("l2", [0.0, 5.0])
def test_one_round_of_depth_one_for_squared_error(spark, data, l2):
    x, y, w = data
    m = TR.BoostedTrees("regression", rounds=1, rate=0.3, max_depth=1, l2=l2, bins=250, weight="weight").fit(
        frame(spark, x, y, w))
    mean = (w * y).sum() / w.sum()
    assert m.start == [pytest.approx(mean)]
    check(m.trees[0][0], m.start, best_cut(x, w * (mean - y), w, l2), 0.3, x)


def test_one_round_of_depth_one_for_log_loss(spark, data):
    x, y, _ = data
    y = (y > 0).astype(float)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    for first_order in (False, True):
        m = TR.BoostedTrees("classification", rounds=1, rate=1.0, max_depth=1, l2=0.0, bins=250,
                            first_order=first_order).fit(frame(spark, x, y))
        check(m.trees[0][0], m.start, best_cut(x, g, h, 0.0, np.ones(len(y)) if first_order else None), 1.0, x)


def test_second_round_goes_on_from_the_first(spark, data, monkeypatch):
    monkeypatch.setattr(TR, "ROUNDS_AT_ONCE", 2)
    x, y, _ = data
    m = TR.BoostedTrees("regression", rounds=5, rate=0.5, max_depth=1, bins=250).fit(frame(spark, x, y))
    score = np.full(len(y), y.mean())
    for (tree,) in m.trees:
        check(tree, None, best_cut(x, score - y, np.ones(len(y)), 0.0), 0.5, x)
        score += tree.values(1)[tree.node_of(x, borders=True), 0]
    df = frame(spark, x, y)
    got = {r["_row_id"]: r["prediction"] for r in m.transform(df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], score)
    last = m.staged(df).orderBy("iteration").collect()
    assert len(last) == 5 and last[-1]["loss"] == pytest.approx(((score - y) ** 2).mean())
    assert [r["loss"] for r in last] == sorted([r["loss"] for r in last], reverse=True)


def test_leaf_wise_growth_takes_the_largest_gain_first(spark, data):
    x, y, _ = data
    m = TR.BoostedTrees("regression", rounds=1, rate=1.0, max_depth=30, max_leaves=6, bins=250).fit(frame(spark, x, y))
    tree, score = m.trees[0][0], y - y.mean()
    leaves, cuts = [np.ones(len(y), bool)], []
    for _ in range(5):
        options = [(best_cut(x[a], -score[a], np.ones(a.sum()), 0.0), i) for i, a in enumerate(leaves)]
        (gain, f, v, _, _), i = max(options, key=lambda o: o[0][0])
        a = leaves.pop(i)
        leaves += [a & (x[:, f] <= v), a & (x[:, f] > v)]
        cuts.append(gain)
    own = tree.node_of(x, borders=True)
    assert sorted(g for g, f in zip(tree.gain, tree.feature) if f >= 0) == pytest.approx(sorted(cuts))
    assert sorted((own == n).sum() for n in np.unique(own)) == sorted(a.sum() for a in leaves)
    assert all(tree.values(1)[own[a][0], 0] == pytest.approx(score[a].mean()) for a in leaves)


def test_several_classes_by_softmax(spark, data):
    x, _, _ = data
    y = np.digitize(x[:, 0], [-0.5, 0.5]).astype(float)
    m = TR.BoostedTrees("classification", 3, rounds=8, rate=0.3, max_depth=2).fit(frame(spark, x, y))
    out = m.transform(frame(spark, x, y)).collect()
    assert all(sum(r["probability"]) == pytest.approx(1) and len(r["probability"]) == 3 for r in out)
    assert np.mean([r["prediction"] == r["label"] for r in out]) > 0.95
    assert np.argmax(m.featureImportances.toArray()) == 0


def test_parameters_change_the_model(spark, data):
    x, y, _ = data
    df = frame(spark, x, y)
    fit = lambda a, **hp: MD.build_model(a, {"n_estimators": 3, **hp}, "regression").fit(df)
    leaves = lambda m: [sum(f < 0 and n > 0 for n, f in enumerate(t.feature)) for r in m.trees for t in r]
    value = lambda m: [v for r in m.trees for t in r for v in t.value if v]
    a, b = fit("HistGradientBoostingRegressor"), fit("HistGradientBoostingRegressor", l2_regularization=50.0)
    assert value(a) != value(b) and max(map(abs, sum(value(b), []))) < max(map(abs, sum(value(a), [])))
    reach = lambda m: max(len(np.unique(t.node_of(x, borders=True))) for r in m.trees for t in r)
    assert reach(fit("LightGBMRegressor", num_leaves=3)) == 3 < reach(fit("LightGBMRegressor", num_leaves=8)) <= 8
    assert value(fit("XGBoostRegressor", subsample=0.5)) != value(fit("XGBoostRegressor", subsample=1.0))
    assert leaves(a)


def test_extra_tree_of_depth_one_takes_the_best_of_its_drawn_cuts(spark, data):
    x, y, _ = data
    edges = None
    for task, target in (("regression", y), ("classification", (y > 0).astype(float))):
        df = frame(spark, x, target)
        m = TR.ExtraTrees(task, trees=6, max_depth=1, subset=1.0, bins=250, seed=3).fit(df)
        edges = edges or TR.bin_edges(df, "x", 3, 250)
        g = np.stack([target == c for c in (0, 1)], axis=1).astype(float) if task == "classification" else target[:, None]
        for t, (tree,) in enumerate(m.trees):
            best = (-1,)
            for f in range(3):
                codes = np.searchsorted(edges[f][1:-1], x[:, f], side="left")
                b = TR.random_cuts(edges, 3, np.array([t]), np.array([0]), np.array([f]), codes.min(keepdims=True),
                                   codes.max(keepdims=True))[0]
                a = codes <= b
                part = lambda s: (g[s].sum(axis=0) ** 2).sum() / s.sum()
                best = max(best, (part(a) + part(~a) - part(a | ~a), f, b))
            assert tree.feature[0] == best[1] and tree.bin[0] == best[2] and tree.gain[0] == pytest.approx(best[0])
            side = x[:, best[1]] <= tree.border[0]
            assert tree.value[1] == pytest.approx(g[side].mean(axis=0) / 6)
            assert tree.value[2] == pytest.approx(g[~side].mean(axis=0) / 6)
        assert len({(t[0].feature[0], t[0].bin[0]) for t in m.trees}) > 1


def test_deep_extra_trees_learn_their_rows(spark, data):
    x, y, _ = data
    y = (y > 0).astype(float)
    df = frame(spark, x + np.arange(300)[:, None] * 1e-4, y)
    m = MD.build_model("ExtraTrees", {"n_estimators": 15}, "classification").fit(df)
    out = m.transform(df).collect()
    assert np.mean([r["prediction"] == r["label"] for r in out]) > 0.97


def test_saved_ensemble_scores_alike(spark, data, tmpdir_path):
    x, y, _ = data
    df = frame(spark, x, y)
    m = TR.BoostedTrees("regression", rounds=2, max_depth=2).fit(df)
    save_model(f"{tmpdir_path}/m", m)
    score = lambda model: sorted((r["_row_id"], r["prediction"]) for r in model.transform(df).collect())
    assert score(load_model(f"{tmpdir_path}/m")) == score(m)


def test_several_jobs_and_shuffled_sums_give_the_same_tree(spark, data, monkeypatch):
    x, y, _ = data
    df = frame(spark, x, y)
    plain = TR.BoostedTrees("regression", rounds=1, max_depth=3).fit(df).to_dict()
    same = lambda: TR.BoostedTrees("regression", rounds=1, max_depth=3).fit(df).to_dict()["trees"][0][0]
    for name, value in (("CELLS", 300), ("DRIVER_SUMS", 0)):        # several jobs, then sums added by a shuffle
        monkeypatch.setattr(TR, name, value)
        assert all(same()[c] == plain["trees"][0][0][c] for c in ("feature", "bin", "left"))


def test_few_rows_take_few_short_tasks(spark, monkeypatch):
    """A growing step reads packed rows, and a table of few rows in many parts does not start a task for each."""
    rng, seen = np.random.default_rng(2), []
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(float(a > 0), [float(a), float(b)]) for a, b in x], "label double, x array<double>") \
        .withColumn("features", array_to_vector("x")).repartition(8)
    grow = TR.Grower.grow

    def spy(self, count):
        seen.append((self.tasks, self.rows.count()))
        return grow(self, count)

    monkeypatch.setattr(TR.Grower, "grow", spy)
    model = TR.BoostedTrees("classification", rounds=3, max_depth=2).fit(df)
    assert seen[0][0] == 1 and seen[0][1] <= 8
    assert model.transform(df).where("label = prediction").count() > 380


def test_leaf_wise_growth_takes_about_a_step_a_level(spark, monkeypatch):
    """Leaves are counted ahead by the smallest gain on the way to them, all that the tree may reach at once."""
    rng, steps = np.random.default_rng(8), []
    x = rng.normal(size=(2000, 3))
    cuts = TR.Grower._cuts
    monkeypatch.setattr(TR.Grower, "_cuts", lambda self, trees, nodes: steps.append(len(nodes)) or cuts(self, trees, nodes))
    (tree,), = TR.BoostedTrees("regression", rounds=1, max_depth=30, max_leaves=31, min_leaf=5).fit(
        frame(spark, x, rng.normal(size=2000))).trees
    inner = [n for n, f in enumerate(tree.feature) if f >= 0]
    assert len(inner) == 30
    assert len(steps) <= max(tree.depth[n] for n in inner) + 3


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_rows_of_equal_codes_are_added_once_and_count_each(spark, data, task):
    """Rows that a part holds several times grow the trees of as many rows apart; a step reads each once."""
    x, y, _ = data
    x, y = np.repeat(np.round(x[:40]), 15, axis=0), np.resize(y, 600)
    y = y if task == "regression" else (y > 0).astype(float)
    codes, group = TR.grouped(x.astype(np.int8).view(np.uint8))
    assert len(codes) <= 40 and (codes[group] == x.astype(np.int8).view(np.uint8)).all()
    w = np.random.default_rng(3).integers(1, 4, 600).astype(float)
    m = TR.BoostedTrees(task, rounds=1, rate=1.0, max_depth=1, bins=250, weight="weight").fit(frame(spark, x, y, w))
    p = (w * y).sum() / w.sum()
    g, h = (w * (p - y), w) if task == "regression" else (w * (p - y), w * p * (1 - p))
    check(m.trees[0][0], m.start, best_cut(x, g, h, 0.0), 1.0, x)


def test_rows_that_differ_in_a_late_column_are_not_taken_for_equal():
    codes = np.zeros((100, 20), np.uint8)
    codes[::2, 19] = 1
    one, group = TR.grouped(codes)
    assert len(one) == 2 and (one[group] == codes).all()
    apart = np.arange(100, dtype=np.uint8)[:, None] * np.ones((1, 20), np.uint8)
    assert TR.grouped(apart)[1] is None
