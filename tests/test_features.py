"""F1–F9 hand cases (FIXTURES.md §3 F) and split properties."""
import pytest
from pyspark.sql import functions as F

from tessera.operators import features as FT
from tessera.operators import split as SP


def test_frequency_encoding(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    val = spark.createDataFrame([("c",), ("a",), (None,)], "c string")
    t = FT.frequency_table(train, "c")
    got = {r["value"]: round(r["share"], 4) for r in t.collect()}
    assert got == {"a": 0.6667, "b": 0.3333}
    enc = FT.apply_frequency(val, "c", t, 2, "f").collect()
    assert sorted((r["c"] or "", round(r["f"], 4)) for r in enc) == [("", 0.0), ("a", 0.6667), ("c", 0.0)]


def test_scale_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0, "x"), (2.0, 5.0, "y"), (3.0, 5.0, "z")], "a double, k double, t string")
    fitted = FT.FeaturePipeline(target="t").fit(df)
    assert fitted.stds["k"] == 0.0
    rows = fitted.transform(df).select("a", "features").orderBy("a").collect()
    assert [round(r["features"][0], 6) for r in rows] == [-1.224745, 0.0, 1.224745]
    assert all(r["features"][1] == 0.0 for r in rows)


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",)], "c string")
    assert FT.column_modes(df, ["c"]) == {"c": "a"}


def test_one_hot_unseen_is_zero(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, y double")
    fitted = FT.FeaturePipeline(target="y").fit(train)
    assert fitted.categories["c"] == ["a", "b"]
    val = spark.createDataFrame([("z", 0.0)], "c string, y double")
    assert list(fitted.transform(val).first()["features"]) == [0.0, 0.0]


def test_median_impute(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "c"), (10.0, "d")], "x double, t string")
    fitted = FT.FeaturePipeline(target="t").fit(df)
    assert fitted.medians["x"] == 3.0


def test_stratified_quota_hand_case(spark):
    df = spark.createDataFrame([(i, "A" if i < 7 else "B") for i in range(10)], "k int, y string")
    s = SP.stratified_split(df, "y", ["k"])
    got = {r["y"]: r["n"] for r in s.where("split = 'val'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got == {"A": 1, "B": 1}


@pytest.mark.parametrize("exact", [True, False])
def test_split_disjoint_complete_and_stratified(spark, exact):
    df = spark.createDataFrame([(i, i % 3) for i in range(3000)], "k long, y int")
    s = SP.stratified_split(df, "y", ["k"], exact=exact).cache()
    assert s.count() == 3000 and s.select("k").distinct().count() == 3000
    if exact:
        per = {r["y"]: r["n"] for r in s.where("split='val'").groupBy("y").agg(F.count("*").alias("n")).collect()}
        assert per == {0: 200, 1: 200, 2: 200}
    else:
        share = s.where("split='val'").count() / 3000
        assert 0.15 < share < 0.25


def test_split_quotas_match_sklearn_allocation(spark):
    def quotas(counts):
        return dict(map(tuple, SP.split_quotas(spark.createDataFrame(list(counts.items()), "_g string, n long")).collect()))
    assert quotas({"A": 7, "B": 3}) == {"A": 1, "B": 1}
    assert sum(quotas({"x": 5, "y": 5, "z": 5}).values()) == 3


def test_label_encoding_numeric_order(spark):
    df = spark.createDataFrame([(10,), (2,), (1,), (2,)], "y int")
    _, classes = SP.encode_labels(df, "y")
    assert [(r["class"], r["index"]) for r in classes.orderBy("index").collect()] == \
        [(1, 0.0), (2, 1.0), (10, 2.0)]


def test_pipeline_save_load_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([(f"{i}GB", "abc"[i % 3], f"city{i % 20}", "red apple pie now" if i % 2 else None,
                                 float(i)) for i in range(40)], "ram string, c string, city string, txt string, y double")
    df = df.withColumn("_row_id", SP.row_hash(df.columns))
    fitted = FT.FeaturePipeline(target="y").fit(df)
    assert fitted.routes == {"ram": "numeric_text", "c": "one_hot", "city": "frequency", "txt": "text"}
    fitted.save(f"{tmpdir_path}/fp")
    back = FT.FittedFeatures.load(spark, f"{tmpdir_path}/fp")
    a = {r["_row_id"]: list(r["features"]) for r in fitted.transform(df).collect()}
    b = {r["_row_id"]: list(r["features"]) for r in back.transform(df).collect()}
    assert a == b and len(fitted.feature_names()) == len(next(iter(a.values())))


def test_unseen_label_raises(spark):
    train = spark.createDataFrame([("a",), ("b",)], "y string")
    _, classes = SP.encode_labels(train, "y")
    ok = SP.apply_labels(spark.createDataFrame([("b",)], "y string"), "y", classes)
    assert ok.first()["label"] == 1.0
    with pytest.raises(ValueError):
        SP.apply_labels(spark.createDataFrame([("z",)], "y string"), "y", classes)


def test_label_index_above_class_bound_equals_small_path(spark, monkeypatch):
    """F1 / C8 / G0 with more classes than the broadcast bound: shuffle joins and the
    distributed running count give the same indices and weights."""
    from tessera.operators import models as MD
    from tessera.operators import split as SPL
    df = spark.createDataFrame([(f"c{i % 37:02d}", i) for i in range(300)], "y string, v int")
    small, cls_small = SPL.encode_labels(df, "y")
    w_small = {r["y"]: r["weight"] for r in MD.balanced_weights(small, "y").collect()}
    monkeypatch.setattr(SPL, "CLASS_TABLE_MAX_ROWS", 5)
    big, cls_big = SPL.encode_labels(df, "y")
    assert sorted(map(tuple, cls_big.collect())) == sorted(map(tuple, cls_small.collect()))
    assert sorted(map(tuple, big.collect())) == sorted(map(tuple, small.collect()))
    assert SPL.unseen_labels(df, "y", cls_big) == 0
    w_big = {r["y"]: r["weight"] for r in MD.balanced_weights(big, "y").collect()}
    assert w_big == w_small
    assert sorted(r["index"] for r in cls_big.collect()) == [float(i) for i in range(37)]


def test_hash_cuts_equal_sorting(spark, monkeypatch):
    """Boundaries of any size, a null class and repeated hashes."""
    monkeypatch.setattr(SP, "BOUNDARY_ROWS", 3)
    monkeypatch.setattr(SP, "DIGITS", 1)
    df = (spark.range(3000).withColumn("c", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
          .withColumn("h", F.md5((F.col("id") % 2900).cast("string"))))
    quotas = spark.createDataFrame([(None, 1), (1, 137), (2, 999)], "_g long, quota long")
    got = {r["_cg"]: r["_t"] for r in SP.hash_cuts(df, "c", "h", quotas).collect()}
    rows = {}
    for r in df.collect():
        rows.setdefault(r["c"], []).append(r["h"])
    assert got == {c: sorted(rows[c])[q - 1] for c, q in [(None, 1), (1, 137), (2, 999)]}
    same = df.withColumn("h", F.md5(F.lit("x")))
    assert SP.hash_cuts(same, "c", "h", quotas).select("_t").distinct().count() == 1


def test_quotas_of_many_classes_need_no_single_window(spark, monkeypatch):
    counts = spark.createDataFrame([(i, 2 + i * 7 % 11) for i in range(200)], "_g long, n long")
    plain = {tuple(r) for r in SP.split_quotas(counts, classes=200).collect()}
    monkeypatch.setattr(SP, "CLASS_TABLE_MAX_ROWS", 10)
    assert {tuple(r) for r in SP.split_quotas(counts, classes=200).collect()} == plain


def test_frequency_join_of_a_large_map_spares_hot_values(spark, monkeypatch):
    """A value with a third of all rows, nulls and unseen values: same result, hot rows not shuffled."""
    train = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 1500))
                                     .alias("c"))
    rows = train.unionByName(spark.createDataFrame([(None,), ("new",)] * 50, "c string"))
    t = FT.frequency_table(train, "c")
    result = lambda: sorted((r["c"] or "", r["f"]) for r in FT.apply_frequency(rows, "c", t, 1501, "f").collect())
    plain = result()
    monkeypatch.setattr(FT, "BROADCAST_MAX_ROWS", 10)
    assert result() == plain and len(plain) == 6100
    monkeypatch.setattr(FT, "HEAVY_SHARE", 0.3)
    assert result() == plain
    plan = FT.apply_frequency(rows, "c", t, 1501, "f")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3      # heavy values twice (settled or not), light ones once
