"""E1–E16 against FIXTURES.md §3 E and brute-force checks."""
import random

from pyspark.sql import functions as F

from tessera.operators import profile as P


def test_profile_hand_case(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 3.0, 4.0, 100.0, None]], "x double")
    r = P.profile_columns(df).first()
    assert (r["n_missing"], r["missing_pct"], r["n_unique"], r["unique_pct"]) == (1, 16.67, 5, 83.33)
    assert (r["mean"], r["std"], r["min"], r["p25"], r["median"], r["p75"], r["max"]) == \
        (22.0, 43.6177, 1.0, 2.0, 3.0, 4.0, 100.0)
    assert (r["outlier_lower_bound"], r["outlier_upper_bound"]) == (-1.0, 7.0)
    assert (r["outlier_count"], r["outlier_pct"]) == (1, 16.67)


def test_task_type_threshold(spark):
    reg = spark.createDataFrame([(i % 21,) for i in range(1000)], "t int")
    cls = spark.createDataFrame([(i % 20,) for i in range(1000)], "t int")
    assert P.task_type(reg, "t").first()["task_type"] == "regression"
    assert P.task_type(cls, "t").first()["task_type"] == "classification"


def test_imbalance_threshold(spark):
    a = spark.createDataFrame([(1 if i < 80 else 0,) for i in range(100)], "y int")
    b = spark.createDataFrame([(1 if i < 81 else 0,) for i in range(100)], "y int")
    ra, rb = P.imbalance(a, "y").first(), P.imbalance(b, "y").first()
    assert ra["ratio"] == 0.25 and not ra["is_imbalanced"]
    assert rb["is_imbalanced"]


def test_quartiles_with_hot_value_match_numpy(spark):
    import numpy as np
    rnd = random.Random(7)
    xs = [5.0] * 3000 + [rnd.uniform(-100, 100) for _ in range(6000)]   # a third is one value
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(6)
    r = P.profile_columns(df).first()
    for q, k in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")):
        assert r[k] == round(float(np.quantile(xs, q)), 4)
    assert r["n_unique"] == len(set(xs))


def test_top_values_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaaccddeeffz"], "c string")
    tv = P.profile_columns(df).first()["top_values"]
    assert [t["value"] for t in tv] == ["a", "b", "c", "d", "e"]


def test_duplicates_and_totals(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, v string")
    d = P.dataset_totals(df).first()
    assert (d["n_rows"], d["n_duplicates"], d["total_missing"]) == (5, 2, 2)
    assert d["duplicate_pct"] == 40.0 and d["total_missing_pct"] == 20.0


def test_word_count_and_text_flag(spark):
    df = spark.createDataFrame([("one two three four five",), ("a b",), (None,)], "t string")
    r = P.avg_word_counts(df).first()
    assert r["avg_words"] == 3.5 and not r["is_text"]


def test_sketched_quartiles_cover_converted_columns(spark):
    from pyspark.sql import functions as F

    from tessera.operators import profile as P
    df = spark.range(1, 401).select(F.concat(F.col("id").cast("string"), F.lit("GB")).alias("ram"))
    for frame in (df, df.withColumn("x", F.length("ram") * 1.0)):
        a, b = (P.profile_columns(frame, exact=e).where("column = 'ram'").first() for e in (True, False))
        assert a["is_converted"] and b["is_converted"]
        assert all(abs(a[c] - b[c]) <= 1 for c in ("q25", "median", "q75", "mean") if c in a.asDict())
        assert a["outlier_count"] == b["outlier_count"]
