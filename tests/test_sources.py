"""A1–A8, A10–A12 with the CSV / JSONL fixtures of FIXTURES.md §4."""
import json
import os

from tessera.sources import csv as CS
from tessera.sources import experiments as EX

UTF8 = """id,ram,weight,layout,area,city,sku,review,price,sold_on,active,target
1,8GB,1.5 kg,2 BHK,1000-1500,Pune,A1,great value for the money here,100.5,2020-01-05,True,1
2,16GB,2.0 kg,3 BHK,2000-3000,Delhi,A2,bad screen and very slow machine,200,2021-02-03,False,0
3,4 GB,NA,2 BHK,10-20,Mumbai,A3,works fine most of the time,N/A,2020-03-01,True,1
4,,1.1 kg,4 BHK,500-700,Pune,A4,would not buy this again ever,150,2020-04-01,False,0
5,512MB,0.9 kg,1 BHK,100-200,Delhi,A5,excellent battery life and display,120,2020-05-01,True,1
6,8GB,1.2 kg,2 BHK,300-400,Goa,A6,average product for the price,130,2020-06-01,False,0
7,32GB,2.2 kg,5 BHK,900-1000,Pune,A7,fast delivery and nice packing,300,2020-07-01,True,1
8,8GB,1.4 kg,2 BHK,200-300,Delhi,A8,screen cracked after one week,110,2020-08-01,False,0
9,16GB,1.6 kg,3 BHK,400-500,Goa,A9,value for money laptop overall,160,2020-09-01,True,1
10,4GB,1.0 kg,1 BHK,600-700,Pune,A10,not good not bad just okay,90,2020-10-01,False,0
11,8GB,1.3 kg,2 BHK,700-800,Mumbai,A11,best purchase i made this year,140,2020-11-01,True,1
12,16GB,1.8 kg,3 BHK,800-900,Delhi,A12,keyboard stopped working quickly,170,2020-12-01,False,0
"""


def _write(path, text, enc="utf-8"):
    with open(path, "w", encoding=enc) as f:
        f.write(text)
    return path


def test_csv_types_and_na_tokens(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "utf8.csv"), UTF8)
    df = CS.read_csv(spark, p)
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["price"] == "double" and types["active"] == "boolean"
    assert types["ram"] == "string" and types["target"] == "bigint"
    assert df.where("weight is null").count() == 1 and df.where("price is null").count() == 1
    assert df.where("ram is null").count() == 1
    assert CS.get_columns(spark, p)[:3] == ["id", "ram", "weight"]
    v = CS.validate_dataset(df, "target").first()
    assert v["is_valid"] and v["message"] == "Valid dataset: 12 rows, 12 columns."
    assert not CS.validate_dataset(df, "nope").first()["is_valid"]
    assert CS.preview(df).count() == 10


def test_latin1_and_short(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "latin1.csv"), "a,b\ncafé,1\n", enc="iso-8859-1")
    assert CS.detect_encoding(spark, p) == "ISO-8859-1"
    assert CS.read_csv(spark, p).first()["a"] == "café"
    s = _write(os.path.join(tmpdir_path, "short.csv"), "x,target\n" + "".join(f"{i},{i % 2}\n" for i in range(9)))
    v = CS.validate_dataset(CS.read_csv(spark, s), "target").first()
    assert not v["is_valid"] and v["message"] == "Dataset too small: only 9 rows."


def test_experiment_table_roundtrip(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "exp")
    assert EX.read_experiments(spark, path).count() == 0
    for i in range(4):
        EX.append_experiments(EX.experiment_row(spark, {
            "dataset_name": f"d{i}", "task_type": "classification", "architecture": "RandomForest",
            "hyperparams": {"max_depth": 5}, "metrics": {"accuracy": 0.8}, "approved": i % 2 == 0,
            "run_id": f"r{i}", "planner_flags": [], "analyst_risks": ["x"]}), path)
    # one broken line is skipped, the good rows stay
    with open(os.path.join(path, "part-extra.json"), "w") as f:
        f.write('{"dataset_name": "d9", "task_type": "regression", "approved": false}\n{broken\n')
    got = EX.read_experiments(spark, path)
    assert got.count() == 5 and got.where("approved").count() == 2
    EX.clear_experiments(spark, path)
    assert EX.read_experiments(spark, path).count() == 0


def test_run_log_pivot(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "log")
    EX.log_run(spark, path, "r1", "e", "n_retry_0", {"architecture": "Ridge"}, {"val_score": 0.5})
    EX.log_run(spark, path, "r2", "e", "n_retry_1", {"architecture": "Lasso"}, {"val_score": 0.7})
    runs = {r["run_id"]: r for r in EX.get_runs(spark, path, "e").collect()}
    assert runs["r2"]["param.architecture"] == "Lasso" and float(runs["r1"]["metric.val_score"]) == 0.5
    assert EX.get_runs(spark, path, "other").count() == 0


def test_report_sink(spark, tmpdir_path):
    from tessera.operators import report as RP
    record = EX.experiment_row(spark, {"dataset_name": "heart", "task_type": "classification", "n_samples": 10,
                                       "n_features": 3, "metrics": {"accuracy": 0.9, "a": 0.1}, "run_id": "r1",
                                       "approved": True, "critic_score": 7.5, "is_imbalanced": False,
                                       "planner_flags": ["one", "two"], "hyperparams": {"C": 1.0}})
    rep = RP.run_report(record, {"target": "t", "missing_ratio": 0.125, "alternatives": [], "strengths": ["good"]})
    text = rep.first()["report"]
    assert text.startswith("# Experiment Report: heart") and "- **a:** 0.1\n- **accuracy:** 0.9" in text
    assert "- **Missing ratio:** 12.5%" in text and "- **Risk flags:**\n- one\n- two" in text
    assert "**Strengths:**\n- good" in text and "Alternatives" not in text and "- **Score:** 7.5/10" in text
    assert "No analyst insight recorded." in text and "- **Imbalanced:** No" in text
    RP.write_reports(rep, os.path.join(tmpdir_path, "rep"))
    assert spark.read.text(os.path.join(tmpdir_path, "rep")).count() == len(text.split("\n")) + 1
    _ = json.dumps({})


def test_csv_quotes_and_newlines(spark, tmpdir_path):
    """Written by plain text, read as pandas reads it."""
    import pandas as pd
    path = os.path.join(tmpdir_path, "q.csv")
    with open(path, "w") as f:
        f.write('id,a,b\n1,"say ""hi"", ok",1.5\n2,"two\nlines",2\n3,plain,x\n4,"",1e3\n')
    got = CS.read_csv(spark, path).orderBy("id").toPandas()
    want = pd.read_csv(path)
    assert got.id.tolist() == [1, 2, 3, 4] and got.a.tolist()[:3] == want.a.tolist()[:3]
    assert got.a.isna().tolist() == want.a.isna().tolist() and got.b.tolist() == want.b.astype(str).tolist()


def test_number_shape_guard_matches_plain_cast(spark):
    from pyspark.sql import functions as F
    vals = ["1", "1.", ".5", "1e5", "1E-3", "+1.5", "-.5e+2", "1d", "1.5F", "inf", "-Infinity", "NaN", "nan", " 7 ",
            "0x1p3", "1,5", "abc", "", ".", "e5", "1e", "1996-01-01", None, "\t2\n", "infinit"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    rows = df.select(F.col("v").try_cast("double").alias("a"), CS.as_double(F.col("v")).alias("b")).collect()
    assert [str(r["a"]) for r in rows] == [str(r["b"]) for r in rows]


def test_every_model_kind_is_saved(spark, tmpdir_path):
    import pytest
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from tessera.operators import models as MD
    from tessera.operators import search as SR
    from tessera.sources import artifacts as AR
    df = spark.range(60).select(F.col("id").alias("_row_id"), (F.col("id") % 2).cast("double").alias("label"),
                                array_to_vector(F.array((F.col("id") % 2) * 2.0 + F.rand(1), F.rand(2))).alias("features"))
    df = df.cache()
    for a in ("GaussianNB", "LinearSVC", "KNN", "DecisionTree"):
        m = MD.build_model(a, {}, "classification", stats={"n": 60, "sum_w": 60}).fit(df)
        AR.save_model(os.path.join(tmpdir_path, a), m)
        back = AR.load_model(os.path.join(tmpdir_path, a))
        one, two = (sorted((r["_row_id"], r["prediction"]) for r in SR.predictions(x, df).collect()) for x in (m, back))
        assert one == two
    with pytest.raises(TypeError):
        AR.save_model(os.path.join(tmpdir_path, "x"), object())


def test_log_runs_many_matches_single(spark, tmpdir_path):
    """A10 distributed: the exploded long log pivots to the same values as one-run appends."""
    runs = spark.createDataFrame(
        [("r1", "e", "Ridge", {"alpha": "1.0"}, 0.5, 0.6), ("r2", "e", "Lasso", {"alpha": "0.1"}, 0.7, None),
         ("r3", "f", "Ridge", {"alpha": "2.0"}, 0.1, 0.2)],
        "run_id string, exp string, arch string, hp map<string,string>, val_score double, train_score double")
    many, one = os.path.join(tmpdir_path, "many"), os.path.join(tmpdir_path, "one")
    EX.log_runs(runs.repartition(3), many, "exp", "arch", "hp", ["val_score", "train_score"])
    for r in runs.collect():
        EX.log_run(spark, one, r["run_id"], r["exp"], r["arch"], r["hp"],
                   {k: r[k] for k in ("val_score", "train_score") if r[k] is not None})

    def norm(path):
        out = {}
        for r in EX.get_runs(spark, path, "e").collect():
            d = r.asDict()
            out[d.pop("run_id")] = {k: (float(v) if k.startswith("metric.") and v is not None else v)
                                    for k, v in d.items()}
        return out
    assert norm(many) == norm(one)
    assert norm(many)["r2"]["metric.train_score"] is None


def test_integer_shape_guard_matches_plain_cast(spark):
    """The regex guard in front of the bigint cast changes no value."""
    from pyspark.sql import functions as F
    vals = ["12", " 12 ", "+12", "-12", "12.", "12.0", ".5", "1e3", "0x10", "\t7\n", "\x017\x01",
            "99999999999999999999", "1_000", "٣", "12 3", "", " ", "+", "-0", None, "A", "NaN"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    rows = df.select(F.col("v").try_cast("bigint").alias("a"), CS.as_bigint(F.col("v")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)
