"""Distributed order statistics vs brute force."""
import random

from pyspark.sql import functions as F

from tessera.operators import ranks


def test_select_ranks_and_running_totals(spark):
    rnd = random.Random(1)
    rows = [("a", float(rnd.randint(0, 50))) for _ in range(2000)] + [("b", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")
    w = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    targets = spark.createDataFrame([("a", 0), ("a", 999), ("a", 1999), ("b", 150)], "g string, pos long")
    got = {(r["g"], r["pos"]): r["v"] for r in ranks.select_ranks(w, ["g"], "v", "n", targets).collect()}
    sa = sorted(v for g, v in rows if g == "a")
    assert got == {("a", 0): sa[0], ("a", 999): sa[999], ("a", 1999): sa[1999], ("b", 150): 150.0}
    rt = {(r["g"], r["v"]): r["n_before"] for r in ranks.running_totals(w, ["g"], "v", ["n"]).collect()}
    assert rt[("b", 10.0)] == 10 and rt[("a", sa[0])] == 0


def test_top_k_salted_equals_plain(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i % 3, rnd.randint(0, 10 ** 6), i) for i in range(5000)], "g int, s int, i int")
    order = [F.desc("s"), F.asc("i")]
    plain = {(r["g"], r["rank"], r["i"]) for r in ranks.top_k(df, ["g"], order, 4).collect()}
    salted = {(r["g"], r["rank"], r["i"]) for r in
              ranks.top_k(df, ["g"], order, 4, max_group_rows=5000, rows_per_task=100).collect()}
    assert plain == salted and len(plain) == 12


def test_top_k_salts_rows_with_maps(spark):
    """Rows that hold maps, also inside structs, are salted too (a map cannot be hashed)."""
    df = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 500).alias("s"), F.expr(
        "map('a', id)").alias("m"), F.expr("named_struct('n', map(id, 'x'))").alias("a.b"))
    got = ranks.top_k(df, ["g"], [F.desc("s")], 3, max_group_rows=500, rows_per_task=50).collect()
    plain = ranks.top_k(df, ["g"], [F.desc("s")], 3).collect()
    assert len(got) == 6 and sorted(map(str, got)) == sorted(map(str, plain))


def test_brackets_are_counted_without_sorting_rows(spark):
    """The arrays of brackets went through the aggregate, so every row was sorted."""
    rows = spark.range(100).selectExpr("id % 2 as g", "cast(id as double) as v")
    wanted = spark.createDataFrame([(0, 10, 3.0, 40.0), (0, 20, 40.0, 60.0), (1, 10, 5.0, 5.0)],
                                   "g long, pos long, _blo double, _bhi double")
    got = ranks._counted(rows, wanted, ["g"], "v")
    assert "SortAggregate" not in got._jdf.queryExecution().toString()
    assert sorted((r["g"], r["pos"], r["_below"], r["_at_lo"], r["_in"], r["_at_hi"]) for r in got.collect()) == [
        (0, 10, 2, 0, 18, 1), (0, 20, 20, 1, 9, 1), (1, 10, 2, 1, 0, 0)]
