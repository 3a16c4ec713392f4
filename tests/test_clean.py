"""B1–B3 and C1 on a hand fixture."""
from tessera.operators import clean as CL


def test_clean_for_training_hand_case(spark):
    rows = [
        # Unnamed: 0, ID, serial, size, color, y
        (0, 10, 100, 1, "red", 5),
        (1, 11, 101, 1, "red", 5),      # copy of the row above once ids are gone
        (2, 12, 102, 2, "blue", None),  # B1: NULL target
        (3, 13, 103, 2, None, 7),
        (4, 14, 104, 3, None, 7),
    ]
    df = spark.createDataFrame(rows, "`Unnamed: 0` int, ID int, serial long, size int, color string, y int")
    out = CL.clean_for_training(df, "y")
    # B2 drops the id names; B3 drops the all-distinct integer `serial` but keeps `size`
    # (repeated) and the target `y` even though it is an integer (S3)
    assert out.columns == ["size", "color", "y"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([(1, "red", 5), (2, None, 7), (3, None, 7)])


def test_all_distinct_target_kept(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "label int, g int")
    assert CL.all_distinct_int_columns(df, target="label") == []
    assert CL.all_distinct_int_columns(df.withColumnRenamed("label", "k"), target="g") == ["k"]


def test_distinct_rows_nulls_equal(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None)], "x int, s string")
    assert CL.distinct_rows(df).count() == 2
