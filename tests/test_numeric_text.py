"""D1–D7 on the FIXTURES.md hand cases."""
import pytest
from pyspark.sql import functions as F

from tessera.operators import numtext as NX
from tessera.operators import profile as P


def _run(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    pat = NX.detect(df, ["s"]).first()["pattern"]
    if pat is None:
        return None, None
    out = NX.NumericTextModel({"s": pat}).transform(df).orderBy("i").select("s").collect()
    return pat, [r[0] for r in out]


@pytest.mark.parametrize("values,pattern,expected", [
    (["8GB", "16GB", "4 GB", None, "512MB"], "unit", [8, 16, 4, None, 512]),
    (["1000-1500", "2000-3000", "10-20", "7", "5-6"], "range", [1250, 2500, 15, None, 5.5]),
    (["1000-1500", "2000 – 3000", None, "10-20", "7"], "leading", [1000, 2000, None, 10, 7]),
    (["2 BHK", "3 BHK", "4 Bedroom", "RK", "5 BHK"], "leading", [2, 3, 4, None, 5]),
    (["2 BHK", "3 BHK", "studio", "RK", "5 BHK"], None, None),
    (["2020-01-05", "2021-02-03"], "leading", [2020, 2021]),
    (["8gb", "16gb"], "leading", [8, 16]),
])
def test_fixture_cases(spark, values, pattern, expected):
    pat, got = _run(spark, values)
    assert pat == pattern
    if expected is not None:
        assert got == [None if e is None else float(e) for e in expected]


def test_range_parse_edges(spark):
    from tessera.functions import numeric_text as NT
    df = spark.createDataFrame([("-5",), ("1-2-3",), ("1000-1500 sqft",), (" 5 - 6 ",)], "s string")
    got = [r[0] for r in df.select(NT.range_midpoint("s")).collect()]
    assert got == [None, 1.5, None, 5.5]


def test_profile_marks_converted(spark):
    df = spark.createDataFrame([(f"{i}GB", i) for i in range(1, 30)], "ram string, y int")
    prof = P.profile_columns(df).where(F.col("column") == "ram").first()
    assert prof["is_converted"] and prof["col_type"] == "numeric" and prof["max"] == 29.0
    # distinct count is of the raw strings
    assert prof["n_unique"] == 29


def test_routing_uses_all_rows_for_range_share(spark):
    from tessera.operators import features as FT
    df = spark.createDataFrame([(v,) for v in ["1000-1500", "2000 – 3000", None, "10-20", "7"]], "s string")
    r = FT.route_columns(df).first()
    assert r["pattern"] == "leading" and r["route"] == "numeric_text"
