"""Ranks and quantiles by sketched brackets against sorting, on plain and unkind data."""
import random

import pytest

from tessera.operators import ranks


def interpolated(values, q):
    h = q * (len(values) - 1)
    lo = int(h)
    hi = min(lo + (h > lo), len(values) - 1)
    return values[lo] + (values[hi] - values[lo]) * (h - lo)


def groups(seed=4, n=30_000):
    rnd = random.Random(seed)
    return {"uniform": [rnd.random() for _ in range(n)],
            "normal": [rnd.gauss(0, 1e6) for _ in range(n)],
            "hot": [3.5 if rnd.random() < 0.4 else rnd.random() * 10 for _ in range(n)],
            "few": [float(rnd.randrange(3)) for _ in range(n)],
            "one": [7.0] * 50, "single": [-2.5], "pair": [float("-inf"), 1e300],
            "steep": [10.0 ** rnd.uniform(-300, 300) for _ in range(n)]}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(g, v) for g, vs in groups().items() for v in vs], "g string, v double").repartition(6)


@pytest.mark.parametrize("k, grid, interior", [(4096, 400, 1_000_000), (16, 50, 500), (8, 300, 3)])
def test_quantiles_are_exact_however_good_the_sketch(spark, rows, monkeypatch, k, grid, interior):
    """Poor sketches and small limits take more rounds, not other results."""
    monkeypatch.setattr(ranks, "SKETCH_K", k)
    monkeypatch.setattr(ranks, "GRID", grid)
    monkeypatch.setattr(ranks, "INTERIOR_ROWS", interior)
    probs = [0.0, 0.25, 0.5, 1.0]
    got = {(r["g"], r["q"]): r["v"] for r in ranks.exact_quantiles(rows, ["g"], "v", probs).collect()}
    want = {(g, q): interpolated(sorted(vs), q) for g, vs in groups().items() for q in probs}
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], rel=1e-12, nan_ok=True) for p in want)


def test_ranks_of_a_null_group_and_empty_input(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(100)] + [(1, 5.0)], "g int, v double")
    targets = spark.createDataFrame([(None, 0), (None, 42), (1, 0)], "g int, pos long")
    got = {(r["g"], r["pos"]): r["v"] for r in ranks.bracketed_ranks(df, ["g"], "v", targets).collect()}
    assert got == {(None, 0): 0.0, (None, 42): 42.0, (1, 0): 5.0}
    assert ranks.exact_quantiles(df.where("false"), ["g"], "v", [0.5]).collect() == []


def test_only_the_bracket_is_shuffled(spark, tmp_path):
    """Records shuffled, read from the plans that ran: far fewer than rows."""
    n = 400_000
    df = spark.range(0, n, 1, 8).selectExpr("'c' AS g", "cast(pmod(xxhash64(id), 1000003) as double) AS v")
    seen = []
    plain = ranks._inside

    def inside(*a):
        seen.append(plain(*a).count())
        return plain(*a)
    ranks._inside = inside
    try:
        got = ranks.exact_quantiles(df, ["g"], "v", [0.5]).first()["v"]
    finally:
        ranks._inside = plain
    values = sorted(r["v"] for r in df.collect())
    assert got == interpolated(values, 0.5)
    assert sum(seen) < n * 2 * 4 / ranks.GRID
