"""Search by vantage-point trees against all products, recall at the default factor, defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.vantage import FACTOR, Tree, distances, nearest, nearest_table, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, k):
    """{(query, rank): (vec_id, score)} of (id, vector) rows."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out, least = {}, {}
    for i, v in good:
        least[i] = min([least.get(i, v), v], key=tuple)
    good = list(least.items())
    for q, a in good:
        if q % every == 0:
            near = sorted((-float(np.einsum("i,i->", a, b)), i) for i, b in good if i != q and len(a) == len(b))
            out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(near[:k])}
    return out


def found(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[p][0] == want[p][0] and got[p][1] == pytest.approx(want[p][1], abs=1e-9) for p in want)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = centre[rng.integers(12, size=n)] + 0.7 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_factor_one_is_exact_for_vectors_of_any_length(spark):
    rng = np.random.default_rng(2)
    x = clustered(700, 12, 1) * rng.choice([0.2, 1, 30], (700, 1))
    rows = [(i, x[i].astype(np.float32).tolist()) for i in range(700)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    same(found(search(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=150, query_rows=9)), plain(rows, 20, 20))


def test_bounds_hold_and_spare_leaves():
    x = clustered(3000, 8, 3)
    tree, q = Tree(x), clustered(50, 8, 4)
    bound, d = tree.bounds(q, x), distances(q, x)
    assert sorted(np.concatenate(tree.leaves)) == list(range(3000))
    for at, rows in enumerate(tree.leaves):
        assert (bound[:, at][:, None] <= d[:, rows] + 1e-7).all()
    ids = np.arange(3000)
    visits = {f: nearest(x, ids, q, np.full(50, -1), 1.0, 20, f)[3] for f in (1.0, FACTOR, 0.5)}
    assert visits[0.5] < visits[FACTOR] <= visits[1.0] < 50 * len(tree.leaves)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = plain([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 20)
    got = found(nearest_table(df))
    assert got.keys() == want.keys()
    pairs = lambda f: {(q, v) for (q, _), (v, _) in f.items()}
    assert len(pairs(got) & pairs(want)) >= 0.95 * len(want)
    products = {p: s for p, s in want.items()}
    assert all(abs(s - products[p][1]) < 1e-6 for p, (v, s) in got.items() if v == products[p][0])


def test_nulls_ties_repeats_and_clashing_names(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, float(i % 3)]) for i in range(45)] + [
        (60, [0.0, 0.0]), (80, None), (100, []), (120, [1.0, None]), (140, [inf, 1.0]), (160, [nan, 1.0]),
        (None, [1.0, 1.0]), (180, [1.0, 2.0, 3.0]), (181, [0.0, -1.0, 0.0]), (200, [-1.0] * 5), (3, [1.0, 0.0]), (7, [0.5, 9.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    for c in ["dim", "shard", "block", "vec", "score", "rank", "query_id", "longest", "shards", "blocks"]:
        df = df.withColumn(c, F.lit("x"))
    want = plain(rows, 20, 20)
    same(found(search(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=10)), want)
    assert max(p[1] for p in want if p[0] == 180) == 1 and not any(p[0] == 200 for p in want)
    assert nearest_table(df.where("false")).collect() == []
