"""Links, counts and components against brute force in double precision."""

import numpy as np
import pytest

from tessera.llm import embedding_dedup as ed

NAN, INF = float("nan"), float("inf")


def brute(rows, threshold=0.98):
    ok = [v is not None and lab is not None and vid is not None and None not in v and len(v) > 0
          and np.isfinite(v).all() and np.any(np.array(v) != 0) for vid, v, lab in rows]
    n, near = len(rows), [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[i].add(j)
    out = []
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        low = min((rows[k][0] for k in seen), default=None) if ok[i] else rows[i][0]
        out.append((rows[i][0], len(near[i]), low, rows[i][0] is None or rows[i][0] == low))
    return sorted(out, key=str)


def vectors(seed, n=160, dim=24):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dim))
    rows = []
    for i in range(n):
        v = centre[rng.integers(8)] + rng.normal(size=dim) * rng.choice([0.05, 0.14, 0.2, 1.0])
        rows.append((i + 10, v.astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(500 + i, rows[0][1], rows[0][2]) for i in range(5)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block,tile", [(2048, 1024), (16, 8)])
def test_equals_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(ed, "BLOCK_ROWS", block)
    monkeypatch.setattr(ed, "TILE", tile)
    rows = vectors(1)
    got = ed.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_unusable_vectors_and_extra_columns(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [x * 1e-30 for x in v], 0), (3, [x * 1e18 for x in v], 0), (4, v, None), (None, v, 0),
            (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [1.0, NAN, 3.0], 0),
            (10, [1.0, INF, 3.0], 0), (11, [1.0, 2.0], 0), (12, v, 1), (13, v, 0), (13, v, 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS unit", "3 AS dim")
    got = ed.near_vectors(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_bound_is_never_below_the_cosine():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64)) * rng.choice([1e-3, 1, 50], size=(300, 1))
    x[1::2] = x[::2] + rng.normal(size=(150, 64)) * 0.1 * np.abs(x[::2]).mean(axis=1, keepdims=True)
    q = ed.quantised(x)
    for t in (0.5, 0.9, 0.98, 0.999):
        i, j = ed.possible(q, q, t)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert set(zip(*np.nonzero(u @ u.T >= t))) <= set(zip(i, j))


def test_empty_table(spark):
    assert ed.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
