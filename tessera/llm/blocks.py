"""Units of work of a similarity join: blocks and pairs of blocks of one candidate group.

A group's members are dealt into blocks by a hash; the pairs inside one block
(``diagonal``) or across two blocks are one unit.  Units have a bounded number
of rows, so a group of any size is spread over many tasks, and what leaves a
unit are sums and spanning forests, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def dealt(members: DataFrame, group: list[str], key: str, block_rows: int) -> DataFrame:
    """``members`` of groups with two members or more, with columns unit, block and diagonal."""
    full = (members.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1")
            .select(*group, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks")))
    return (members.join(full, group)
            .withColumn("block", F.pmod(F.xxhash64(F.lit(1), key), F.col("_blocks")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumn("diagonal", F.col("block") == F.col("_other"))
            .withColumn("unit", _unit(group))
            .drop("_blocks", "_other"))


def _unit(group: list[str]) -> Column:
    return F.xxhash64(*group, F.least("block", "_other"), F.greatest("block", "_other"))


def in_units(rows: DataFrame) -> DataFrame:
    return rows.repartition("unit").sortWithinPartitions("unit")


#: Rows of a unit squared, summed over the units that are worked on together.
PAIRS_AT_ONCE = 1_000_000


def unit_rows(batches, columns: list[str]):
    """Tables of whole units (rows of equal unit hash, sorted), across batch borders.

    Each table has one unit or so few rows that their pairs fit in memory."""
    held = None
    for batch in batches:
        table = pa.table([batch.column(c) for c in columns], names=columns)
        held = table if held is None else pa.concat_tables([held, table])
        unit = held.column("unit").to_numpy()
        if not len(unit) or unit[0] == unit[-1]:
            continue
        cut = int(np.flatnonzero(unit != unit[-1])[-1]) + 1
        yield from _few_pairs(held.slice(0, cut))
        held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from _few_pairs(held)


def _few_pairs(table: pa.Table):
    unit = table.column("unit").to_numpy()
    start = size = 0
    border = np.r_[0, np.flatnonzero(np.diff(unit)) + 1, len(unit)]
    for a, b in zip(border[:-1].tolist(), border[1:].tolist()):
        if a > start and size + (b - a) ** 2 > PAIRS_AT_ONCE:
            yield table.slice(start, a - start)
            start, size = a, 0
        size += (b - a) ** 2
    yield table.slice(start)


def pairs(unit: np.ndarray, block: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs inside each unit: all of one block, or all across the two blocks."""
    border = np.r_[0, np.flatnonzero(np.diff(unit)) + 1]
    size = np.diff(np.r_[border, len(unit)])
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    inner = diagonal[border].astype(bool) if len(unit) else np.empty(0, bool)
    for n in np.unique(size[inner]).tolist() if len(unit) else []:
        i, j = np.triu_indices(n, 1)
        first = border[inner & (size == n)][:, None]
        left.append((first + i).ravel())
        right.append((first + j).ravel())
    for a, n in zip(border[~inner].tolist(), size[~inner].tolist()) if len(unit) else []:
        least = block[a:a + n] == block[a:a + n].min()
        first, second = np.flatnonzero(least), np.flatnonzero(~least)
        left.append(np.repeat(first, len(second)) + a)
        right.append(np.tile(second, len(first)) + a)
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.argsort(left, kind="stable")
    return left[order], right[order]


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of set intersections for row pairs; a 0/1 matrix product if there are many pairs."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                         for a, b in zip(i, j)], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[code] > 1
    owner, column = owner[shared], column[code[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return out[i, j].astype(np.int64)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)])


#: Values of the sets of pairs that are looked up together.
VALUES_AT_ONCE = 1_000_000


def _few_intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of set intersections for row pairs: values of the smaller set looked up among those of the other."""
    rows, at = np.unique(np.r_[i, j], return_inverse=True)
    i, j = at[:len(i)], at[len(i):]
    size = np.array([len(sets[k]) for k in rows.tolist()])
    i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    n = size[i]
    if not n.any():
        return np.zeros(len(i), np.int64)
    values, code = np.unique(np.concatenate([sets[k] for k in rows.tolist()]), return_inverse=True)
    there = np.repeat(np.arange(len(rows)), size) * len(values) + code
    of = np.repeat(np.arange(len(i)), n)
    at = (np.cumsum(size) - size)[i][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
    wanted = j[of] * len(values) + code[at]
    found = there[np.minimum(np.searchsorted(there, wanted), len(there) - 1)] == wanted
    return np.bincount(of[found], minlength=len(i))


def unit_intersections(sets: list[np.ndarray], unit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of set intersections for row pairs that are ordered by their unit."""
    both = np.zeros(len(i), np.int64)
    if not len(i):
        return both
    border = np.r_[0, np.flatnonzero(np.diff(unit[i])) + 1]
    lo = np.minimum.reduceat(np.minimum(i, j), border)
    hi = np.maximum.reduceat(np.maximum(i, j), border) + 1
    count = np.diff(np.r_[border, len(i)])
    many = count > 4 * (hi - lo)
    for a, n, x, y in zip(*[v[many].tolist() for v in (border, count, lo, hi)]):
        both[a:a + n] = intersections(sets[x:y], i[a:a + n] - x, j[a:a + n] - x)
    few = np.flatnonzero(~np.repeat(many, count))
    if len(few):
        size = np.array([len(x) for x in sets])
        part = np.cumsum(size[i[few]] + size[j[few]]) // VALUES_AT_ONCE
        for some in np.split(few, np.flatnonzero(np.diff(part)) + 1):
            both[some] = _few_intersections(sets, i[some], j[some])
    return both
