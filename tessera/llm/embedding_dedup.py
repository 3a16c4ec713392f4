"""Embedding near-dedup by int8 quantised tile products with rigorous error bounds.

Method
1. Equal vectors of one label form a class; only classes are compared.
2. The classes of a label (and vector length) are dealt into blocks; a pair of
   blocks is one unit of work with a bounded number of rows (``blocks.dealt``),
   so a label that holds a third of all rows is spread over many tasks.
3. Inside a unit each unit vector ``u`` becomes ``s * q + e`` with int8 ``q``, and
   the norms ``r = |s q|`` and ``eps = |e|`` are kept.  By Cauchy-Schwarz
   ``|u.v - s_u s_v q_u.q_v| <= r_u eps_v + eps_u r_v + eps_u eps_v``.  Products
   of tiles of ``q`` are exact (integers in a float type that holds them), so a
   pair whose product plus bound stays below the threshold cannot be a link.
4. Only the other pairs are computed in double precision.
5. A unit returns link counts and a spanning forest; components join the forests.

Defined results: vectors that are null, empty, zero or hold null or non-finite
numbers, and rows with a null label or null id, link with nothing; vectors of
different lengths are not compared; equal rows count as links of each other; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.blocks import dealt, in_units, roots, unit_rows
from tessera.llm.components import components
from tessera.llm.store import written

BLOCK_ROWS, TILE = 2048, 1024
#: Rounding of the sums that make up the bounds is far below this.
SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors scaled to unit length, their int8 codes, steps, code norms and error norms."""
    x = x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True))))  # exact, keeps squares finite
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    step = np.abs(x).max(axis=1) / 127
    code = np.rint(x / step[:, None]).astype(np.int8)
    near = step[:, None] * code
    return x, code, step, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def possible(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two quantised tiles whose cosine may reach the threshold."""
    _, qa, sa, ra, ea = a
    _, qb, sb, rb, eb = b
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * np.outer(sa, sb)
    bound = np.outer(ra, eb) + np.outer(ea, rb) + np.outer(ea, eb)
    return np.nonzero(product + bound >= threshold - SLACK)


def links(x: np.ndarray, left: np.ndarray, right: np.ndarray, diagonal: bool, threshold: float):
    """Pairs of rows with cosine of at least the threshold, left against right (or all of left)."""
    q = quantised(x)
    found_i, found_j = [], []
    for a in range(0, len(left), TILE):
        rows = left[a:a + TILE]
        for b in range(a if diagonal else 0, len(left if diagonal else right), TILE):
            cols = (left if diagonal else right)[b:b + TILE]
            i, j = possible([v[rows] for v in q], [v[cols] for v in q], threshold)
            i, j = rows[i], cols[j]
            if diagonal and a == b:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 1 << 16):
                p, r = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
                ok = cosine(x[p], x[r]) >= threshold
                found_i.append(p[ok])
                found_j.append(r[ok])
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Double precision cosine of rows, scaled by powers of two so that squares stay finite."""
    a, b = (v / np.exp2(np.floor(np.log2(np.abs(v).max(axis=1, keepdims=True)))) for v in (a, b))
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def _keyed(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """``(vec_id, label, dim, key, vec)``; the key is null where a vector links with nothing."""
    double = isinstance(vectors.schema[vector].dataType.elementType, T.DoubleType)
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(label).cast("string").alias("label"),
                         F.col(vector).cast("array<double>" if double else "array<float>").alias("vec"))
    kind = np.float64 if double else np.float32

    def run(batches):
        for batch in batches:
            vec = batch.column("vec").fill_null([])
            values = vec.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum([0, *vec.value_lengths().to_pylist()])
            bad = np.r_[0, np.cumsum(~np.isfinite(values))]
            some = np.r_[0, np.cumsum(values != 0)]
            usable = (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])
            key, raw = [], []
            for n, (lab, vid) in enumerate(zip(batch.column("label").to_pylist(), batch.column("vec_id").to_pylist())):
                if usable[n] and lab is not None and vid is not None:
                    raw.append(values[ends[n]:ends[n + 1]].tobytes())
                    key.append(xxhash.xxh3_128_digest(f"{len(lab)}:{lab}".encode() + raw[-1]))
                else:
                    raw.append(None)
                    key.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(np.diff(ends), pa.int32()),
                 pa.array(key, pa.binary()), pa.array(raw, pa.binary())],
                names=["vec_id", "label", "dim", "key", "vec"])

    id_type = vectors.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"vec_id {id_type}, label string, dim int, key binary, vec binary")


def _compared(units: DataFrame, threshold: float, kind) -> DataFrame:
    """``(key, links, other)``: links of a class inside a unit and its spanning partner."""
    columns = ["unit", "block", "diagonal", "key", "copies", "dim", "vec"]

    def run(batches):
        for table in unit_rows(batches, columns):
            unit = table.column("unit").to_numpy()
            border = np.flatnonzero(np.diff(unit)) + 1
            for a, b in zip(np.r_[0, border], np.r_[border, len(unit)]):
                part = table.slice(a, b - a)
                x = np.frombuffer(b"".join(part.column("vec").to_pylist()), kind).astype(np.float64)
                x = x.reshape(b - a, -1)
                block, diagonal = part.column("block").to_numpy(), part.column("diagonal")[0].as_py()
                i, j = links(x, np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min()),
                             diagonal, threshold)
                copies, key = part.column("copies").to_numpy(), part.column("key").to_pylist()
                count = (np.bincount(i, copies[j], b - a) + np.bincount(j, copies[i], b - a)).astype(np.int64)
                root, out = roots(b - a, i, j), np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[r] for r in out], pa.binary()), pa.array(count[out]),
                     pa.array([key[root[r]] if root[r] != r else None for r in out], pa.binary())],
                    names=["key", "links", "other"])

    return units.mapInArrow(run, "key binary, links long, other binary")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", *,
                 threshold: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    kind = np.float64 if isinstance(vectors.schema[vector].dataType.elementType, T.DoubleType) else np.float32
    rows = written(_keyed(vectors, id_col, vector, label), "vector-keys")
    classes = written(rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("label").alias("label"),
        F.min("dim").alias("dim"), F.first("vec").alias("vec")), "vector-classes")
    units = dealt(classes.select("key", "label", "dim"), ["label", "dim"], "key", BLOCK_ROWS).drop("label", "dim")
    units = in_units(units.join(classes.select("key", "copies", "dim", "vec"), "key"))
    found = written(_compared(units, threshold, kind), "vector-links")
    root = components(found.where("other IS NOT NULL"), "key", "other")
    about = (classes.select("key", "first", "copies")
             .join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
             .join(root.withColumnRenamed("node", "key"), "key", "left")
             .withColumn("root", F.coalesce("root", "key")))
    head = about.groupBy("root").agg(F.min("first").alias("head"))
    about = about.join(head, "root").select(
        "key", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("vec_id", "key").join(about, "key", "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("head", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("head", "vec_id"), F.lit(True)).alias("kept"))
