"""Approximate nearest neighbours by inner product with vantage-point trees per shard.

Method
1. With one more coordinate, ``sqrt(M - |x|^2)`` for the rows (``M`` the largest squared
   length) and 0 for the queries, the largest inner product is the smallest Euclidean
   distance, for which the triangle inequality holds.
2. Rows are dealt into shards of about ``SHARD_ROWS`` by a hash of the id.  Every shard
   is indexed whole as one vantage-point tree: a node takes a member as its vantage
   point, splits its members at the median distance from it and keeps the smallest and
   largest distance of either half; a leaf has about ``LEAF_ROWS`` members.
3. Queries are dealt into blocks; a block meets a shard in one unit of work, where the
   shard's tree is made (about 7 distances a row; a block of queries costs hundreds).  A query
   at distance ``d`` from a vantage point is at least ``max(d - hi, lo - d)`` away from
   every member of a half whose distances lie in ``[lo, hi]``; a leaf's bound is the
   largest one of its ancestors.  A query visits leaves by ascending bound (1, 2, 4, ... at
   a time), until the bound exceeds ``factor`` times the distance of its ``k``-th best so far.
   At ``factor=1`` no leaf that could hold a nearer (or equal) row is left out, so the
   search is exact; below 1 it ends earlier.
4. Products of a leaf choose candidates with room for their rounding; scores are the
   double precision sums of the original vectors.  A unit gives at most ``k`` rows a
   query; a ranking over the shards keeps the first ``k``.

Rows are indexed without a sample.  Queries against all shards are blocks against
blocks: every shard is read once for each ``QUERY_ROWS`` queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, or whose squared length is beyond double range, take no part, nor do rows
with a null id; of rows that repeat an id the one with the least vector counts; vectors
are compared only to those of their own length; scores of any sign count, ties go to
the smaller id; a query with fewer candidates than ``k`` gets all of them, one without
any has no rows; columns that are not named take no part, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.store import written

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 4096, 64
#: Share of the k-th distance up to which leaves are visited; 1 is exact.
FACTOR = 0.9
QUERY_EVERY = 20
#: Queries of a unit that are worked on together.
AT_ONCE = 1024
#: Rounding of distances as a share of the largest one possible.
SLACK = 1e-7


class Tree:
    """A vantage-point tree over the rows of ``x`` (in the space with the added coordinate)."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        #: By node: vantage row, its halves (a node, or ~leaf) and their distances' borders.
        self.vantage, self.child, self.lo, self.hi, self.leaves = [], [], [], [], []
        todo = [(np.arange(len(x)), None)]
        while todo:
            rows, parent = todo.pop()
            if len(rows) <= leaf_rows:
                me = ~len(self.leaves)
                self.leaves.append(rows)
            else:
                me = len(self.vantage)
                at = int(rows[rng.integers(len(rows))])
                d = distances(x[at][None], x[rows])[0]
                order = np.argsort(d, kind="stable")
                half = len(rows) // 2
                self.vantage.append(at)
                self.child.append([0, 0])
                self.lo.append([d[order[0]], d[order[half]]])
                self.hi.append([d[order[half - 1]], d[order[-1]]])
                todo += [(rows[order[:half]], (me, 0)), (rows[order[half:]], (me, 1))]
            if parent:
                self.child[parent[0]][parent[1]] = me
        self.vantage = np.array(self.vantage, np.int64)

    def bounds(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For every query the least possible distance to the members of every leaf."""
        out = np.zeros((len(q), len(self.leaves)))
        if not len(self.vantage):
            return out
        d = distances(q, x[self.vantage])
        todo = [(0, np.zeros(len(q)))]
        while todo:
            node, bound = todo.pop()
            for half in (0, 1):
                below = np.maximum(bound, np.maximum(d[:, node] - self.hi[node][half], self.lo[node][half] - d[:, node]))
                child = self.child[node][half]
                if child < 0:
                    out[:, ~child] = below
                else:
                    todo.append((child, below))
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, longest: float, k: int,
            factor: float, tree: Tree | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(query row, row of x, score)`` of the ``k`` best rows of each query, and the leaves visited.

    ``longest`` is the largest squared length of any row (M)."""
    wide = np.c_[x, np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0))]
    tree = tree or Tree(wide)
    found, visits = [], 0
    def visit(who: np.ndarray, rows: np.ndarray) -> None:
        """Let the rows of a leaf take their places among the best of some queries."""
        product = part[who] @ x[rows].T
        hit = (product >= (score[who, k - 1] - room[who])[:, None]) & (ids[rows] != q_ids[a + who][:, None])
        i, j = np.nonzero(hit)
        new = np.full(hit.shape, -np.inf)
        new[i, j] = np.cumsum(part[who[i]] * x[rows[j]], axis=1)[:, -1]       # one sum after the other
        both = np.c_[score[who], new]
        names = np.c_[row[who], np.where(hit, rows, -1)]
        by_id = np.argsort(np.where(names < 0, np.iinfo(np.int64).max, ids[names]), axis=1, kind="stable")
        best = np.take_along_axis(by_id, np.argsort(-np.take_along_axis(both, by_id, 1), axis=1,
                                                    kind="stable")[:, :k], 1)
        score[who], row[who] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)

    for a in range(0, len(q), AT_ONCE):
        part = q[a:a + AT_ONCE]
        n, reach = len(part), np.einsum("ij,ij->i", part, part) + longest      # |q - x|^2 = reach - 2 q.x
        slack, room = SLACK * np.sqrt(2 * reach), 1e-12 * reach * x.shape[1]
        bound = tree.bounds(np.c_[part, np.zeros(n)], wide)
        order = np.argsort(bound, axis=1, kind="stable")
        score, row = np.full((n, k), -np.inf), np.full((n, k), -1)
        live, turn, width = np.arange(n), 0, 1
        while len(live) and turn < len(tree.leaves):
            leaf = order[live, turn:turn + width]
            kth = score[live, k - 1]
            far = factor * np.sqrt(np.maximum(reach[live] - 2 * kth, 0)) + slack[live]
            stay = (bound[live[:, None], leaf] <= far[:, None]) | (kth == -np.inf)[:, None]
            who, leaf = np.repeat(live, stay.sum(axis=1)), leaf[stay]
            visits += len(who)
            by_leaf = np.argsort(leaf, kind="stable")
            who, leaf = who[by_leaf], leaf[by_leaf]
            for some in np.split(np.arange(len(who)), np.flatnonzero(np.diff(leaf)) + 1) if len(who) else []:
                visit(who[some], tree.leaves[leaf[some[0]]])
            live, turn, width = live[stay[:, -1]], turn + width, 2 * width    # bounds ascend
        i, j = np.nonzero(row >= 0)
        found.append((i + a, row[i, j], score[i, j]))
    return (*(np.concatenate(c) for c in zip(*found)), visits)


def usable(vec: Column) -> Column:
    """Whether a vector (array of double) can take part."""
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    square = F.aggregate(vec, F.lit(0.0), lambda s, v: s + v * v)
    return finite & F.exists(vec, lambda v: v != 0) & (square < float("inf"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, dim)


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", *, k: int = 20,
           factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every row that ``queries`` selects.

    ``queries`` is a condition on the id, named ``vec_id``."""
    if not 0 <= factor <= 1:
        raise ValueError("factor must be in [0, 1]")
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("vec")), F.lit(False)))
    rows = written(rows.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec")), "vectors")
    by_dim = rows.groupBy("dim").agg(
        F.max(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)).alias("longest"),
        F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"),
        F.ceil(F.count_if(queries) / query_rows).cast("int").alias("blocks"))   # a row for each vector length
    about = rows.join(by_dim, "dim")
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = (about.where("blocks > 0").withColumn("shard", dealt(1, "shards")).withColumn("block", each("blocks"))
               .select("dim", "shard", "block", "vec_id", "vec", "longest"))
    asked = (about.where(queries).withColumn("block", dealt(2, "blocks")).withColumn("shard", each("shards"))
             .select("dim", "shard", "block", F.col("vec_id").alias("query_id"), F.col("vec").alias("query")))

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            dim, longest = left.column("dim")[0].as_py(), left.column("longest")[0].as_py()
            left = left.sort_by("vec_id")
            ids, q_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
            i, j, score, _ = nearest(_matrix(left.column("vec"), dim), ids, _matrix(right.column("query"), dim),
                                     q_ids, longest, k, factor)
            out = (q_ids[i], ids[j], score)
        types = (left.schema.field("vec_id").type, left.schema.field("vec_id").type, pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["query_id", "vec_id", "score"])

    unit_of = ["dim", "shard", "block"]
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in unit_of], "query_id", "query")
    found = members.groupBy(*unit_of).cogroup(asked.groupBy(*[f"q_{c}" for c in unit_of])).applyInArrow(
        unit, f"query_id {id_type}, vec_id {id_type}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")     # at most k rows a shard
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest_table(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return search(vectors, F.col("vec_id") % QUERY_EVERY == 0)


#: The exact search in DuckDB SQL, for vectors of one length.
SQL = """
WITH given AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (
  SELECT vec_id, v FROM given
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 20
"""
