"""Exact k-nearest neighbours (G8, C9) over pivot blocks that triangle bounds skip.

Training rows go to the block of their nearest pivot (pivots are training rows, about one
for ``BLOCK_ROWS`` rows); a block knows the smallest and largest distance of its rows
from the pivot, and a block of more than ``BLOCK_ROWS`` rows is split by a hash.  A query first
searches the block of its own nearest pivot, which gives a bound on its k-th distance.
A row of another block is at least ``d - largest`` and ``smallest - d`` away, ``d`` being the
query's distance from that pivot, so the query is sent only to the blocks where that does
not exceed its bound; training rows stay in their block (and are copied only if more
than ``BLOCK_ROWS`` queries come to it).  Every unit is one ``cogroup`` group of bounded size;
its training rows are cut into cells around some of them, by the same bounds, and queries of
one cell are held against the rows of the cells that they cannot skip.  Numpy computes distances
in sub-batches of ``CELLS`` pairs and only the ``k`` nearest
per query leave the task, to be ranked by a window over the blocks visited.  Pairs of rows
are never materialised, and nothing but the pivots and a row per block passes through
the driver.  Distance ties break on the training row id; equal rows have distance zero exactly
(selected rows are recomputed from differences).  Where the bounds skip nothing (evenly
spread rows of many dimensions), the cost is that of all query rows x training rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

BLOCK_ROWS = 20_000
# Distances that a task holds at a time (8 MB an array); a sub-batch has as many queries as fit.
CELLS = 1_000_000
MAX_PIVOTS = 4096
# Training rows of a block that is cut into cells, and the room of their bounds for rounding.
CELL_FROM = 1_000
CELL_SLACK = 1e-6
# Rounding of distances, as a share of the lengths they are computed from.
SLACK = 1e-7


class KNN:
    def __init__(self, k: int = 5, weights: str = "uniform", task: str = "classification",
                 features: str = "features", label: str = "label", row_id: str = "_row_id"):
        self.k, self.weights, self.task = k, weights, task
        self.features, self.label, self.row_id = features, label, row_id

    def fit(self, df: DataFrame) -> "KNNModel":
        return KNNModel(df, self)


def _as_array(df: DataFrame, col: str) -> DataFrame:
    dt = df.schema[col].dataType.typeName()
    return df.withColumn("_x", F.col(col) if dt == "array" else vector_to_array(F.col(col)))


def _cells(tx: np.ndarray, qx: np.ndarray, k: int):
    """Queries in batches ``(numbers, rows)``: batches of at most ``CELLS`` pairs, with the rows (ascending) among which
    are the ``k`` nearest of each."""
    rows, step = np.arange(len(tx)), max(1, CELLS // len(tx))
    if len(tx) < CELL_FROM:
        yield from ((np.arange(s, min(s + step, len(qx))), rows) for s in range(0, len(qx), step))
        return
    pivots = tx[np.linspace(0, len(tx) - 1, int(np.sqrt(len(tx)))).astype(int)]
    near = lambda x: np.concatenate([_distances(x[s:s + 5000], pivots) for s in range(0, len(x), 5000)])
    r = near(tx)
    own = r.argmin(axis=1)
    r = r[rows, own]
    order = np.argsort(own, kind="stable")                       # the rows of a cell stay in their order
    ends = np.searchsorted(own[order], np.arange(len(pivots) + 1))
    filled = np.flatnonzero(np.diff(ends))
    low, high = np.minimum.reduceat(r[order], ends[filled]), np.maximum.reduceat(r[order], ends[filled])
    d = near(qx)[:, filled]
    length, reach = np.sqrt((qx * qx).sum(axis=1)), np.sqrt((pivots[filled] ** 2).sum(axis=1)) + high
    first = d.argmin(axis=1)
    by_cell, whole = np.argsort(first, kind="stable"), [np.empty(0, np.int64)]
    for batch in np.split(by_cell, np.flatnonzero(np.diff(first[by_cell])) + 1):
        # rows of the nearest cells, k at least, bound the distance of the k-th
        to = np.argsort(d[batch[0]], kind="stable")
        to = to[:1 + np.searchsorted(np.cumsum(np.diff(ends)[filled][to]), k)]
        some = np.concatenate([order[ends[c]:ends[c + 1]] for c in filled[to]])
        few = max(1, CELLS // max(len(some), len(filled)))
        for s in range(0, len(batch), few):
            q = batch[s:s + few]
            if len(some) > k:
                d2 = ((qx[q] ** 2).sum(axis=1)[:, None] + (tx[some] ** 2).sum(axis=1) - 2.0 * qx[q] @ tx[some].T)
                kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
                bound = np.sqrt(np.maximum(kth, 0) + 1e-12 * tx.shape[1] * (length[q] ** 2 + (tx[some] ** 2).sum(axis=1).max()))
            else:
                bound = np.full(len(q), np.inf)
            room = CELL_SLACK * (length[q][:, None] + reach)
            skip = np.maximum(d[q] - high, low - d[q]) > bound[:, None] + room      # not so for distances that are not numbers
            cells = filled[~skip.all(axis=0)]
            if 2 * (ends[cells + 1] - ends[cells]).sum() > len(tx):
                whole.append(q)                                  # little is skipped: with many others at once
                continue
            go = np.sort(np.concatenate([order[ends[c]:ends[c + 1]] for c in cells]))
            most = max(1, CELLS // len(go))
            yield from ((q[at:at + most], go) for at in range(0, len(q), most))
    whole = np.concatenate(whole)
    yield from ((whole[s:s + step], rows) for s in range(0, len(whole), step))


def _block_topk(k: int):
    def fn(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(t) == 0:
            return pd.DataFrame({"_qid": [], "_tid": [], "_ty": [], "_d": []})
        t = t.sort_values("_tid", kind="stable")
        tx, qx = (np.stack(c.to_numpy()).astype(np.float64) for c in (t["_tx"], q["_qx"]))
        tn, qn, qid = (tx * tx).sum(axis=1), (qx * qx).sum(axis=1), q["_qid"].to_numpy()
        tid, ty = t["_tid"].to_numpy(), t["_ty"].to_numpy()
        kk = min(k, len(t))
        out = []
        for batch, rows in _cells(tx, qx, kk):
            some, sn = (tx, tn) if len(rows) == len(tx) else (tx[rows], tn[rows])
            d2 = qn[batch][:, None] + sn[None, :] - 2.0 * qx[batch] @ some.T
            # the expansion only preselects: every row that may be as near as the k-th, with
            # room for its rounding, then exact differences, ties by the smallest id
            kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
            near = d2 <= (kth + 1e-12 * tx.shape[1] * (qn[batch] + tn.max()))[:, None]
            for row, of in enumerate(batch.tolist()):
                at = np.flatnonzero(near[row])
                d = np.sqrt(((some[at] - qx[of]) ** 2).sum(axis=1))
                best = np.argsort(d, kind="stable")[:kk]         # rows are in id order
                out.append((qid[of], rows[at[best]], d[best]))
        at = np.concatenate([a for _, a, _ in out])
        return pd.DataFrame({"_qid": np.repeat([i for i, _, _ in out], [len(a) for _, a, _ in out]),
                             "_tid": tid[at], "_ty": ty[at], "_d": np.concatenate([d for _, _, d in out])})
    return fn


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2.0 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _nearest_pivot(df: DataFrame, col: str, pivots: np.ndarray, among: list | None = None) -> DataFrame:
    """``df`` with ``_pivot``, the number of the nearest pivot, and ``_r``, its distance."""
    allowed = np.arange(len(pivots)) if among is None else np.array(sorted(among))

    def run(batches):
        for batch in batches:
            pivot, r = np.empty(0, np.int64), np.empty(0)
            if batch.num_rows:
                d = _distances(_matrix(batch.column(col)), pivots[allowed])
                at = d.argmin(axis=1)
                pivot, r = allowed[at], d[np.arange(len(at)), at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32()), pa.array(r)],
                                             names=[*batch.schema.names, "_pivot", "_r"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, _pivot int, _r double")


def _visits(own: DataFrame, pivots: np.ndarray, blocks: dict) -> DataFrame:
    """``(_qid, _qx, _pivot)`` for the blocks, besides its own, where a query may find one of its k nearest."""
    at = np.array(sorted(blocks))
    low, high = (np.array([blocks[p][i] for p in at.tolist()]) for i in (1, 2))

    def run(batches):
        for batch in batches:
            found = []
            if batch.num_rows:
                x = _matrix(batch.column("_qx"))
                d = _distances(x, pivots[at])
                bound = batch.column("_bound").to_numpy(zero_copy_only=False)
                bound = np.where(np.isnan(bound), np.inf, bound)
                room = SLACK * (np.sqrt((x * x).sum(axis=1))[:, None] + np.sqrt((pivots[at] ** 2).sum(axis=1)) + high)
                go = (np.maximum(d - high, low - d) <= bound[:, None] + room)
                go &= at != batch.column("_pivot").to_numpy()[:, None]
                found = [at[g].tolist() for g in go]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_qid"), batch.column("_qx"), pa.array(found, pa.list_(pa.int32()))],
                names=["_qid", "_qx", "to"])

    qtype = own.schema["_qid"].dataType.simpleString()
    sent = own.select("_qid", "_qx", "_pivot", "_bound").mapInArrow(run, f"_qid {qtype}, _qx array<double>, to array<int>")
    return sent.select("_qid", "_qx", F.explode("to").alias("_pivot"))


class KNNModel:
    def __init__(self, train: DataFrame, p: KNN):
        self.p = p
        t = _as_array(train, p.features)
        if p.row_id not in t.columns:
            t = t.withColumn(p.row_id, F.xxhash64(p.features, p.label))
        self.train = t.select(F.col(p.row_id).alias("_tid"), F.col(p.label).cast("double").alias("_ty"),
                              F.col("_x").cast("array<double>").alias("_tx"))

    @classmethod
    def saved(cls, table: DataFrame, p: KNN) -> "KNNModel":
        """From the training table of a saved model."""
        model = cls.__new__(cls)
        model.p, model.train = p, table
        return model

    def neighbours(self, query: DataFrame, qid: str) -> DataFrame:
        """``(qid, rank, neighbour id, label, distance)`` for the k nearest training rows."""
        k = self.p.k
        ship_package(query.sparkSession)
        q = _as_array(query, self.p.features).select(F.col(qid).alias("_qid"),
                                                     F.col("_x").cast("array<double>").alias("_qx"))
        rows, ids = q.agg(F.count("*"), F.count_distinct("_qid")).first()
        if rows != ids:
            raise ValueError(f"query ids must be unique: {rows} rows, {ids} ids")
        n_t = self.train.count()
        if n_t <= BLOCK_ROWS:
            one = F.lit(0)
            cands = self._searched(q.withColumn("_pivot", one), self.train.withColumn("_pivot", one), {0: n_t}, {0: rows})
        else:
            cands = self._pivoted(q, n_t)
        w = Window.partitionBy("_qid").orderBy("_d", "_tid")    # <= k x blocks rows per query
        return (cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select(F.col("_qid").alias(qid), "rank", F.col("_tid").alias("neighbor"),
                        F.col("_ty").alias("neighbor_label"), F.col("_d").alias("distance")))

    def _searched(self, visits: DataFrame, train: DataFrame, sizes: dict, asked: dict) -> DataFrame:
        """The k nearest rows of each block for every ``(_qid, _qx, _pivot)``; ``sizes`` and ``asked`` hold the
        training rows and the queries of each pivot's block (a row per block on the driver)."""
        spread = visits.sparkSession.sparkContext.defaultParallelism // max(1, len(asked))
        about = [(p, max(1, -(-sizes[p] // BLOCK_ROWS)), max(1, -(-n // BLOCK_ROWS), min(n, spread)))
                 for p, n in asked.items() if p in sizes]            # small inputs still use every core
        units = visits.sparkSession.createDataFrame(about, "_pivot int, _parts int, _chunks int")
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        qs = (visits.join(F.broadcast(units), "_pivot")              # at most MAX_PIVOTS rows
              .withColumn("_qb", deal("_qid", "_chunks")).withColumn("_tb", each("_parts"))
              .select("_pivot", "_qb", "_tb", "_qid", "_qx"))
        ts = (train.join(F.broadcast(units), "_pivot")
              .withColumn("_tb", deal("_tid", "_parts")).withColumn("_qb", each("_chunks"))
              .select("_pivot", "_qb", "_tb", "_tid", "_ty", "_tx"))
        qtype = visits.schema["_qid"].dataType.simpleString()
        ttype = train.schema["_tid"].dataType.simpleString()
        return (qs.groupBy("_pivot", "_qb", "_tb").cogroup(ts.groupBy("_pivot", "_qb", "_tb"))
                .applyInPandas(_block_topk(self.p.k), f"_qid {qtype}, _tid {ttype}, _ty double, _d double"))

    def _placed(self, n_t: int):
        """Pivots, the training rows with their pivot (written), and ``{pivot: (rows, smallest, largest)}``."""
        ensure_checkpoint_dir(self.train.sparkSession)
        count = min(MAX_PIVOTS, -(-n_t // BLOCK_ROWS))
        first = self.train.orderBy(F.xxhash64("_tid"), "_tid").limit(count).select("_tx").collect()    # <= MAX_PIVOTS
        pivots = np.unique(np.array([r["_tx"] for r in first], float), axis=0)
        placed = _nearest_pivot(self.train, "_tx", pivots).checkpoint()
        about = placed.groupBy("_pivot").agg(F.count(F.lit(1)), F.min("_r"), F.max("_r")).collect()
        return pivots, placed.drop("_r"), {r[0]: (r[1], r[2], r[3]) for r in about}

    def _pivoted(self, q: DataFrame, n_t: int) -> DataFrame:
        pivots, train, blocks = self._placed(n_t)
        own = _nearest_pivot(q, "_qx", pivots, list(blocks)).drop("_r").checkpoint()
        sizes = {p: b[0] for p, b in blocks.items()}
        count = lambda df: {r[0]: r[1] for r in df.groupBy("_pivot").count().collect()}
        near = self._searched(own, train, sizes, count(own)).checkpoint()
        w = Window.partitionBy("_qid").orderBy("_d", "_tid")
        bound = (near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == self.p.k)
                 .select("_qid", F.col("_d").alias("_bound")))
        visits = _visits(own.join(bound, "_qid", "left"), pivots, blocks).checkpoint()
        asked = count(visits)
        #: Query x block pairs in all, and those that were searched.
        self.pairs = (q.count() * len(blocks), sum(asked.values()) + own.count())
        return near.unionByName(self._searched(visits, train, sizes, asked)) if asked else near

    def predict(self, query: DataFrame, qid: str) -> DataFrame:
        """``(qid, prediction)``: majority / mean, or 1/d weighted (zero distances alone count)."""
        nb = self.neighbours(query, qid)
        if self.p.weights == "distance":
            has0 = F.max(F.when(F.col("distance") == 0, 1).otherwise(0)).over(Window.partitionBy(qid))
            w = F.when(has0 == 1, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)) \
                 .otherwise(1.0 / F.col("distance"))
        else:
            w = F.lit(1.0)
        nb = nb.withColumn("_w", w)
        if self.p.task == "classification":
            votes = nb.groupBy(qid, "neighbor_label").agg(F.sum("_w").alias("_v"))
            best = Window.partitionBy(qid).orderBy(F.desc("_v"), F.asc("neighbor_label"))
            return (votes.withColumn("_r", F.row_number().over(best)).where("_r = 1")
                    .select(qid, F.col("neighbor_label").alias("prediction")))
        return nb.groupBy(qid).agg((F.sum(F.col("_w") * F.col("neighbor_label")) / F.sum("_w"))
                                   .alias("prediction"))

    def transform(self, df: DataFrame, qid: str = "_row_id") -> DataFrame:
        return df.join(self.predict(df, qid), qid, "left")
