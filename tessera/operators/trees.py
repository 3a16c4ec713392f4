"""Histogram trees grown level by level: extra trees (G5) and regularised boosting.

The training rows are binned once (quantile borders per feature) and written to the
shared folder; a round keeps them as arrays with their gradients (persisted, in memory or
on disk).  A growing step is one job: every task assigns its rows to the nodes that are
open, adds up gradients, hessians and row counts by (tree, node, feature, bin) with numpy
and gives only the sums; the driver, or one shuffle by ranges of (tree, node, feature) if
they are many, adds the tasks' sums, a cumulative sum over the bins gives the gain of
every cut, and one best cut per open node is kept.  Many nodes and trees share a job.

* Boosting fits one tree a round (one a class for more than two classes: softmax) to the
  gradients of the loss; leaves are ``-rate * G / (H + l2)``.  Trees are grown by depth,
  or leaf-wise with ``max_leaves``: the open leaf of the largest gain is cut first, and
  the children of the best few are counted in one job.
* Extra trees draw one cut per node and feature, uniformly between the node's smallest
  and largest value of that feature (to the precision of the bins), over a random
  subset of the features, and take the best of these cuts; every tree sees all rows.

Rows are bound to trees by position only inside a task, nothing but sums leaves it.  A
model is a few arrays per tree and scores in Arrow batches.
"""

from __future__ import annotations

import dataclasses
import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

# Cells (node x feature x bin) that a task adds up at a time; more open nodes take several jobs.
CELLS = 4_000_000
# Sums that the driver adds up itself if all tasks together cannot give more (about 16 MB);
# beyond that a shuffle does.
DRIVER_SUMS = 2_000_000
# Cells of the children that are counted in one job of leaf-wise growth, before it is known which leaves are cut.
CELLS_AHEAD = 65_536
# Codes (row x feature) for which another task pays: a growing step is one short job, and its tasks start in turn.
PART_CODES = 1_000_000
# Codes that a task may hold once there are two tasks a core.
MOST_CODES = 16_000_000
# Rows of the arrays that a task works on at a time.
PACK_ROWS = 250_000
# Rounds after which the scores are written, so that a lost part is not computed from the first round on.
ROUNDS_AT_ONCE = 10


# --------------------------------------------------------------------- one tree
class Tree:
    """Nodes as parallel lists; node 0 is the root, ``feature`` is -1 at a leaf."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.depth, self.value = [-1], [0], [0], [0], [0], [None]
        self.border, self.gain = [0.0], [0.0]

    def cut(self, node: int, feature: int, bin_: int, border: float, gain: float) -> tuple[int, int]:
        a = len(self.feature)
        for child in (a, a + 1):
            for column, v in ((self.feature, -1), (self.bin, 0), (self.left, child), (self.right, child),
                              (self.depth, self.depth[node] + 1), (self.value, None), (self.border, 0.0), (self.gain, 0.0)):
                column.append(v)
        self.feature[node], self.bin[node], self.border[node], self.gain[node] = feature, bin_, border, gain
        self.left[node], self.right[node] = a, a + 1
        return a, a + 1

    def uncut(self, node: int) -> None:
        self.feature[node] = -1

    def node_of(self, x: np.ndarray, borders: bool = False, among: list | None = None) -> np.ndarray:
        """Leaf of every row of ``x``: bins, or the features themselves with ``borders``.  With ``among`` only
        rows of these nodes get theirs, others the node where they part from the way to all of them."""
        feature, left = np.array(self.feature, np.int64), np.array(self.left, np.int64)
        cut = np.array(self.border) if borders else np.array(self.bin, np.int64)
        if among is not None:
            way = np.zeros(len(feature), bool)
            way[among] = True
            depth = np.array(self.depth)
            for d in range(depth.max() - 1, -1, -1):
                n = np.flatnonzero((depth == d) & (feature >= 0))
                way[n] |= way[left[n]] | way[left[n] + 1]
            feature[~way] = -1
            feature[among] = -1
        node = np.zeros(len(x), np.int64)
        if feature[0] < 0 or not len(x):
            return node
        flat = np.ascontiguousarray(x).reshape(-1)
        rows, at, f = np.arange(len(x)), node, feature[node]
        base = rows * x.shape[1]
        while len(rows):
            at = left[at] + ~(flat[base + f] <= cut[at])          # the right child is next to the left one
            f = feature[at]
            inner = f >= 0
            if not inner.all():
                node[rows[~inner]] = at[~inner]
                rows, base, at, f = rows[inner], base[inner], at[inner], f[inner]
        return node

    def values(self, k: int) -> np.ndarray:
        return np.array([[0.0] * k if v is None else v for v in self.value], float).reshape(-1, k)

    def to_dict(self) -> dict:
        return {c: getattr(self, c) for c in ("feature", "bin", "left", "right", "depth", "value", "border", "gain")}

    @classmethod
    def from_dict(cls, d: dict) -> "Tree":
        tree = cls()
        tree.__dict__.update(d)
        return tree


# ------------------------------------------------------------------------- bins
def bin_edges(df: DataFrame, x: str, size: int, bins: int) -> list[np.ndarray]:
    """Per feature the smallest value, the borders between bins and the largest value; borders lie
    halfway between neighbouring quantiles, so a feature of few values has a bin for each."""
    probs = ", ".join(f"{i / bins!r}D" for i in range(bins + 1))
    row = df.agg(*[F.expr(f"percentile_approx(get({x}, {i}), array({probs}), {20 * bins})") for i in range(size)]).first()
    out = []
    for q in row:
        v = np.unique(np.array([0.0] if q is None else q, float))
        out.append(np.r_[v[0], (v[:-1] + v[1:]) / 2, v[-1]])
    return out


@dataclasses.dataclass
class Rows:
    """Arrays of some rows.  ``codes`` and ``score`` are held once for rows of equal codes, which score alike and fall into
    the same nodes; ``group`` is their number for every row, None if few are equal.  ``w`` is None where all are 1."""

    row: np.ndarray
    y: np.ndarray
    w: np.ndarray | None
    codes: np.ndarray
    group: np.ndarray | None
    score: np.ndarray

    def each(self, v: np.ndarray) -> np.ndarray:
        """Values of groups as values of rows."""
        return v if self.group is None else v[self.group]

    def weighted(self, v: np.ndarray) -> np.ndarray:
        return v if self.w is None else (v.T * self.w).T

    def targets(self, g: np.ndarray, h: np.ndarray | None, taken: np.ndarray | None = None) -> "Targets":
        """Gradients ``g`` (rows x width) and hessians ``h`` (1 or all of the columns; None: 1) of the rows ``taken``."""
        own = lambda v: v if v is None or taken is None else v[taken]
        g, h, group = own(g), own(h), own(self.group)
        if group is None:
            return Targets(own(self.codes), None, h, g)
        total = lambda v: np.stack([np.bincount(group, c, len(self.codes)) for c in v.T], axis=1)
        return Targets(self.codes, np.bincount(group, minlength=len(self.codes)).astype(float),
                       None if h is None else total(h), total(g))


@dataclasses.dataclass
class Targets:
    """What trees are grown from: codes, numbers of rows (None: 1 each), hessians (None: the numbers) and gradients."""

    codes: np.ndarray
    n: np.ndarray | None
    h: np.ndarray | None
    g: np.ndarray


def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """One of each group of equal rows and every row's group; the rows themselves and None if that spares less than half."""
    words = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    words[:, :codes.shape[1]] = codes
    group = np.zeros(len(codes), np.int64)
    for word in words.view(np.uint64).T:
        own = np.unique(word, return_inverse=True)[1]
        _, first, group = np.unique(group * len(codes) + own, return_index=True, return_inverse=True)
        if 2 * len(first) > len(codes):
            return codes, None
    return codes[first], group


def binned(df: DataFrame, edges: list[np.ndarray], start: list[float], count: int) -> RDD:
    """``Rows`` from the ``count`` rows ``(row, y, w, x)``, written to the shared folder: a written row holds the
    numbers of many rows, so that a job reads few values, not a few for every row."""
    size = len(edges)

    def pack(held):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(a.tobytes() for a in part)], pa.binary()) for part in zip(*held)],
                                          names=["row", "y", "w", "codes"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = np.stack([np.searchsorted(e[1:-1], x[:, f], side="left") for f, e in enumerate(edges)],
                           axis=1).astype(np.uint8)
            held.append([*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "y", "w")], own])
            count += len(own)
            if count >= PACK_ROWS:
                yield pack(held)
                held, count = [], 0
        if held:
            yield pack(held)

    def rows(r):
        w = np.frombuffer(r["w"], np.float64)
        codes, group = grouped(np.frombuffer(r["codes"], np.uint8).reshape(-1, size))
        return Rows(np.frombuffer(r["row"], np.int64), np.frombuffer(r["y"], np.float64), None if (w == 1).all() else w,
                    codes, group, np.tile(np.array(start, float), (len(codes), 1)))

    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(math.ceil(count * size / PART_CODES), 2 * cores), math.ceil(count * size / MOST_CODES))
    packed = df.coalesce(parts).mapInArrow(run, "row binary, y binary, w binary, codes binary").checkpoint()
    return packed.rdd.map(rows).persist(StorageLevel.MEMORY_AND_DISK)


def draw(*keys) -> np.ndarray:
    """Uniform numbers in [0, 1) from whole numbers, the same on every machine; the second key
    tells what is drawn (1 a node's features, 2 a cut, 3 a round's features, 4 its rows)."""
    x = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in keys:
            x = (x ^ np.asarray(k).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(32))
    return (x >> np.uint64(11)).astype(float) / 2.0 ** 53


# --------------------------------------------------------------- sums and cuts
@dataclasses.dataclass
class Step:
    """The open nodes whose sums one job adds up.  Their cells are numbered by ``(tree, node, feature, bin)``."""

    trees: dict
    nodes: dict                 # by tree
    features: dict              # by tree: a row of features for every node
    bins: int
    width: int
    per_tree: bool              # every tree has a column of gradients of its own

    def __post_init__(self):
        sizes = np.array([f.size for f in self.features.values()])
        #: Number of the first (node, feature) of every tree.
        self.first = dict(zip(self.features, np.cumsum(sizes) - sizes))
        self.groups = int(sizes.sum())

    def keys(self) -> np.ndarray:
        """``(tree, node, feature)`` of every group of ``bins`` cells."""
        return np.concatenate([np.stack([np.full(f.size, t), np.repeat(self.nodes[t], f.shape[1]), f.ravel()], axis=1)
                               for t, f in self.features.items()])

    def sums(self, parts) -> tuple[np.ndarray, np.ndarray]:
        """``(cell, (n, h, g...))`` of the cells that hold rows."""
        found = {t: np.zeros((self.width + 2, *f.shape, self.bins)) for t, f in self.features.items()}
        for rows in parts:
            for t, ns in self.nodes.items():
                self._add(found[t], rows, t, ns)
        found = {t: v.reshape(self.width + 2, -1) for t, v in found.items()}
        held = {t: np.flatnonzero(v[0]) for t, v in found.items()}
        return (np.concatenate([c + self.first[t] * self.bins for t, c in held.items()]),
                np.concatenate([found[t][:, c].T for t, c in held.items()]))

    def _add(self, found: np.ndarray, rows: Targets, t: int, ns: list) -> None:
        allowed, m = self.features[t], self.features[t].shape[1]
        place = np.full(len(self.trees[t].feature), -1)
        place[ns] = np.arange(len(ns))
        x, at, take = rows.codes, place[self.trees[t].node_of(rows.codes, among=ns)], slice(None)
        if (at < 0).any():
            take = np.flatnonzero(at >= 0)
            x, at = x[take], at[take]
        if not len(at):
            return
        columns = [t] if self.per_tree else range(self.width)
        h = rows.h if rows.h is None else rows.h[take, t if self.per_tree else 0]
        kept = [rows.n if rows.n is None else rows.n[take], h, *[rows.g[take, c] for c in columns]]
        if (allowed == allowed[0]).all():                        # then the features take their turns
            for j, f in enumerate(allowed[0].tolist()):
                self._count(found[:, :, j], at * self.bins + x[:, f], kept)
        else:
            cell = (at * (m * self.bins))[:, None] + np.arange(m) * self.bins + x[np.arange(len(x))[:, None], allowed[at]]
            self._count(found, cell.ravel(), [None if v is None else np.repeat(v, m) for v in kept])

    @staticmethod
    def _count(found: np.ndarray, cell: np.ndarray, kept: list) -> None:
        for c, v in enumerate(kept):
            if v is not None or c == 0:                          # hessians that are None are the numbers of rows
                sums = np.bincount(cell, v, found[0].size).reshape(found[0].shape)
            found[c] += sums


def added(parts: list, first: int, groups: int, bins: int, width: int) -> np.ndarray:
    """Sums ``(group, bin, (n, h, g...))`` of ``groups`` groups from ``first`` on; ``parts`` have ``(cell, sums)`` in the
    order of the cells."""
    out = np.zeros((groups * bins, width + 2))
    for cell, sums in parts:
        a, b = np.searchsorted(cell, [first * bins, (first + groups) * bins])
        out[cell[a:b] - first * bins] += sums[a:b]
    return out.reshape(groups, bins, width + 2)


def best_cuts(step: Step, parts: list, first: int, groups: int, gain, cut_of=None) -> dict:
    """Best cut and totals of every open node: ``(gain, feature, bin, left sums, all sums)``, ``bin`` -1 if it has none.

    ``gain(left, right)`` takes sums ``(n, h, g...)`` along the last axis; ``cut_of(tree, node,
    feature, lo, hi)`` names the only cut that counts, else all of them do."""
    out: dict = {}
    at_once = max(1, CELLS // step.bins // (step.width + 2))
    keys = step.keys()
    for a in range(first, first + groups, at_once):
        some = min(at_once, first + groups - a)
        dense = added(parts, a, some, step.bins, step.width)
        key, held = keys[a:a + some], dense[:, :, 0] > 0
        if not held.any(axis=1).all():
            key, dense, held = key[held.any(axis=1)], dense[held.any(axis=1)], held[held.any(axis=1)]
        if not len(key):
            continue
        left = np.cumsum(dense, axis=1)
        total = left[:, -1:]
        score, all_ = gain(left, total - left), np.arange(len(key))
        if cut_of:
            lo, hi = held.argmax(axis=1), step.bins - 1 - held[:, ::-1].argmax(axis=1)
            only = cut_of(*key.T, lo, hi)
            score = np.where((np.arange(step.bins) == only[:, None]) & (lo < hi)[:, None], score, -np.inf)
        pick = score.argmax(axis=1)
        top = score[all_, pick]
        ok = np.isfinite(top) & (top > 0)
        top, cut = np.where(ok, top, -1.0), np.where(ok, pick, -1)
        order = np.lexsort((key[:, 2], -top, key[:, 1], key[:, 0]))
        new = np.r_[True, (np.diff(key[order][:, :2], axis=0) != 0).any(axis=1)]
        for i in order[new].tolist():
            t, n, f = key[i].tolist()
            _keep(out, (t, n), (float(top[i]), f, int(cut[i]), left[i, pick[i]].copy(), total[i, 0].copy()))
    return out


def _keep(out: dict, node: tuple, found: tuple) -> None:
    """The larger gain, of equal ones that of the first feature."""
    out[node] = max(out.get(node, found), found, key=lambda c: (c[0], -c[1]))


def cuts_of(rows: RDD, step: Step, gain, cut_of, most: float) -> dict:
    """``best_cuts`` over all tasks' sums, of which there are ``most`` at most."""
    if most <= DRIVER_SUMS:
        parts = rows.mapPartitions(lambda it: [step.sums(it)]).collect()
        return best_cuts(step, parts, 0, step.groups, gain, cut_of)
    ranges = min(step.groups, math.ceil(step.groups * step.bins * (step.width + 2) / CELLS) + rows.getNumPartitions())
    borders = [step.groups * r // ranges for r in range(ranges + 1)]

    def dealt(i, it):
        cell, sums = step.sums(it)
        at = np.searchsorted(cell, np.array(borders) * step.bins)
        return [(r, (i, cell[a:b], sums[a:b])) for r, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]

    def best(it):
        by_range: dict = {}
        for r, part in it:
            by_range.setdefault(r, []).append(part)
        for r, parts in by_range.items():
            parts.sort(key=lambda p: p[0])                      # tasks' sums are added in one order
            yield best_cuts(step, [p[1:] for p in parts], borders[r], borders[r + 1] - borders[r], gain, cut_of)

    out: dict = {}
    for found in rows.mapPartitionsWithIndex(dealt).partitionBy(ranges, int).mapPartitions(best).collect():   # a row per node
        for p, c in found.items():
            _keep(out, p, c)
    return out


# ---------------------------------------------------------------------- growing
class Grower:
    """Grows some trees at once over the same rows."""

    def __init__(self, rows: RDD, edges, width: int, gain, value, *, max_depth: int, max_leaves: int | None, min_split: int,
                 features, count: int, per_tree: bool = False, cut_of=None):
        self.rows, self.edges, self.width, self.count, self.per_tree = rows, edges, width, count, per_tree
        self.gain, self.value, self.features, self.cut_of = gain, value, features, cut_of
        self.max_depth, self.max_leaves, self.min_split = max_depth, max_leaves, min_split
        self.bins, self.tasks = max(len(e) for e in edges) - 1, rows.getNumPartitions()
        self.ahead = max(1, CELLS_AHEAD // (2 * self.bins * len(edges)))

    def _cuts(self, trees: dict, nodes: list) -> dict:
        found, some, cells = {}, {}, 0
        chosen = {p: self.features(*p) for p in nodes}
        for p in [*nodes, None]:
            size = self.bins * len(chosen[p]) if p else 0
            if some and (p is None or cells + size > CELLS):
                # a row falls into one node of a tree at most, so it fills no more cells than it has features
                features = {t: np.array([chosen[t, n] for n in ns]) for t, ns in some.items()}
                most = min(cells * self.tasks, self.count * len(some) * max(f.shape[1] for f in features.values()))
                step = Step({t: trees[t] for t in some}, some, features, self.bins, self.width, self.per_tree)
                found |= cuts_of(self.rows, step, self.gain, self.cut_of, most * (self.width + 2))
                some, cells = {}, 0
            if p:
                some.setdefault(p[0], []).append(p[1])
                cells += size
        return found

    def grow(self, count: int) -> list[Tree]:
        """``count`` trees; ``targets`` and ``features`` know them by their number."""
        trees = {t: Tree() for t in range(count)}
        leaves = {t: 1 for t in trees}
        children: dict = {}
        found = self._cuts(trees, [(t, 0) for t in trees])
        stats = {p: c[4] for p, c in found.items()}
        known = {p: c for p, c in found.items() if c[2] >= 0}
        queue = {t: [(-known[t, 0][0], 0)] if (t, 0) in known else [] for t in trees}   # leaves by descending gain
        ahead = {t: list(q) for t, q in queue.items()}          # cuts whose children are not counted yet
        ranks = {t: dict((n, g) for g, n in q) for t, q in queue.items()}
        while any(queue.values()):
            wanted = []
            for t in [t for t, q in queue.items() if q]:
                some = self._wanted(queue[t], ahead[t], ranks[t])
                ahead[t] = [x for x in ahead[t] if x not in some]
                for _, node in some:
                    gain, f, b, left, total = known[t, node]
                    pair = children[t, node] = trees[t].cut(node, f, b, float(self.edges[f][1 + b]), gain)
                    for child, s in zip(pair, (left, total - left)):
                        stats[t, child] = s
                        if trees[t].depth[child] < self.max_depth and s[0] >= self.min_split:
                            ranks[t][child] = ranks[t][node]
                            wanted.append((t, child))
            found = {p: c for p, c in self._cuts(trees, wanted).items() if c[2] >= 0}
            known |= found
            for t, node in wanted:
                if (t, node) not in found:
                    del ranks[t][node]
                    continue
                ranks[t][node] = max(ranks[t][node], -found[t, node][0])
                ahead[t].append((-found[t, node][0], node))
            for t in list(queue):
                queue[t] = self._take(t, trees[t], queue[t], known, children, leaves)
        for (t, node) in children:                     # counted ahead, but never taken
            if trees[t].value[node] != "cut":
                trees[t].uncut(node)
        for t, tree in trees.items():
            tree.value = [None if f >= 0 else self.value(stats[t, n]) if (t, n) in stats else None
                          for n, f in enumerate(tree.feature)]
        return list(trees.values())

    def _wanted(self, q: list, ahead: list, ranks: dict) -> list:
        """Leaves whose children are counted now: all of them, or those that a tree of ``max_leaves`` may reach.  It takes
        them by the smallest gain on the way to each (``ranks``), so no more than its room of the best ones."""
        if self.max_leaves is None:
            return sorted(ahead)
        best = set(heapq.nsmallest(self.max_leaves - 1, ranks, key=lambda n: (ranks[n], n)))
        some = heapq.nsmallest(self.ahead, [x for x in ahead if x[1] in best], key=lambda x: (ranks[x[1]], x[1]))
        return some + [x for x in q[:1] if x in ahead and x not in some]

    def _take(self, t, tree, q, known, children, leaves) -> list:
        """Cut leaves by descending gain as long as their children are counted; what is left open.
        Without a limit of leaves the order does not matter, and all that are counted are cut."""
        waiting = []
        while q and (self.max_leaves is None or leaves[t] < self.max_leaves):
            gain, node = heapq.heappop(q)
            if (t, node) not in children:
                waiting.append((gain, node))
                if self.max_leaves is not None:
                    break                                # its children are counted first
                continue
            tree.value[node] = "cut"
            leaves[t] += 1
            for child in children[t, node]:
                if (t, child) in known:
                    heapq.heappush(q, (-known[t, child][0], child))
        if self.max_leaves is not None and leaves[t] >= self.max_leaves:
            return []
        return sorted(q + waiting)


def newton_gain(l2: float, min_leaf: int, min_hessian: float, first_order: bool = False):
    """Gain of a cut by squared gradient sums over hessians (or over row counts)."""
    def gain(left, right):
        part = lambda s: (s[..., 2:] ** 2).sum(axis=-1) / np.maximum(
            (s[..., 0] if first_order else s[..., 1]) + l2, 1e-300)
        ok = ((left[..., 0] >= min_leaf) & (right[..., 0] >= min_leaf)
              & (left[..., 1] >= min_hessian) & (right[..., 1] >= min_hessian))
        return np.where(ok, part(left) + part(right) - part(left + right), -np.inf)
    return gain


# ------------------------------------------------------------------------ models
class TreeEnsembleModel:
    """A fitted ensemble; ``outputs`` scores per row, turned into predictions by ``link``."""

    def __init__(self, trees: list[list[Tree]], start: list[float], link: str, n_features: int, features: str = "features"):
        #: One list of trees a round, one tree an output (or a tree of all outputs).
        self.trees, self.start, self.link, self.n_features, self.features = trees, start, link, n_features, features

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (as Spark's models name it)
        total = np.zeros(self.n_features)
        for tree in (t for r in self.trees for t in r):
            own = np.bincount([f for f in tree.feature if f >= 0], [g for f, g in zip(tree.feature, tree.gain) if f >= 0],
                              self.n_features)
            total += own / own.sum() if own.sum() else 0
        return DenseVector(total / total.sum() if total.sum() else total)

    def add(self, score: np.ndarray, round_: list[Tree], x: np.ndarray, borders: bool = False) -> None:
        """Add a round's trees to the scores of rows."""
        k = score.shape[1]
        if len(round_) == k:
            for j, tree in enumerate(round_):
                score[:, j] += tree.values(1)[tree.node_of(x, borders), 0]
        else:
            score += round_[0].values(k)[round_[0].node_of(x, borders)]

    def outputs_of(self, score: np.ndarray) -> np.ndarray:
        """Class probabilities, or the value itself for ``link`` identity."""
        if self.link == "identity":
            return score
        if self.link == "mean":
            return score / np.maximum(score.sum(axis=1, keepdims=True), 1e-300)
        if self.link == "logistic":
            p = 1 / (1 + np.exp(-score))
            return np.c_[1 - p, p]
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _outputs(self) -> Column:
        def score(x: pd.Series) -> pd.Series:
            x = np.stack(x.to_numpy()) if len(x) else np.zeros((0, self.n_features))
            out = np.tile(np.array(self.start, float), (len(x), 1))
            for round_ in self.trees:
                self.add(out, round_, x, borders=True)
            return pd.Series(list(self.outputs_of(out)))
        return F.pandas_udf(score, "array<double>")(vector_to_array(F.col(self.features)))

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        if self.link == "identity":
            return df.withColumn("prediction", F.get(self._outputs(), F.lit(0)))
        taken = set(df.columns)
        at = next(c for c in (f"_out{i}" for i in range(len(taken) + 1)) if c not in taken)
        out = df.withColumn(at, self._outputs())
        best = F.array_position(at, F.array_max(at)) - 1              # the first of equal ones
        return (out.withColumn("probability", array_to_vector(at)).withColumn("prediction", best.cast("double"))
                .drop(at))

    def staged(self, df: DataFrame, label: str = "label") -> DataFrame:
        """``(iteration, loss, score)`` after every round, in one pass over the rows: log loss and accuracy,
        or mean squared error and R² (1 - error / variance)."""
        ship_package(df.sparkSession)
        src = df.select(vector_to_array(F.col(self.features)).alias("x"), F.col(label).cast("double").alias("y"))

        def run(batches):
            sums = np.zeros((len(self.trees), 2))
            y_sums = np.zeros(3)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y = batch.column("y").to_numpy(zero_copy_only=False)
                y_sums += len(y), y.sum(), (y ** 2).sum()
                score = np.tile(np.array(self.start, float), (len(x), 1))
                for i, round_ in enumerate(self.trees):
                    self.add(score, round_, x, borders=True)
                    out = self.outputs_of(score)
                    if self.link == "identity":
                        sums[i] += ((out[:, 0] - y) ** 2).sum(), 0
                    else:
                        p = out[np.arange(len(y)), y.astype(int)]
                        sums[i] += -np.log(np.maximum(p, 1e-15)).sum(), (out.argmax(axis=1) == y).sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1]),
                 *[pa.array(np.full(len(sums), v)) for v in y_sums]], names=["iteration", "loss", "hit", "n", "y", "y2"])

        rows = src.mapInArrow(run, "iteration int, loss double, hit double, n double, y double, y2 double")
        total = rows.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in ("loss", "hit", "n", "y", "y2")])
        spread = F.col("y2") - F.col("y") ** 2 / F.col("n")
        score = (F.when(spread > 0, 1 - F.col("loss") / spread) if self.link == "identity"
                 else F.col("hit") / F.col("n"))
        return total.select("iteration", (F.col("loss") / F.col("n")).alias("loss"), score.alias("score"))

    def to_dict(self) -> dict:
        return {"trees": [[t.to_dict() for t in r] for r in self.trees], "start": self.start, "link": self.link,
                "n_features": self.n_features, "features": self.features}

    @classmethod
    def from_dict(cls, d: dict) -> "TreeEnsembleModel":
        return cls([[Tree.from_dict(t) for t in r] for r in d["trees"]], d["start"], d["link"], d["n_features"],
                   d["features"])


class _Ensemble:
    def _prepared(self, df: DataFrame):
        """Rows ``(row, y, w, x)``, the number of features, the label sums and the number of rows."""
        ensure_checkpoint_dir(df.sparkSession)
        ship_package(df.sparkSession)
        x = vector_to_array(F.col(self.features))
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(self.label).cast("double").alias("y"),
                         w.alias("w"), x.alias("x")).where(F.col("y").isNotNull())
        size, total, mean, count = rows.agg(F.max(F.size("x")), F.sum("w"), F.sum(F.col("w") * F.col("y")) / F.sum("w"),
                                            F.count("*")).first()
        if not size:
            raise ValueError("no rows with features and a label to fit on")
        return rows, size, total, mean, count


class BoostedTrees(_Ensemble):
    """Gradient boosting on histograms.  ``max_leaves`` grows leaf-wise; ``first_order`` chooses cuts by
    squared error on the gradients (leaves stay Newton steps)."""

    def __init__(self, task: str, n_classes: int = 2, *, rounds: int = 100, rate: float = 0.1, max_depth: int = 6,
                 max_leaves: int | None = None, l2: float = 0.0, min_leaf: int = 1, min_split: int = 2,
                 min_hessian: float = 0.0, subsample: float = 1.0, colsample: float = 1.0, first_order: bool = False,
                 bins: int = 64, features: str = "features", label: str = "label", weight: str | None = None,
                 seed: int = 42):
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    def fit(self, df: DataFrame) -> TreeEnsembleModel:
        rows, size, total, mean, count = self._prepared(df)
        if self.task != "classification":
            link, start = "identity", [float(mean)]
        elif self.n_classes <= 2:
            p = min(max(float(mean), 1e-6), 1 - 1e-6)
            link, start = "logistic", [math.log(p / (1 - p))]
        else:
            share = dict(rows.groupBy("y").agg(F.sum("w") / F.lit(total)).collect())     # one row per class
            link = "softmax"
            start = [math.log(max(share.get(float(k), 0.0), 1e-6)) for k in range(self.n_classes)]
        k = len(start)
        edges = bin_edges(rows, "x", size, self.bins)
        model = TreeEnsembleModel([], start, link, size, self.features)
        state, fresh = binned(rows, edges, start, count), []
        used = max(1, round(self.colsample * size))
        try:
            for i in range(self.rounds):
                by_draw = np.argsort(draw(self.seed, 3, i, np.arange(size)))[:used]
                targets = state.map(self._targets(model, list(fresh), i)).persist(StorageLevel.MEMORY_AND_DISK)
                grower = Grower(
                    targets, edges, 1, newton_gain(self.l2, self.min_leaf, self.min_hessian, self.first_order),
                    lambda s: [float(-self.rate * s[2] / (s[1] + self.l2)) if s[1] + self.l2 > 0 else 0.0],
                    max_depth=self.max_depth, max_leaves=self.max_leaves, min_split=self.min_split,
                    features=lambda t, n, f=np.sort(by_draw): f, count=count, per_tree=link == "softmax")
                fresh.append(grower.grow(k))
                targets.unpersist()
                model.trees.append(fresh[-1])
                if len(fresh) == ROUNDS_AT_ONCE and i + 1 < self.rounds:
                    last, state, fresh = state, self._scored(state, model, fresh), []
                    last.unpersist()
        finally:
            state.unpersist()
        return model

    def _targets(self, model, fresh, i):
        link, seed, share = model.link, self.seed, self.subsample
        own = TreeEnsembleModel([], model.start, link, model.n_features)        # what the tasks need of it

        def targets(rows: Rows) -> Targets:
            score = rows.score.copy()
            for round_ in fresh:
                own.add(score, round_, rows.codes)
            taken = np.flatnonzero(draw(seed, 4, i, rows.row) < share) if share < 1 else None
            if link == "identity":
                return rows.targets(rows.weighted(rows.each(score) - rows.y[:, None]),
                                    rows.w if rows.w is None else rows.w[:, None], taken)
            p = rows.each(own.outputs_of(score))
            hit = rows.y[:, None] == np.arange(p.shape[1])
            if link == "logistic":
                p, hit = p[:, 1:], rows.y[:, None]
            return rows.targets(rows.weighted(p - hit), rows.weighted(p) * (1 - p), taken)
        return targets

    @staticmethod
    def _scored(state: RDD, model, fresh) -> RDD:
        """``state`` with the scores after the trees of ``fresh``, written."""
        own = TreeEnsembleModel([], model.start, model.link, model.n_features)

        def scored(rows: Rows) -> Rows:
            score = rows.score.copy()
            for round_ in fresh:
                own.add(score, round_, rows.codes)
            return dataclasses.replace(rows, score=score)
        out = state.map(scored).persist(StorageLevel.MEMORY_AND_DISK)
        out.checkpoint()
        out.count()
        return out


class ExtraTrees(_Ensemble):
    """Extremely randomised trees over all rows (no bootstrap)."""

    def __init__(self, task: str, n_classes: int = 2, *, trees: int = 200, max_depth: int = 30, min_leaf: int = 1,
                 min_split: int = 2, subset: float | None = None, bins: int = 64, features: str = "features",
                 label: str = "label", weight: str | None = None, seed: int = 42):
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    def fit(self, df: DataFrame) -> TreeEnsembleModel:
        rows, size, _, _, count = self._prepared(df)
        classes = max(2, self.n_classes) if self.task == "classification" else 0
        edges = bin_edges(rows, "x", size, self.bins)
        m = size if self.subset == 1.0 else max(1, int(math.sqrt(size)) if self.subset is None else round(self.subset * size))
        seed = self.seed

        def targets(rows: Rows) -> Targets:
            g = 1.0 * (rows.y[:, None] == np.arange(classes)) if classes else rows.y[:, None]
            return rows.targets(rows.weighted(g), rows.w if rows.w is None else rows.w[:, None])

        rows = binned(rows, edges, [0.0], count)
        state = rows.map(targets).persist(StorageLevel.MEMORY_AND_DISK)

        def cut_of(tree, node, feature, lo, hi):
            return random_cuts(edges, seed, tree, node, feature, lo, hi)

        def value(s):
            return [float(v) for v in s[2:] / max(s[1], 1e-300) / self.trees]

        grower = Grower(state, edges, max(classes, 1), newton_gain(0.0, self.min_leaf, 0.0), value,
                        max_depth=self.max_depth, max_leaves=None, min_split=self.min_split, cut_of=cut_of,
                        features=lambda t, n: np.sort(np.argsort(draw(seed, 1, t, n, np.arange(size)))[:m]), count=count)
        try:
            grown = grower.grow(self.trees)
        finally:
            state.unpersist()
            rows.unpersist()
        link = "mean" if classes else "identity"
        return TreeEnsembleModel([[t] for t in grown], [0.0] * max(classes, 1), link, size, self.features)


def random_cuts(edges, seed: int, tree, node, feature, lo, hi) -> np.ndarray:
    """The bin after which a node cuts a feature: the border next above a number drawn uniformly between
    the node's smallest and largest value (known to their bins ``lo`` and ``hi``)."""
    out = np.zeros(len(tree), np.int64)
    u = draw(seed, 2, tree, node, feature)
    for f in np.unique(feature).tolist():
        at = np.flatnonzero(feature == f)
        e = edges[f]
        low, high = e[lo[at]], e[np.minimum(hi[at] + 1, len(e) - 1)]
        out[at] = np.searchsorted(e[1:-1], low + u[at] * (high - low), side="left")
    return np.clip(out, lo, np.maximum(hi - 1, lo))
