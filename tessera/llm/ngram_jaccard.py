"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Method
1. Every text becomes its set of ``n``-word shingles.  Texts with equal sets
   form one *class*; all later work is on classes, so exact copies cost nothing
   and are never paired with each other.
2. A signature of ``trees * depth`` min-hashes labels the class in each tree of
   the forest.  The nodes of a tree at the shallowest admissible prefix length
   are the join keys; nodes with one class are dropped before signatures move.
3. The classes below a node are cut into blocks of at most ``block_rows``, and
   each pair of blocks is one unit of work, so a node that holds a third of all
   classes is spread over many tasks and no task holds a whole group.  A unit
   looks at pairs of labels: a pair belongs to the first tree in which it shares
   the shallowest prefix, and its longest common prefix over all trees is the
   prefix length at which the forest would find it.
4. Prefixes start at full length and get shorter until the estimated recall
   reaches the target.  The estimate weighs each pair whose signatures agree in
   a share of at least the threshold by the inverse of the chance that the
   forest finds such a pair (Horvitz-Thompson).  The shallowest length is the
   longest one with which a pair exactly at the threshold is found with the
   target probability, so the target also holds for the worst case.
5. Only classes with a pair left get their texts, and every remaining pair is
   verified exactly on the shingle sets.  Pairs whose set sizes alone exclude
   the threshold, or whose signatures agree in a share below ``threshold -
   slack``, are not verified (the slack is four standard deviations of the
   share at the threshold by default; the loss is far below 1 - target).
6. A unit returns link counts per class and a spanning forest of its links, not
   its pairs; counts are summed and the forests give components.

Defined results: null or word-less texts link with nothing (their own class,
0 links); texts shorter than ``n`` words have one shingle of all words; rows
with a null id are returned with null class and 0 links; rows that repeat id
and text count as copies and have equal results; other columns are not touched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm import shingles
from tessera.llm.blocks import dealt, in_units, intersections, pairs, roots, unit_intersections, unit_rows
from tessera.llm.columns import apart
from tessera.llm.components import components
from tessera.llm.store import written

TREES, DEPTH = 16, 6
MINHASH = shingles.MinHash(TREES * DEPTH)


def forest_recall(similarity, length: int, trees: int = TREES):
    """Chance that two sets of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - np.power(similarity, length)) ** trees


def shallowest(threshold: float, target: float) -> int:
    """Longest prefix length that finds a pair at the threshold with the target probability."""
    fit = [d for d in range(1, DEPTH + 1) if forest_recall(threshold, d) >= target]
    return max(fit, default=1)


# -- signatures ---------------------------------------------------------------
def signatures(docs: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """``(doc_id, text_hash, key, size, sig)``; key and sig are null without words."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                      F.col(text).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            key, size, sig = [None] * len(texts), np.zeros(len(texts), np.int32), [None] * len(texts)
            for part in shingles.groups(texts):
                sets = [shingles.shingle_set(t, n) for t in texts[part]]
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                sizes = np.array([len(sets[i]) for i in full])
                rows = MINHASH(np.concatenate([sets[i] for i in full]), sizes).view(np.int32).tolist()
                for i, c, row in zip(full, sizes, rows):
                    at = part.start + i
                    key[at], size[at], sig[at] = xxhash.xxh3_128_digest(sets[i].tobytes()), c, row
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(key, pa.binary()),
                 pa.array(size), pa.array(sig, pa.list_(pa.int32()))],
                names=["doc_id", "text_hash", "key", "size", "sig"])

    return src.mapInArrow(run, "doc_id long, text_hash long, key binary, size int, sig array<int>")


# -- pairs of labels -----------------------------------------------------------
def _judge(i, j, tree, size, sig, threshold: float, slack: float, least: int):
    """Pairs to verify, their longest common prefix over all trees, and their agreement."""
    keep, depth, share = [], [], []
    for s in range(0, len(i), 100_000):
        a, b = i[s:s + 100_000], j[s:s + 100_000]
        fits = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
        at = np.flatnonzero(fits)
        same = (sig[a[at]] == sig[b[at]])
        agree = same.mean(axis=1) if len(at) else np.empty(0)
        lcp = np.minimum.accumulate(same.reshape(-1, TREES, DEPTH), axis=2).sum(axis=2)
        first = (lcp >= least).argmax(axis=1)
        longest = lcp.max(axis=1) if len(at) else np.empty(0, np.int64)
        ok = (agree >= threshold - slack) & (first == tree[a[at]]) & (longest >= least)
        keep.append(at[ok] + s)
        depth.append(longest[ok])
        share.append(agree[ok])
    if not keep:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(keep), np.concatenate(depth), np.concatenate(share)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, TREES * DEPTH)


def _candidates(units: DataFrame, threshold: float, slack: float, least: int) -> DataFrame:
    """Rows of units that have a pair to verify, with the deepest prefix of such a pair.

    Also gives, on the row that is first in the pair, the number of pairs whose
    signatures agree in a share of the threshold or more, by prefix length, and
    their Horvitz-Thompson total.
    """
    columns = ["unit", "tree", "block", "diagonal", "key", "size", "sig"]
    lengths = range(least, DEPTH + 1)

    def run(batches):
        for table in unit_rows(batches, columns):
            unit, block = table.column("unit").to_numpy(), table.column("block").to_numpy()
            i, j = pairs(unit, block, table.column("diagonal").to_numpy())
            tree, size = table.column("tree").to_numpy(), table.column("size").to_numpy()
            ok, depth, share = _judge(i, j, tree, size, _matrix(table.column("sig")), threshold, slack, least)
            deepest = np.zeros(table.num_rows, np.int32)
            np.maximum.at(deepest, i[ok], depth)
            np.maximum.at(deepest, j[ok], depth)
            near = share >= threshold
            found = {d: np.bincount(i[ok][near & (depth == d)], minlength=table.num_rows) for d in lengths}
            total = np.bincount(i[ok][near], 1 / forest_recall(share[near], least), table.num_rows)
            rows = np.flatnonzero(deepest)
            yield pa.RecordBatch.from_arrays(
                [table.column(c).combine_chunks().take(pa.array(rows)) for c in columns]
                + [pa.array(deepest[rows])] + [pa.array(found[d][rows], pa.int64()) for d in lengths]
                + [pa.array(total[rows], pa.float64())],
                names=[*columns, "deepest", *(f"found{d}" for d in lengths), "total"])

    schema = ("unit long, tree int, block int, diagonal boolean, key binary, size int, sig array<int>, "
              "deepest int, " + ", ".join(f"found{d} long" for d in lengths) + ", total double")
    return units.mapInArrow(run, schema)


def _verify(units: DataFrame, threshold: float, slack: float, least: int, length: int, n: int) -> DataFrame:
    """``(key, links, other)``: verified links of the class in a unit, and its spanning partner."""
    columns = ["unit", "tree", "block", "diagonal", "key", "size", "sig", "copies", "text"]

    def run(batches):
        for table in unit_rows(batches, columns):
            unit, key = table.column("unit").to_numpy(), table.column("key").to_pylist()
            # a class whose id is shared by other texts may arrive more than once, or as another text
            texts = table.column("text").to_pylist()
            sets = [shingles.shingle_set(t or b"", n) for t in texts]
            rows, seen = [], set()
            for r, (u, k, s) in enumerate(zip(unit.tolist(), key, sets)):
                if (u, k) not in seen and xxhash.xxh3_128_digest(s.tobytes()) == k:
                    seen.add((u, k))
                    rows.append(r)
            sets = [sets[r] for r in rows]
            at = pa.array(rows, pa.int64())
            table = pa.table({c: table.column(c).take(at) for c in columns[:-1]})
            key = [key[r] for r in rows]
            unit, block = unit[rows], table.column("block").to_numpy()
            i, j = pairs(unit, block, table.column("diagonal").to_numpy())
            size, copies = table.column("size").to_numpy(), table.column("copies").to_numpy()
            ok, depth, _ = _judge(i, j, table.column("tree").to_numpy(), size,
                                  _matrix(table.column("sig")), threshold, slack, least)
            ok = ok[depth >= length]
            i, j = i[ok], j[ok]
            both = unit_intersections(sets, unit, i, j)
            # both / (|a| + |b| - both) >= threshold
            link = both >= threshold * (size[i].astype(np.int64) + size[j] - both) - 1e-9
            i, j = i[link], j[link]
            links = (np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))).astype(np.int64)
            root = roots(len(rows), i, j)
            out = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[r] for r in out], pa.binary()), pa.array(links[out]),
                 pa.array([key[root[r]] if root[r] != r else None for r in out], pa.binary())],
                names=["key", "links", "other"])

    return units.mapInArrow(run, "key binary, links long, other binary")


# -- the join -----------------------------------------------------------------
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, n: int = 5,
                    threshold: float = 0.8, target_recall: float = 0.999, slack: float | None = None,
                    block_rows: int = 512) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, class_id, component_id, n_links, kept``.

    ``class_id`` is the smallest id with the same shingle set, ``component_id``
    the smallest id reachable by links, ``n_links`` the number of other rows
    linked directly (copies of the same class included), ``kept`` true for one
    id and text of each component.
    """
    spark = docs.sparkSession
    slack = 4 * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH)) if slack is None else slack
    least = shallowest(threshold, target_recall)
    rows = written(signatures(docs, id_col, text, n), "ngram-signatures")
    named = rows.where("doc_id IS NOT NULL")
    classes = written(
        named.where("key IS NOT NULL").groupBy("key").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"),
            F.min("size").alias("size"), F.first("sig").alias("sig")), "ngram-classes")

    label = [F.struct(F.lit(t).alias("tree"),
                      F.xxhash64(F.lit(t), F.slice("sig", t * DEPTH + 1, least)).alias("node"))
             for t in range(TREES)]
    nodes = classes.select("key", F.inline(F.array(*label)))
    units = dealt(nodes, ["tree", "node"], "key", block_rows).drop("node")
    units = in_units(units.join(classes.select("key", "size", "sig"), "key"))
    found = written(_candidates(units, threshold, slack, least), "ngram-candidates")

    lengths = range(least, DEPTH + 1)
    sums = found.agg(*[F.coalesce(F.sum(f"found{d}"), F.lit(0)) for d in lengths],
                     F.coalesce(F.sum("total"), F.lit(0.0))).first()
    length = DEPTH
    while length > least and not sum(sums[length - least:-1]) >= target_recall * sums[-1] > 0:
        length -= 1     # without any such pair nothing can be estimated: go to the shallowest

    need = found.where(F.col("deepest") >= length).join(
        classes.select("key", "copies", F.col("first.doc_id").alias("at"),
                       F.col("first.text_hash").alias("at_hash")), "key")
    texts = (docs.select(F.col(id_col).cast("long").alias("at"), F.xxhash64(text).alias("at_hash"),
                         F.col(text).cast("binary").alias("text")).where("at IS NOT NULL")
             .groupBy("at", "at_hash").agg(F.first("text").alias("text")))
    checked = in_units(need.join(texts, ["at", "at_hash"]))
    links = written(_verify(checked, threshold, slack, least, length, n), "ngram-links")

    root = components(links.where("other IS NOT NULL"), "key", "other")
    about = (classes.select("key", "first", "copies")
             .join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
             .join(root.withColumnRenamed("node", "key"), "key", "left")
             .withColumn("root", F.coalesce("root", "key")))
    least_of = about.groupBy("root").agg(F.min("first").alias("head"))
    about = about.join(least_of, "root").select(
        "key", F.col("first.doc_id").alias("class_id"), "head",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("key"))      # a null id is in no class
    out = rows.select("doc_id", "text_hash", own.alias("key")).join(about, "key", "left")
    return out.select(
        "doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("head.doc_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce((F.col("doc_id") == F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash")),
                   F.lit(True)).alias("kept"))


@apart()
def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns unchanged.

    Rows with a null id stay as they are; of rows that repeat id and text one
    stays; rows without words are in no group with other ids.
    """
    found = near_duplicates(docs, id_col, text, **options)
    lost = found.where("NOT kept").select(F.col("doc_id").alias("_nd_id"),
                                          F.col("text_hash").alias("_nd_hash")).distinct()
    here = docs.withColumns({"_nd_key": F.col(id_col).cast("long"), "_nd_text": F.xxhash64(text)})
    named = here.where("_nd_key IS NOT NULL")
    left = named.join(lost, (F.col("_nd_key") == F.col("_nd_id")) & (F.col("_nd_text") == F.col("_nd_hash")),
                      "left_anti")
    return (left.dropDuplicates(["_nd_key", "_nd_text"]).select(*docs.columns)
            .unionByName(here.where("_nd_key IS NULL").select(*docs.columns)))
