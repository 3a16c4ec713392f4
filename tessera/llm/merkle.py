"""Merkle manifest of a dataset by sibling-shift self-joins.

Method
1. Every row becomes a leaf, the digest of its columns.  Leaves are laid out by
   range over (group, order column, leaf), so each knows its place in its group
   from the row counts of the partitions before it; no group is sorted in one task.
2. A level equijoins its nodes with themselves on the computed indices of the
   siblings (index XOR 1 for two, slot offsets for a larger fan-out).  Every node
   then knows its siblings, and the nodes of slot zero emit the parents.  A level
   is written to the shared folder before the next one reads it.
3. The last node of a group is its subroot; the subroots are the leaves of one
   more tree, whose last node is the root.
4. Paths go down again: a node's path is its siblings followed by its parent's
   path, so the rows that move halve from level to level.  A path folds the leaf
   (or a tampered one) back to the root.

A digest is the SHA-256 of its inputs one after the other, digests as lowercase hex
text; between the steps it is kept as 32 bytes.  A column enters a leaf as ``-`` if
null, else its length in UTF-8 bytes, a colon and its value.

Defined results: the null group is a group of its own, before all others; within a
group null ids come first; rows of equal id are ordered by their leaves, and equal
rows are leaves of their own; an empty text is ``0:``; texts of any length are
hashed whole; a group of one row has that leaf as its subroot, and a table of one
group its subroot as root; columns that are not named take no part, whatever their
names; an empty table gives an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.store import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that the paths go down before they are written.
LEVELS_AT_ONCE = 5
TAMPER_EVERY = 7


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row's columns, which no two different rows write alike."""
    def entry(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return _digest(*[entry(c) for c in values])


def indexed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (place in the group's order, from 0) and ``size`` (rows of the group)."""
    laid = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                   .withColumn("_at", F.monotonically_increasing_id()), "merkle-leaves")
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    # one row for each group of a partition: as many as partitions and groups together
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = parts.select(group, "_part", F.sum("_n").over(of_group).alias("size"),
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (laid.join(parts, [group, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift"))
            .drop("_at", "_part", "_shift"))


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes with the hex digests of the siblings before and after them."""
    slot = F.col("idx") % fanout
    found = nodes
    for j in range(1, fanout):
        at = F.expr("idx ^ 1") if fanout == 2 else F.col("idx") - slot + (slot + j) % fanout
        other = nodes.select(F.col("grp").alias("_g"), F.col("idx").alias("_i"), F.col("hash").alias(f"_s{j}"))
        found = (found.withColumn("_want", at)
                 .join(other, (F.col("grp") == F.col("_g")) & (F.col("_want") == F.col("_i")), "left")
                 .drop("_g", "_i", "_want"))
    none = F.unhex(F.lit(""))
    side = [F.coalesce(f"_s{j}", none) for j in range(1, fanout)]    # in slots slot+1, slot+2, ...
    if fanout == 2:
        left, right = F.when(slot == 1, side[0]).otherwise(none), F.when(slot == 0, side[0]).otherwise(none)
    else:
        ring, cut = F.array(*side), (fanout - 1 - slot).cast("int")
        join = lambda part: F.aggregate(part, none, lambda a, b: F.concat(a, b))
        left = join(F.slice(ring, cut + 1, slot.cast("int")))
        right = join(F.slice(ring, F.lit(1), cut))
    return (found.withColumn("left", left).withColumn("right", right)
            .drop(*[f"_s{j}" for j in range(1, fanout)]))


def tree(leaves: DataFrame, fanout: int = 2) -> list[DataFrame]:
    """Levels from the leaves up: ``grp, idx, size, hash, left, right`` and what the leaves carry.

    ``size`` is the number of the group's nodes on the level; a group ends at size 1."""
    levels, nodes = [], leaves
    widest = leaves.agg(F.max("size")).first()[0] or 0
    while True:
        level = written(_with_siblings(nodes.where("size > 1"), fanout).unionByName(
            nodes.where("size = 1").withColumns({"left": F.unhex(F.lit("")), "right": F.unhex(F.lit(""))})),
            "merkle-level") if widest > 1 else nodes.withColumns(
            {"left": F.unhex(F.lit("")), "right": F.unhex(F.lit(""))})
        levels.append(level)
        if widest <= 1:
            return levels
        first = level.where((F.col("idx") % fanout == 0) & (F.col("size") > 1))
        nodes = first.select("grp", F.floor(F.col("idx") / F.lit(fanout)).cast("long").alias("idx"),
                             F.ceil(F.col("size") / F.lit(fanout)).cast("long").alias("size"),
                             _digest(_hex(F.col("left")), _hex(F.col("hash")), _hex(F.col("right"))).alias("hash"))
        widest = -(-widest // fanout)


def tops(levels: list[DataFrame]) -> DataFrame:
    """``grp, hash``: the last node of every group."""
    ends = [level.where("size = 1").select("grp", "hash") for level in levels]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def paths(levels: list[DataFrame], start: DataFrame, fanout: int = 2) -> DataFrame:
    """The lowest level with ``path``, the siblings ``(left, right)`` up to the end of ``start``'s path.

    ``start`` has ``grp``, ``path`` (of the group's last node) and what every node below is to carry."""
    carried = [c for c in start.columns if c != "grp"]
    down = None
    for at in reversed(range(len(levels))):
        level = levels[at]
        own = level.where("size = 1").drop("left", "right").join(start, "grp")
        if down is not None:
            above = down.select(F.col("grp").alias("_g"), F.col("idx").alias("_i"), *carried)
            below = level.where("size > 1").join(
                above, (F.col("grp") == F.col("_g")) & (F.floor(F.col("idx") / F.lit(fanout)) == F.col("_i")))
            below = (below.withColumn("path", F.concat(F.array(F.struct("left", "right")), "path"))
                     .drop("left", "right", "_g", "_i"))
            own = below.unionByName(own)
        down = own
        if at and (len(levels) - at) % LEVELS_AT_ONCE == 0:
            down = written(down, "merkle-paths")
    return down


def folded(leaf: Column, path: Column) -> Column:
    """The end of a path (hex) that starts at ``leaf`` (hex)."""
    return F.aggregate(path, leaf, lambda node, side: F.sha2(
        F.concat(_hex(side["left"]), node, _hex(side["right"])), 256))


def manifest(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "lang", *,
             changed: dict[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """``key, leaf, subroot, root, path, changed_leaf`` of every row; digests as lowercase hex.

    ``path`` holds the siblings from the leaf to the root as ``(left, right)`` digests, and
    ``changed_leaf`` is the leaf with the columns of ``changed`` in place of the row's own."""
    if fanout < 2:
        raise ValueError("a node needs room for two children")
    own = {c: F.col(c) for c in columns}
    g = F.col(group).cast("string")
    leaves = written(rows.select(
        F.col(key).alias("key"), F.when(g.isNull(), "").otherwise(F.concat(F.lit("+"), g)).alias("grp"),
        leaf_digest(list(own.values())).alias("hash"),
        leaf_digest(list((own | (changed or {})).values())).alias("changed")), "merkle-rows")
    levels = tree(indexed(leaves, "grp", ["key", "hash"]), fanout)
    subroots = tops(levels).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "hash")
    upper = tree(indexed(subroots, "grp", ["of"]), fanout)
    root = tops(upper).select("grp", F.col("hash").alias("root"),
                              F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))
    start = written(paths(upper, root, fanout).select(F.col("of").alias("grp"), F.col("hash").alias("subroot"),
                                                      "root", "path"), "merkle-subroots")
    return paths(levels, start, fanout).select(
        F.col("key").alias(key), _hex(F.col("hash")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"), "path", _hex(F.col("changed")).alias("changed_leaf"))


def manifest_table(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` and the check that finds the tampered rows.

    Where 7 divides the CRC-32 of the decimal id, the row tampered with has one character more."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    n = F.col("n_chars")
    made = manifest(docs, changed={"n_chars": F.when(tampered, n + 1).otherwise(n)})
    proof = F.array_join(F.transform("path", lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), "")
    out = made.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"),
                      folded(F.col("changed_leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB: levels by a recursive query that groups pairs, paths by a second one that climbs.
SQL = """
WITH RECURSIVE
crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))),
given AS (
  SELECT doc_id, source, lang, n_chars, text,
         xor(list_reduce(list_prepend(4294967295, [ord(x) FOR x IN string_split(doc_id::VARCHAR, '')]),
               lambda c, b: xor(c >> 8, t[(xor(c, b::BIGINT) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc_table),
entries AS (
  SELECT doc_id, lang, unnest([n_chars, CASE WHEN tampered THEN n_chars + 1 ELSE n_chars END]) AS n,
         unnest([false, true]) AS changed, source, text FROM given),
written AS (
  SELECT doc_id, lang, changed, sha256(
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
      coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n::VARCHAR) || ':' || n, '-') ||
      coalesce(strlen(text) || ':' || text, '-')) AS h
  FROM entries),
leaves AS (
  SELECT coalesce('+' || lang, '') AS grp, doc_id, h,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS idx
  FROM written WHERE NOT changed),
nodes AS (
  SELECT grp, 0 AS level, idx, h FROM leaves
  UNION ALL
  SELECT grp, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, max(idx) OVER (PARTITION BY grp) AS last FROM nodes) WHERE last > 0
  GROUP BY grp, level + 1, idx // 2),
height AS (SELECT grp, max(level) AS top FROM nodes GROUP BY grp),
subroots AS (
  SELECT n.grp, n.h, row_number() OVER (ORDER BY encode(n.grp)) - 1 AS idx
  FROM nodes n JOIN height t ON n.grp = t.grp AND n.level = t.top),
upper AS (
  SELECT 0 AS level, idx, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, max(idx) OVER () AS last FROM upper) WHERE last > 0
  GROUP BY level + 1, idx // 2),
summit AS (SELECT level AS top, h AS root FROM upper WHERE level = (SELECT max(level) FROM upper)),
climb AS (
  SELECT l.grp, l.doc_id, 0 AS level, l.idx, l.idx AS place, '' AS proof, c.h AS folded
  FROM leaves l JOIN written c ON c.changed AND l.doc_id = c.doc_id
  UNION ALL
  SELECT c.grp, c.doc_id, c.level + 1, c.idx // 2, c.place, c.proof || coalesce(s.h, ''),
         sha256(CASE WHEN c.idx % 2 = 1 THEN s.h || c.folded ELSE c.folded || coalesce(s.h, '') END)
  FROM climb c JOIN height t ON c.grp = t.grp AND c.level < t.top
  LEFT JOIN nodes s ON s.grp = c.grp AND s.level = c.level AND s.idx = xor(c.idx, 1)),
higher AS (
  SELECT c.grp, c.doc_id, c.place, 0 AS level, s.idx, c.proof, c.folded
  FROM climb c JOIN height t ON c.grp = t.grp AND c.level = t.top JOIN subroots s ON s.grp = c.grp
  UNION ALL
  SELECT c.grp, c.doc_id, c.place, c.level + 1, c.idx // 2, c.proof || coalesce(s.h, ''),
         sha256(CASE WHEN c.idx % 2 = 1 THEN s.h || c.folded ELSE c.folded || coalesce(s.h, '') END)
  FROM higher c JOIN summit ON c.level < summit.top
  LEFT JOIN upper s ON s.level = c.level AND s.idx = xor(c.idx, 1))
SELECT l.doc_id, l.h AS leaf, r.h AS subroot, summit.root, sha256(c.proof) AS proof_sha256,
       c.folded AS folded_root, c.folded = summit.root AS verified
FROM higher c JOIN summit ON c.level = summit.top
JOIN leaves l ON l.grp = c.grp AND l.idx = c.place JOIN subroots r ON r.grp = c.grp
"""
