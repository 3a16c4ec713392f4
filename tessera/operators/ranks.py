"""Exact order statistics and top-k without funnelling a group into one task.

Spark's exact ``percentile`` keeps every distinct value of a column in the one
task that finishes a global aggregate, and ``row_number()`` over a window
partitioned by a column (or class) sorts that whole group in one task.  Both
break when a column has billions of distinct values or one class holds a third
of all rows.  The helpers here keep every task bounded:

* :func:`select_ranks` finds the value at given 0-based positions of each
  group's ascending order.  The (pre-aggregated) input is range-partitioned on
  ``(group, value)``, checkpointed so the layout is fixed, and each partition
  computes local running counts; a tiny table of per-partition totals gives
  each partition its global offset.
* :func:`exact_quantiles` needs no layout: a mergeable KLL sketch of each group
  brackets the wanted ranks, one counting pass proves or mends the brackets, and
  only the rows strictly inside them are shuffled.
* :func:`quantiles` gives linear-interpolated quantiles (the pandas /
  ``quantile_cont`` definition) of weighted rows, or approximate ones.
* :func:`top_k` keeps the first ``k`` rows per group in two window passes over
  salted sub-groups, so no window task sorts more than ``rows_per_task`` rows.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Rows one window task may sort (a partition that comfortably fits in memory).
DEFAULT_ROWS_PER_TASK = 2_000_000


def _n_parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def range_layout(weighted: DataFrame, group_cols: list[str], value_col: str,
                 num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``(group, value)`` and checkpoint, fixing the layout.

    The result can be reused (distinct counts, outlier counts) and passed to
    :func:`select_ranks` with ``laid_out=True``.
    """
    ensure_checkpoint_dir(weighted.sparkSession)
    n = num_partitions or _n_parts(weighted)
    # persisted first: the range sampler and the checkpoint would otherwise each
    # recompute the (aggregating) input
    src = weighted.persist(StorageLevel.MEMORY_AND_DISK)
    out = (src.repartitionByRange(n, *[F.col(g) for g in group_cols], F.col(value_col))
           .checkpoint(eager=True))
    src.unpersist()
    return out


def running_totals(weighted: DataFrame, group_cols: list[str], order_col: str,
                   sum_cols: list[str], num_partitions: int | None = None,
                   laid_out: bool = False) -> DataFrame:
    """Exclusive running sums of ``sum_cols`` along ``order_col`` within each group.

    Adds ``{c}_before`` (sum over rows strictly earlier in the order) for every
    ``c``.  ``order_col`` must be distinct within a group (aggregate first).
    Each task only sorts its own range partition; a table with one row per
    (group, partition) supplies the offsets.
    """
    base = weighted if laid_out else range_layout(weighted, group_cols, order_col, num_partitions)
    ranged = base.withColumn("_pid", F.spark_partition_id())
    part = ranged.groupBy(*group_cols, "_pid").agg(*[F.sum(c).alias(f"_p_{c}") for c in sum_cols])
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = part.select(*group_cols, "_pid", *[
        F.coalesce(F.sum(f"_p_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    local = Window.partitionBy("_pid", *group_cols).orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, -1)
    out = ranged
    for c in sum_cols:
        out = out.withColumn(f"_l_{c}", F.coalesce(F.sum(c).over(local), F.lit(0)))
    # offsets: at most partitions + groups rows, a bounded broadcast
    out = out.join(F.broadcast(offsets), on=[*group_cols, "_pid"])
    return out.select(*[x for x in weighted.columns], *[
        (F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"{c}_before") for c in sum_cols])


def select_ranks(weighted: DataFrame, group_cols: list[str], value_col: str,
                 count_col: str, targets: DataFrame, pos_col: str = "pos",
                 num_partitions: int | None = None, laid_out: bool = False) -> DataFrame:
    """Value at each requested 0-based position of every group's sorted order.

    ``weighted`` holds distinct ``(group..., value)`` rows with a multiplicity
    ``count_col`` (so a hot value is one row, not a skewed key).  ``targets``
    holds ``(group..., pos)``; its size is bounded by groups × positions.
    Only the range partitions that contain a requested position are sorted:
    a table with one row per (group, partition) locates them, a semi-join keeps
    their rows, and a window ranks inside each of them.
    Returns ``targets`` columns plus ``value_col``.
    """
    base = weighted if laid_out else range_layout(
        weighted.select(*group_cols, value_col, count_col), group_cols, value_col, num_partitions)
    ranged = base.select(*group_cols, value_col, count_col).withColumn("_pid", F.spark_partition_id())
    part = ranged.groupBy(*group_cols, "_pid").agg(F.sum(count_col).alias("_pn"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = part.select(*group_cols, "_pid", "_pn",
                          F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_off"))
    t = targets.alias("t")
    o = offsets.alias("o")
    eq = [F.col(f"t.{g}").eqNullSafe(F.col(f"o.{g}")) for g in group_cols]
    # which partition holds each target: both sides are small (bounded metadata)
    located = (t.join(F.broadcast(o), on=eq + [F.col(f"t.{pos_col}") >= F.col("o._off"),
                                                F.col(f"t.{pos_col}") < F.col("o._off") + F.col("o._pn")])
               .select(*[F.col(f"t.{c}") for c in targets.columns], F.col("o._pid").alias("_pid"),
                       (F.col(f"t.{pos_col}") - F.col("o._off")).alias("_lpos")))
    need = located.select(*group_cols, "_pid").distinct()
    rows = ranged.join(F.broadcast(need), on=[*group_cols, "_pid"], how="left_semi")
    local = Window.partitionBy("_pid", *group_cols).orderBy(value_col).rowsBetween(
        Window.unboundedPreceding, 0)
    spans = rows.select(*group_cols, "_pid", value_col,
                        (F.sum(count_col).over(local) - F.col(count_col)).alias("_s"),
                        F.sum(count_col).over(local).alias("_e")).alias("s")
    lt = located.alias("l")
    cond = [F.col(f"l.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group_cols]
    cond += [F.col("l._pid") == F.col("s._pid"), F.col("l._lpos") >= F.col("s._s"),
             F.col("l._lpos") < F.col("s._e")]
    return (spans.join(F.broadcast(lt), on=cond, how="inner")
            .select(*[F.col(f"l.{c}") for c in targets.columns], F.col(f"s.{value_col}")))


# The sketch keeps about this many values a level; its rank error is near 0.13 % of a group.
SKETCH_K = 4096
# Quantiles taken from a sketch; a bracket goes from one to two steps beyond the wanted rank.
GRID = 400
# A bracket with more rows inside than this is sketched again instead of being ranked.
INTERIOR_ROWS = 1_000_000


def _sketch(rows: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """``GRID + 1`` quantiles of one mergeable sketch and the exact number of rows per group,
    materialised: a KLL sketch is drawn at random, so it must not be made anew by a later job."""
    made = rows.groupBy(*group_cols).agg(F.kll_sketch_agg_double(value_col, F.lit(SKETCH_K)).alias("_sk"))
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return made.select(*group_cols, F.kll_sketch_get_quantile_double("_sk", grid).alias("_grid"),
                       F.kll_sketch_get_n_double("_sk").alias("_n")).checkpoint()


def _null_safe(a: str, b: str, cols: list[str]) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]


def _bracketed(wanted: DataFrame, sketches: DataFrame, keys: list[str], pos_col: str) -> DataFrame:
    """``wanted`` with ``_blo`` and ``_bhi``, values of the sketch around each wanted rank."""
    step = (F.col(f"w.{pos_col}") - F.col("w._skip") + 0.5) / F.col("s._n") * GRID
    at = [F.greatest(F.floor(step) - 1, F.lit(0)), F.least(F.ceil(step) + 1, F.lit(GRID))]
    lo, hi = (F.get("s._grid", i.cast("int")) for i in at)
    return (wanted.alias("w").join(sketches.alias("s"), _null_safe("w", "s", keys))
            .select("w.*", lo.alias("_blo"), hi.alias("_bhi")))


def _counted(rows: DataFrame, brackets: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """Counts of rows below, at and between the ends of every bracket, in one pass over the rows.

    The brackets of a group travel as one array (a few wanted ranks each)."""
    from .split import bounded
    cols = [c for c in brackets.columns if c not in group_cols]
    of_group = brackets.groupBy(*group_cols).agg(F.collect_list(F.struct(*cols)).alias("_b")).checkpoint()
    groups, most = of_group.agg(F.count(F.lit(1)), F.max(F.size("_b"))).first()
    v = F.col(f"r.{value_col}")
    sums = []
    for i in range(most or 0):
        lo, hi = (F.get("g._b", F.lit(i))[c] for c in ("_blo", "_bhi"))
        sums += [F.count_if(v < lo).alias(f"_{i}below"), F.count_if(v == lo).alias(f"_{i}lo"),
                 F.count_if((v > lo) & (v < hi)).alias(f"_{i}in"),
                 F.count_if((v == hi) & (hi > lo)).alias(f"_{i}hi")]
    if not sums:
        return brackets.withColumns({c: F.lit(0) for c in ("_below", "_at_lo", "_in", "_at_hi")})
    # the array is joined again afterwards: aggregated, it would have every row sorted
    sums = (rows.alias("r").join(bounded(of_group, groups).alias("g"), _null_safe("r", "g", group_cols))
            .groupBy(*[F.col(f"g.{c}").alias(c) for c in group_cols]).agg(*sums))
    found = (sums.alias("s").join(bounded(of_group, groups).alias("g"), _null_safe("s", "g", group_cols))
             .select("s.*", "g._b"))
    each = [F.struct(*[F.get("_b", F.lit(i))[c].alias(c) for c in cols],
                     *[F.col(f"_{i}{k}").alias(n) for k, n in (("below", "_below"), ("lo", "_at_lo"),
                                                               ("in", "_in"), ("hi", "_at_hi"))])
            for i in range(most)]
    return found.select(*group_cols, F.inline(F.array(*each))).where(F.col("_blo").isNotNull())


def _inside(rows: DataFrame, wanted: DataFrame, n: int, group_cols: list[str], value_col: str,
            pos_col: str) -> DataFrame:
    """``(group..., pos, skip, value)`` of the rows strictly between ``_lo`` and ``_hi``."""
    from .split import bounded
    v = F.col(f"r.{value_col}")
    cond = _null_safe("r", "w", group_cols) + [F.col("w._lo").isNull() | (v > F.col("w._lo")),
                                               F.col("w._hi").isNull() | (v < F.col("w._hi"))]
    return (rows.alias("r").join(bounded(wanted, n).alias("w"), cond)
            .select(*[F.col(f"w.{c}").alias(c) for c in group_cols], f"w.{pos_col}", "w._skip", v.alias(value_col)))


def bracketed_ranks(rows: DataFrame, group_cols: list[str], value_col: str, targets: DataFrame,
                    pos_col: str = "pos", sketches: DataFrame | None = None) -> DataFrame:
    """Value at each 0-based position of every group's ascending order, from raw rows.

    ``rows`` has a double ``value_col`` without nulls or NaN; ``targets`` holds distinct
    ``(group..., pos)`` within the groups' sizes.  A round sketches what is still open, takes
    the sketch's values around every wanted rank as its bracket and counts the rows below, at
    and inside the bracket.  The counts decide: the rank falls on an end of the bracket
    (done), inside (the rows between are ranked, or sketched again if they are many) or, should
    the sketch have been wrong, outside (the part beyond is the next bracket).  Values that hold
    many rows are ends of brackets, so they are counted and never ranked; the rows between
    are about three of ``GRID`` parts of a group for each rank, whatever the distribution."""
    ensure_checkpoint_dir(rows.sparkSession)
    keys = [*group_cols, pos_col]
    none = F.lit(None).cast("double")
    todo = targets.select(*keys, none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_skip"))
    sketches = sketches if sketches is not None else _sketch(rows, group_cols, value_col)
    by, done = group_cols, []
    while True:
        counts = _counted(rows, _bracketed(todo, sketches, by, pos_col), group_cols, value_col)
        pos, below = F.col(pos_col), F.col("_below")
        a, b, c = (below + F.col("_at_lo"), below + F.col("_at_lo") + F.col("_in"),
                   below + F.col("_at_lo") + F.col("_in") + F.col("_at_hi"))
        at = F.when(pos < below, "before").when(pos < a, "lo").when(pos < b, "in").when(pos < c, "hi").otherwise("after")
        state = counts.withColumn("_at", at).select(
            *keys, F.when(at == "lo", F.col("_blo")).when(at == "hi", F.col("_bhi")).alias(value_col),
            F.when(at == "in", F.col("_blo")).when(at == "after", F.col("_bhi")).otherwise(F.col("_lo")).alias("_lo"),
            F.when(at == "in", F.col("_bhi")).when(at == "before", F.col("_blo")).otherwise(F.col("_hi")).alias("_hi"),
            F.when(at == "in", a).when(at == "after", c).otherwise(F.col("_skip")).alias("_skip"),
            F.when(at == "in", F.col("_in")).alias("_rows")).checkpoint()
        done.append(state.where(F.col(value_col).isNotNull()).select(*keys, value_col))
        todo = state.where(F.col(value_col).isNull())
        n, known, most = todo.agg(F.count(F.lit(1)), F.count("_rows"), F.max("_rows")).first()
        if not n:
            break
        inside = _inside(rows, todo, n, group_cols, value_col, pos_col)
        if known == n and most <= INTERIOR_ROWS:
            w = Window.partitionBy(*keys).orderBy(value_col)       # at most INTERIOR_ROWS rows
            span = (inside.groupBy(*keys, "_skip", value_col).agg(F.count(F.lit(1)).alias("_n"))
                    .withColumn("_end", F.sum("_n").over(w) + F.col("_skip")))
            done.append(span.where((F.col(pos_col) < F.col("_end")) & (F.col(pos_col) >= F.col("_end") - F.col("_n")))
                        .select(*keys, value_col))
            break
        by, sketches = keys, _sketch(inside, keys, value_col)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn(value_col, F.col(value_col) + 0.0)       # no negative zero


def exact_quantiles(rows: DataFrame, group_cols: list[str], value_col: str, probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles ``(group..., q, value)`` of raw rows by :func:`bracketed_ranks`.

    The rows are read once to sketch, once to count and once for what lies inside the brackets."""
    ensure_checkpoint_dir(rows.sparkSession)
    sketches = _sketch(rows, group_cols, value_col)
    pos = _positions(sketches.select(*group_cols, "_n"), probs)
    wanted = pos.select(*group_cols, F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("pos")).distinct()
    got = bracketed_ranks(rows, group_cols, value_col, wanted, sketches=sketches).checkpoint()
    return _interpolated(pos, got, group_cols, value_col)


def _positions(sizes: DataFrame, probs: list[float]) -> DataFrame:
    """Positions around each quantile of groups with ``_n`` rows: groups x |probs| rows."""
    return (sizes.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
            .withColumn("_h", F.col("q") * (F.col("_n") - 1))
            .withColumn("_lo", F.floor("_h").cast("long"))
            .withColumn("_hi", F.ceil("_h").cast("long"))
            .withColumn("_frac", F.col("_h") - F.col("_lo")))


def _interpolated(pos: DataFrame, got: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    lo = got.withColumnRenamed("pos", "_lo").withColumnRenamed(value_col, "_vlo")
    hi = got.withColumnRenamed("pos", "_hi").withColumnRenamed(value_col, "_vhi")
    return (pos.join(lo, on=[*group_cols, "_lo"]).join(hi, on=[*group_cols, "_hi"])
            .select(*group_cols, "q",
                    (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias(value_col)))


def quantiles(weighted: DataFrame, group_cols: list[str], value_col: str,
              count_col: str, probs: list[float], exact: bool = True,
              accuracy: int = 100_000, laid_out: bool = False) -> DataFrame:
    """Linear-interpolated quantiles per group: ``(group..., q, value)``.

    ``exact=False`` uses ``percentile_approx`` (a bounded sketch per group);
    it has no weights, so it expects raw rows (every ``count_col`` equal to 1).
    """
    qs = F.array(*[F.lit(float(p)) for p in probs])
    if not exact:
        agg = weighted.groupBy(*group_cols).agg(
            F.percentile_approx(F.col(value_col), qs, accuracy).alias("_qs"))
        return agg.select(*group_cols, F.posexplode("_qs").alias("_i", value_col)).select(
            *group_cols, F.element_at(qs, F.col("_i") + 1).alias("q"), value_col)
    pos = _positions(weighted.groupBy(*group_cols).agg(F.sum(count_col).alias("_n")), probs)
    wanted = pos.select(*group_cols, F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("pos"))
    got = select_ranks(weighted, group_cols, value_col, count_col, wanted, laid_out=laid_out)
    return _interpolated(pos, got, group_cols, value_col)


def _hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` for a hash: one that holds a map (maps cannot be hashed) as JSON."""
    return [F.to_json(F.struct(_quoted(f.name))) if '"type":"map"' in f.dataType.json() else _quoted(f.name)
            for f in df.schema.fields]


def _quoted(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def top_k(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
          max_group_rows: int | None = None, rows_per_task: int = DEFAULT_ROWS_PER_TASK,
          rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows of each group under ``order`` (deterministic order required).

    When a group may exceed ``rows_per_task`` rows, rows are first ranked inside
    ``salt`` sub-groups (hash of the whole row), keeping ``k`` per sub-group, and
    the survivors (at most ``k × salt`` per group) are ranked again.
    """
    if max_group_rows is None:
        max_group_rows = 0
    salt = max(1, math.ceil(max_group_rows / rows_per_task))
    cur = df
    if salt > 1:
        cur = cur.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(df)), F.lit(salt)))
        w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
        cur = cur.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k) \
                 .drop("_r1", "_salt")
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return cur.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
