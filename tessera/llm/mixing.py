"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Method
1. Every document gets a size (its number of words) and a place: the first nine
   hex digits of an MD5 of id and text, and six more of the row's number, which
   only count among rows that repeat id and text.  That narrow table is written once.
2. Targets: the sources in code point order weigh 5, 2, 1, repeating, and share
   ``share`` times all sizes; a target stops at ``most`` times its source's size
   and the excess goes to the other sources by weight, until none is above.
   Sources sorted by size per weight fill up in that order, so running sums over
   one row per source give the same result as repeated resharing.
3. A source takes each document ``floor(target / size)`` times, and once more if
   its place is below a threshold.  The threshold comes from histograms: sizes
   are summed by source and three digits, the bucket in which the running sum
   passes the budget is the only one refined by the next three digits, and so on.
4. A filter on the thresholds gives the mix; nothing is sorted.

Size of what is joined: thresholds are one row per source; they are broadcast
only if count and bytes, which are measured, stay under ``BROADCAST_BYTES``,
otherwise a join on source and salt spreads a source of any size.

Defined results: null text has size 0; a null source is a source of its own and
sorts last; rows that repeat id and text are places of their own, so a source of
equal rows comes as near its target as others (which of the equal rows are taken
depends on their order in the input); an empty table gives an empty table; other columns are passed through by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.columns import apart
from tessera.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE_NUM, SHARE_DEN, MOST = 3, 2, 2
DIGITS, LEVELS, REPEAT_LEVELS = 3, 3, 2
BROADCAST_BYTES = 8 << 20
SALTS = 32


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(id_col: str, text: str) -> Column:
    joined = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"),
                      F.coalesce(F.col(text), F.lit("")))
    row = F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))
    return F.concat(F.substring(F.md5(joined.cast("binary")), 1, DIGITS * LEVELS),
                    F.substring(row, 1, DIGITS * REPEAT_LEVELS))


def with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` joined with a table of one row per source (columns ``_source, ...``)."""
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_source")), F.lit(0))).first()
    if n * 200 + size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), rows["_s"].eqNullSafe(table["_source"])).drop("_source")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.hash("_h"), F.lit(SALTS)))
    return rows.join(salted, rows["_s"].eqNullSafe(salted["_source"]) & (rows["_salt"] == salted["_salt"])
                     ).drop("_source", "_salt")


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ``_source, source_size, target``, from rows ``_s, size``."""
    total = sizes.groupBy(F.col("_s").alias("_source")).agg(F.sum("size").alias("source_size"))
    ranked = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          ((F.row_number().over(ranked) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    total = total.withColumn("w", weight)
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("_source").asc_nulls_last())
    every = Window.partitionBy()
    up_to = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = (total.withColumn("pos", F.row_number().over(fill))
            .withColumn("num", SHARE_NUM * F.sum("source_size").over(every)
                        - MOST * SHARE_DEN * (F.sum("source_size").over(up_to) - F.col("source_size")))
            .withColumn("den", SHARE_DEN * (F.sum("w").over(every) - F.sum("w").over(up_to) + F.col("w"))))
    full = MOST * F.col("source_size") * F.col("den") <= F.col("w") * F.col("num")
    first = F.min(F.when(~full, F.struct("pos", "num", "den"))).over(every)
    step = step.withColumn("first", first)
    capped = F.col("first").isNull() | (F.col("pos") < F.col("first.pos"))
    return step.select("_source", "source_size", F.when(
        capped, (MOST * F.col("source_size")).cast("double")).otherwise(
        (F.col("w") * F.col("first.num")) / F.col("first.den")).alias("target"))


def thresholds(rows: DataFrame) -> DataFrame:
    """One row per source: ``_source, source_size, target, repeats, cut, cut_in``, from ``_s, size, _h``."""
    goal = targets(rows)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("repeats", repeats.cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    state = goal.withColumns({"cut": F.lit(""), "base": F.lit(0).cast("long"), "own": F.lit(0).cast("long")})
    for level in range(LEVELS + REPEAT_LEVELS):
        state = written(state, "mix-thresholds")
        here = with_source(rows, state.select("_source", "cut", "base", "rest"))
        here = here.where(F.substring("_h", 1, DIGITS * level) == F.col("cut")) if level else here
        bucket = F.substring("_h", 1, DIGITS * (level + 1)).alias("bucket")
        sums = here.groupBy("_s", bucket).agg(F.sum("size").alias("sum"), F.first("base").alias("base"),
                                              F.first("rest").alias("rest"))
        order = Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("base") + F.sum("sum").over(order))
        edge = (sums.where(F.col("upto") >= F.col("rest")).groupBy("_s")
                .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("sum")).alias("base"), "sum")).alias("edge")))
        state = (state.drop("cut", "base", "own")
                 .join(edge, state["_source"].eqNullSafe(edge["_s"])).drop("_s")
                 .select("*", F.col("edge.bucket").alias("cut"), F.col("edge.base").alias("base"),
                         F.col("edge.sum").alias("own")).drop("edge"))
    return written(state.select("_source", "source_size", "target", "repeats", "cut",
                                (2 * (F.col("rest") - F.col("base")) > F.col("own")).alias("cut_in")),
                   "mix-thresholds")


def copies() -> Column:
    below = (F.col("_h") < F.col("cut")) | ((F.col("_h") == F.col("cut")) & F.col("cut_in"))
    return F.col("repeats") + below.cast("long")


def plan(docs: DataFrame, id_col: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """The narrow table of documents and the thresholds of their sources."""
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("_s"), size_of(text).alias("size"),
                               place_of(id_col, text).alias("_h")), "mix-sizes")
    return rows, thresholds(rows)


def mix_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every document."""
    rows, cut = plan(docs, id_col, text, source)
    return with_source(rows, cut).withColumn("copies", copies()).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@apart()
def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, columns unchanged."""
    _, cut = plan(docs, id_col, text, source)
    cut = cut.select("_source", *[F.col(c).alias(f"_mix_{c}") for c in ("repeats", "cut", "cut_in")])
    rows = docs.withColumns({"_s": F.col(source), "_h": place_of(id_col, text)})
    below = (F.col("_h") < F.col("_mix_cut")) | ((F.col("_h") == F.col("_mix_cut")) & F.col("_mix_cut_in"))
    times = (F.col("_mix_repeats") + below.cast("long")).cast("int")
    return (with_source(rows, cut).withColumn("_times", F.array_repeat(F.lit(0), times))
            .withColumn("_one", F.explode("_times")).select(*docs.columns))


#: The same in DuckDB SQL.
SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 9) AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS s FROM rows GROUP BY source),
weighed AS (
  SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                      WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM per),
step AS (
  SELECT source, s, w, row_number() OVER o AS pos,
         (3 * sum(s) OVER () - 4 * (sum(s) OVER u - s))::BIGINT AS num,
         (2 * (sum(w) OVER () - sum(w) OVER u + w))::BIGINT AS den
  FROM weighed
  WINDOW o AS (ORDER BY s / w, source NULLS LAST),
         u AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
edge AS (SELECT pos, num, den FROM step WHERE 2 * s * den > w * num ORDER BY pos LIMIT 1),
goal AS (
  SELECT source, s, CASE WHEN (SELECT pos FROM edge) IS NULL OR pos < (SELECT pos FROM edge)
                         THEN (2 * s)::DOUBLE
                         ELSE (w * (SELECT num FROM edge))::DOUBLE / (SELECT den FROM edge)::DOUBLE END AS target
  FROM step),
budget AS (
  SELECT source, s, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT AS n,
         target - (CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT) * s AS rest FROM goal),
h9 AS (SELECT source, h, sum(size)::BIGINT AS own FROM rows GROUP BY source, h),
run AS (
  SELECT h9.source, h, own, rest, sum(own) OVER (PARTITION BY h9.source ORDER BY h
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM h9 JOIN budget b ON h9.source IS NOT DISTINCT FROM b.source),
cut AS (
  SELECT source, min(h) AS cut, arg_min(2 * (rest - (upto - own)) > own, h) AS cut_in
  FROM run WHERE upto >= rest GROUP BY source)
SELECT doc_id, size, b.s AS source_size, target,
       size * (n + CASE WHEN h < cut OR (h = cut AND cut_in) THEN 1 ELSE 0 END) AS taken,
       n + CASE WHEN h < cut OR (h = cut AND cut_in) THEN 1 ELSE 0 END AS copies
FROM rows r JOIN budget b ON r.source IS NOT DISTINCT FROM b.source
JOIN cut c ON r.source IS NOT DISTINCT FROM c.source
"""
