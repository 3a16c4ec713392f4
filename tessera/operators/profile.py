"""Column and dataset profiling (operators E1–E20, C2–C4).

Work plan for ``profile_columns`` — two partially aggregating shuffles of
distinct values, and passes over the rows that only leave counts:

1. the string long table ``(column, value, n)`` — unpivot + ``groupBy`` with
   map-side combine, so a value holding a third of all rows is one row.  The
   D5 detection regexes run once per *distinct* value (weighted by ``n``),
   and converted columns are extracted from the distinct values too;
2. the numeric long table ``(column, value, n)`` (raw numeric columns plus the
   converted strings) for mean / min / max and distinct counts; exact quartiles
   from the rows by sketched brackets (``ranks.exact_quantiles``: a sketching, a
   counting and a refining pass), sample std and IQR outliers in one more pass;
   nothing is laid out by range or checkpointed but a few rows per column;
3. top-5 values per categorical column from table 1 (two-stage salted top-k).

Duplicate rows (dataset totals) are one more ``groupBy(all columns)``.

Only one row per column ever reaches the driver.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric_text as NT
from ..functions.text import word_count
from . import ranks

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
TEMPORAL_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Fixed values (analysis rules of the reference):
#   quartiles 0.25 / 0.50 / 0.75, IQR fence factor 1.5, bounds rounded to 4
#   top values per categorical column: 5
#   regression when distinct > min(20, 5 % of rows); imbalance when min/max share < 0.25
#   free text when the average word count is >= 4.0
#   one-hot when <= 15 distinct values, frequency encoding above
QUARTILES = (0.25, 0.5, 0.75)
IQR_FACTOR = 1.5
TOP_VALUES = 5
REGRESSION_MAX_CLASSES = 20
REGRESSION_CLASS_SHARE = 0.05
IMBALANCE_RATIO = 0.25
TEXT_MIN_AVG_WORDS = 4.0
ONE_HOT_MAX = 15

COLUMN_PROFILE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("col_type", T.StringType()),
    T.StructField("is_converted", T.BooleanType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("n_missing", T.LongType()),
    T.StructField("missing_pct", T.DoubleType()),
    T.StructField("n_unique", T.LongType()),
    T.StructField("unique_pct", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("p25", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("p75", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("top_values", T.ArrayType(T.StructType([
        T.StructField("value", T.StringType()), T.StructField("count", T.LongType())]))),
    T.StructField("outlier_count", T.LongType()),
    T.StructField("outlier_pct", T.DoubleType()),
    T.StructField("outlier_lower_bound", T.DoubleType()),
    T.StructField("outlier_upper_bound", T.DoubleType()),
])


# --------------------------------------------------------------------------- kinds
def column_kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, TEMPORAL_TYPES):
        return "temporal"
    raise TypeError(f"unsupported column type {dt.simpleString()} (nested / interval columns "
                    "are not profiled)")


def column_kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: column_kind(f.dataType) for f in df.schema.fields}


def numeric_value(df: DataFrame, c: str) -> Column:
    """A numeric column as double; NaN counts as missing, bool as 0/1."""
    dt = df.schema[c].dataType
    col = F.col(c).cast("double")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(F.col(c)), col)
    return col


def present(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return F.col(c).isNotNull()


# ---------------------------------------------------------------- D5 detection
def detect_numeric_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One job: ``(column, rows, nonnull, range_like, range_parsed, unit_parsed,
    lead_parsed, pattern)`` for every string column (pattern NULL = not numeric)."""
    kinds = column_kinds(df)
    cols = cols or [c for c, k in kinds.items() if k == "string"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, pattern string")
    aggs = [a for i, c in enumerate(cols) for a in NT.detection_aggs(F.col(c), f"c{i}")]
    wide = df.agg(*aggs)
    keys = ("rows", "nonnull", "range_like", "range_parsed", "unit_parsed", "lead_parsed")
    structs = [F.struct(F.lit(c).alias("column"),
                        *[F.col(f"c{i}__{k}").alias(k) for k in keys]) for i, c in enumerate(cols)]
    long = wide.select(F.inline(F.array(*structs)))
    return long.withColumn("pattern", NT.decide_pattern(*[F.col(k) for k in keys]))


# ------------------------------------------------------------ long tables (2), (3)
def numeric_value_counts(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """``(column, value double, n)`` — distinct values with multiplicity."""
    structs = [F.struct(F.lit(c).alias("column"), e.alias("value")) for c, e in exprs.items()]
    return (df.select(F.inline(F.array(*structs)))
            .where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def string_value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value string, n)`` over the raw values (nulls excluded)."""
    structs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
               for c in cols]
    return (df.select(F.inline(F.array(*structs)))
            .where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def top_values(value_counts: DataFrame, k: int = TOP_VALUES,
               max_distinct: int | None = None) -> DataFrame:
    """``(column, rank, value, count)`` — count desc, value asc."""
    got = ranks.top_k(value_counts, ["column"], [F.desc("n"), F.asc("value")], k,
                      max_group_rows=max_distinct)
    return got.select("column", "rank", "value", F.col("n").alias("count"))


# --------------------------------------------------------------------- profile
def _totals(vc: DataFrame) -> DataFrame:
    """``(column, nonnull, n_unique, mean, min, max)`` from a ``(column, value, n)`` table."""
    return vc.groupBy("column").agg(F.sum("n").alias("nonnull"), F.count(F.lit(1)).alias("n_unique"),
                                    (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"),
                                    F.min("value").alias("min"), F.max("value").alias("max"))


def _detect_from_counts(svc: DataFrame, rows: int) -> DataFrame:
    """D5 over a string value table: each regex runs once per distinct value.
    Also returns ``n_unique`` (distinct raw values) per column."""
    v = F.col("value")
    n = F.col("n")
    agg = svc.groupBy("column").agg(
        F.sum(n).alias("nonnull"), F.count(F.lit(1)).alias("n_unique"),
        F.sum(F.when(NT.is_range(v), n).otherwise(0)).alias("range_like"),
        F.sum(F.when(NT.range_midpoint(v).isNotNull(), n).otherwise(0)).alias("range_parsed"),
        F.sum(F.when(NT.unit_number(v).isNotNull(), n).otherwise(0)).alias("unit_parsed"),
        F.sum(F.when(NT.leading_number(v).isNotNull(), n).otherwise(0)).alias("lead_parsed"))
    keys = ("rows", "nonnull", "range_like", "range_parsed", "unit_parsed", "lead_parsed")
    agg = agg.withColumn("rows", F.lit(rows).cast("long"))
    return agg.withColumn("pattern", NT.decide_pattern(*[F.col(k) for k in keys]))


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """E1–E6 + C3 for every column: one row per column (``COLUMN_PROFILE_SCHEMA``).

    The input is shuffled into two tables of distinct values, the string one and
    the numeric one, for detection, statistics and top values.  Quartiles come from
    sketched brackets over the rows, refined until they are exact, or with
    ``exact=False`` from a sketch alone.
    """
    spark = df.sparkSession
    kinds = column_kinds(df)
    n_total = df.count()
    num_cols = [c for c, k in kinds.items() if k in ("numeric", "bool")]
    str_cols = [c for c, k in kinds.items() if k in ("string", "temporal")]
    text_cols = [c for c, k in kinds.items() if k == "string"]

    # (3) string value table first: detection runs on its distinct values.
    svc = None
    pattern: dict = {}
    nonnull: dict = {}
    nuniq_str: dict = {}
    if str_cols:
        svc = string_value_counts(df, str_cols).persist(StorageLevel.MEMORY_AND_DISK)
        # one job: distinct / non-null counts of every string column + D5 detection
        # (temporal columns are filtered out of the pattern afterwards)
        for r in _detect_from_counts(svc, n_total).collect():   # one row per column
            nuniq_str[r["column"]] = r["n_unique"]
            nonnull[r["column"]] = r["nonnull"]
            if r["column"] in text_cols:
                pattern[r["column"]] = r["pattern"]
    conv_cols = [c for c in text_cols if pattern.get(c)]

    # (2) numeric value table: raw numeric columns + converted strings (from distinct values).
    quart, outl, nuniq_num, stats = {}, {}, {}, {}
    parts = []
    if num_cols:
        parts.append(numeric_value_counts(df, {c: numeric_value(df, c) for c in num_cols}))
    if conv_cols:
        conv = F.lit(None).cast("double")
        for c in conv_cols:
            conv = F.when(F.col("column") == c, NT.extract_with(pattern[c], F.col("value"))).otherwise(conv)
        parts.append(svc.where(F.col("column").isin(conv_cols))
                     .select("column", conv.alias("value"), "n").where(F.col("value").isNotNull())
                     .groupBy("column", "value").agg(F.sum("n").alias("n")))
    if parts:
        vc = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        means = {}
        for r in _totals(vc).collect():                      # one row per column
            means[r["column"]] = r["mean"]
            stats[r["column"]] = [r["mean"], None, r["min"], r["max"], r["nonnull"]]
            nuniq_num[r["column"]] = r["n_unique"]
            if r["column"] in num_cols:
                nonnull[r["column"]] = r["nonnull"]
        values = {c: numeric_value(df, c) for c in num_cols}
        values |= {c: NT.extract_with(pattern[c], F.col(c)).cast("double") for c in conv_cols}
        longv = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value"))
                                             for c, v in values.items()]))).where("value is not null")
        if conv_cols:       # the extraction runs once for all passes
            longv = longv.persist(StorageLevel.MEMORY_AND_DISK)
        if exact:
            q = ranks.exact_quantiles(longv, ["column"], "value", list(QUARTILES))
        else:
            q = ranks.quantiles(longv.withColumn("n", F.lit(1)), ["column"], "value", "n",
                                list(QUARTILES), exact=False)
        qw = q.groupBy("column").agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n)
                                       for p, n in zip(QUARTILES, ("q1", "q2", "q3"))])
        iqr = F.col("q3") - F.col("q1")
        qw = qw.select("column", "q1", "q2", "q3",
                       F.when(iqr > 0, F.round(F.col("q1") - IQR_FACTOR * iqr, 4)).alias("lo"),
                       F.when(iqr > 0, F.round(F.col("q3") + IQR_FACTOR * iqr, 4)).alias("hi"))
        bounds = []
        for r in qw.collect():   # one row per column
            quart[r["column"]] = {0.25: r["q1"], 0.5: r["q2"], 0.75: r["q3"]}
            if r["lo"] is not None:
                bounds.append((r["column"], r["lo"], r["hi"]))
        # one job: squared deviations about the mean (two-pass sample std) + IQR outliers
        small = spark.createDataFrame(
            [(c, means[c], *next(((lo, hi) for cc, lo, hi in bounds if cc == c), (None, None)))
             for c in means], "column string, _m double, lo double, hi double")
        scored = longv.join(F.broadcast(small), "column")     # one row per column: bounded
        got = scored.groupBy("column").agg(
            F.sum((F.col("value") - F.col("_m")) ** 2).alias("_ss"),
            F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("outliers")).collect()
        outl_n = {}
        for r in got:
            st = stats[r["column"]]
            st[1] = (r["_ss"] / (st[4] - 1)) ** 0.5 if st[4] > 1 else None
            outl_n[r["column"]] = r["outliers"] or 0
        stats = {c: tuple(v[:4]) for c, v in stats.items()}
        outl = {c: (outl_n.get(c, 0), lo, hi) for c, lo, hi in bounds}
        longv.unpersist()

    # top values of categorical columns
    tops: dict = {}
    cat = [c for c in str_cols if not pattern.get(c)]
    if cat:
        tv = top_values(svc.where(F.col("column").isin(cat)),
                        max_distinct=max([nuniq_str.get(c, 0) for c in cat] + [0]))
        for r in tv.collect():   # <= 5 rows per column
            tops.setdefault(r["column"], []).append((r["rank"], r["value"], r["count"]))

    rows = []
    for pos, (c, k) in enumerate(kinds.items()):
        n_missing = n_total - nonnull.get(c, 0)
        is_num = k in ("numeric", "bool") or bool(pattern.get(c))
        n_unique = nuniq_num.get(c, 0) if k in ("numeric", "bool") else nuniq_str.get(c, 0)
        dtype = df.schema[c].dataType.simpleString()
        if is_num:
            mean, std, mn, mx = stats.get(c, (None,) * 4)
            qq = quart.get(c, {})
            oc, lo, hi = outl.get(c, (0, None, None))
            rows.append((c, pos, dtype, "numeric", bool(pattern.get(c)), pattern.get(c),
                         n_missing, n_unique, mean, std, mn, qq.get(0.25), qq.get(0.5),
                         qq.get(0.75), mx, [], int(oc or 0), lo, hi))
        else:
            tv = [(v, int(n)) for _, v, n in sorted(tops.get(c, []))]
            rows.append((c, pos, dtype, "categorical", False, None, n_missing, n_unique,
                         None, None, None, None, None, None, None, tv, 0, None, None))
    if svc is not None:
        svc.unpersist()
    raw = spark.createDataFrame(rows, _RAW_SCHEMA)
    pct = lambda col: F.round(F.col(col) / F.lit(n_total) * 100, 2) if n_total else F.lit(0.0)
    return raw.select(
        "column", "position", "dtype", "col_type", "is_converted", "pattern",
        "n_missing", pct("n_missing").alias("missing_pct"),
        "n_unique", pct("n_unique").alias("unique_pct"),
        *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "median", "p75", "max")],
        "top_values", "outlier_count",
        F.when(F.col("outlier_lower_bound").isNotNull(), pct("outlier_count"))
        .otherwise(F.lit(0.0)).alias("outlier_pct"),
        "outlier_lower_bound", "outlier_upper_bound")


_RAW_SCHEMA = T.StructType([f for f in COLUMN_PROFILE_SCHEMA.fields
                            if f.name not in ("missing_pct", "unique_pct", "outlier_pct")])


# ---------------------------------------------------------------- single operators
def missing_counts(df: DataFrame) -> DataFrame:
    """``(column, n_missing, missing_pct)``."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count(F.when(present(df, c), F.lit(1))).alias(f"c{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column"), (F.col("__rows") - F.col(f"c{i}")).alias("n_missing"),
                        F.col("__rows").alias("rows")) for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*structs))).select(
        "column", "n_missing",
        F.when(F.col("rows") > 0, F.round(F.col("n_missing") / F.col("rows") * 100, 2))
        .otherwise(F.lit(0.0)).alias("missing_pct"))


def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """``(column, n_unique, unique_pct)``; nulls excluded, raw values."""
    kinds = column_kinds(df)
    rows = df.agg(F.count(F.lit(1)).alias("rows"))   # one-row scalar subquery
    if not exact:
        aggs = [F.approx_count_distinct(F.col(c)).alias(f"c{i}") for i, c in enumerate(kinds)]
        wide = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
        long = wide.select("rows", F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"c{i}").cast("long").alias("n_unique"))
            for i, c in enumerate(kinds)])))
    else:
        num = {c: numeric_value(df, c) for c, k in kinds.items() if k in ("numeric", "bool")}
        strs = [c for c, k in kinds.items() if k in ("string", "temporal")]
        parts = []
        if num:
            parts.append(numeric_value_counts(df, num).groupBy("column").count())
        if strs:
            parts.append(string_value_counts(df, strs).groupBy("column").count())
        got = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        names = df.sparkSession.createDataFrame([(c,) for c in kinds], "column string")
        long = names.join(got, "column", "left").select(
            "column", rows.scalar().alias("rows"), F.coalesce("count", F.lit(0)).alias("n_unique"))
    return long.select("column", "n_unique",
                       F.when(F.col("rows") > 0, F.round(F.col("n_unique") / F.col("rows") * 100, 2))
                       .otherwise(F.lit(0.0)).alias("unique_pct"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_distinct, n_duplicates, duplicate_pct)``.

    ``groupBy(all columns)`` combines map-side, so even a row repeated across a
    third of the table travels as one partial count per partition.
    """
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    one = g.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"),
                F.count(F.lit(1)).cast("long").alias("n_distinct"))
    return one.select("n_rows", "n_distinct",
                      (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"),
                      F.when(F.col("n_rows") > 0,
                             F.round((F.col("n_rows") - F.col("n_distinct")) / F.col("n_rows") * 100, 2))
                      .otherwise(F.lit(0.0)).alias("duplicate_pct"))


def dataset_totals(df: DataFrame) -> DataFrame:
    """One row — rows, columns, duplicates, missing cells and their shares."""
    cols = df.columns
    miss = df.agg(*[F.count(F.when(~present(df, c), F.lit(1))).alias(f"m{i}")
                    for i, c in enumerate(cols)])
    total = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0))
    miss = miss.select(total.cast("long").alias("total_missing"))
    dup = duplicate_rows(df).withColumn("total_missing", miss.scalar())
    n_cols = len(cols)
    return dup.select(
        "n_rows", F.lit(n_cols).cast("long").alias("n_cols"), "n_duplicates", "duplicate_pct",
        "total_missing",
        F.when(F.col("n_rows") * n_cols > 0,
               F.round(F.col("total_missing") / (F.col("n_rows") * n_cols) * 100, 2))
        .otherwise(F.lit(0.0)).alias("total_missing_pct"))


def null_summary(column_profile: DataFrame) -> DataFrame:
    """Columns with at least one missing value."""
    return column_profile.where(F.col("n_missing") > 0).select(
        "column", F.col("n_missing").alias("count"), F.col("missing_pct").alias("pct"))


def outlier_summary(column_profile: DataFrame, target: str | None = None) -> DataFrame:
    """Feature columns with at least one IQR outlier."""
    p = column_profile.where(F.col("outlier_count") > 0)
    if target:
        p = p.where(F.col("column") != target)
    return p.select("column", F.col("outlier_count").alias("count"), F.col("outlier_pct").alias("pct"),
                    F.col("outlier_lower_bound").alias("lower_bound"),
                    F.col("outlier_upper_bound").alias("upper_bound"))


def worst_outliers(column_profile: DataFrame, target: str | None = None, n: int = 5) -> DataFrame:
    """C4: the ``n`` feature columns with the largest outlier share."""
    return outlier_summary(column_profile, target).orderBy(F.desc("pct"), F.asc("column")).limit(n)


def task_type(df: DataFrame, target: str) -> DataFrame:
    """One row ``(target, n_rows, n_unique, task_type)``."""
    dt = df.schema[target].dataType
    numeric = isinstance(dt, NUMERIC_TYPES) and not isinstance(dt, T.BooleanType)
    v = numeric_value(df, target) if numeric else F.col(target)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"))
    nu = df.select(v.alias("v")).where(F.col("v").isNotNull()).groupBy("v").count().agg(
        F.count(F.lit(1)).alias("n_unique"))
    limit = F.least(F.lit(float(REGRESSION_MAX_CLASSES)), F.col("n_rows") * REGRESSION_CLASS_SHARE)
    kind = (F.when(F.lit(numeric) & (F.col("n_unique") > limit), F.lit("regression"))
            .otherwise(F.lit("classification")))
    one = one.withColumn("n_unique", nu.scalar())
    return one.select(F.lit(target).alias("target"), "n_rows", "n_unique", kind.alias("task_type"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """``(class, count, share)`` — share of non-null target values, round 4."""
    g = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")) \
          .agg(F.count(F.lit(1)).alias("count"))
    tot = g.agg(F.sum("count").alias("_tot")).scalar()
    return g.select("class", "count", F.round(F.col("count") / tot, 4).alias("share"))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row ``(n_classes, min_share, max_share, ratio, is_imbalanced)``."""
    b = class_balance(df, target)
    one = b.agg(F.count(F.lit(1)).alias("n_classes"), F.min("count").alias("_mn"),
                F.max("count").alias("_mx"), F.sum("count").alias("_t"))
    ratio = F.col("_mn") / F.col("_mx")
    return one.select("n_classes",
                      F.round(F.col("_mn") / F.col("_t"), 4).alias("min_share"),
                      F.round(F.col("_mx") / F.col("_t"), 4).alias("max_share"),
                      F.round(ratio, 4).alias("ratio"),
                      ((F.col("n_classes") > 1) & (ratio < IMBALANCE_RATIO)).alias("is_imbalanced"))


def missing_ratio(df: DataFrame) -> DataFrame:
    """Mean over columns of each column's null share, round 4."""
    cols = df.columns
    shares = [F.count(F.when(~present(df, c), F.lit(1))) / F.count(F.lit(1)) for c in cols]
    return df.agg((sum(shares, F.lit(0.0)) / len(cols)).alias("_m")).select(
        F.round("_m", 4).alias("missing_ratio"))


def avg_word_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, avg_words, is_text)`` for string columns (empty column → not text)."""
    kinds = column_kinds(df)
    cols = cols or [c for c, k in kinds.items() if k == "string"]
    wide = df.agg(*[F.avg(word_count(F.col(c))).alias(f"c{i}") for i, c in enumerate(cols)])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"),
                                                    F.col(f"c{i}").alias("avg_words"))
                                          for i, c in enumerate(cols)])))
    return long.select("column", F.round("avg_words", 4).alias("avg_words"),
                       F.coalesce(F.col("avg_words") >= TEXT_MIN_AVG_WORDS, F.lit(False)).alias("is_text"))
