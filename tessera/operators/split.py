"""Label encoding (F1) and the train / validation split (F2).

The exact stratified split keeps, per class, the ``q_c`` rows with the smallest
``md5(key|seed)`` for validation.  ``q_c`` follows scikit-learn's allocation
(train share first by floor + largest remainder, then validation from what is
left; ties by class order instead of a random draw).  The per-class threshold
is found from counts by leading digits of the hash (:func:`hash_cuts`): only the
rows that share the digits of a class's boundary are counted again, so nothing is
laid out by range and no class is sorted in one task.  ``exact=False`` is a no-shuffle hash
threshold (``md5`` prefix as a uniform number) with approximate counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from . import ranks
from .profile import NUMERIC_TYPES

# 80/20 split, seed 42, stratify only if every class has >= 2 rows.
TEST_SIZE = 0.2
SEED = 42
# A class table (one row per target class) is broadcast and indexed in one window
# task only up to this many classes; above it, shuffle joins and the distributed
# running count (range partitions + offsets) take over.
CLASS_TABLE_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20


def bounded(table: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast hint only for a table whose counted rows and measured bytes are under the bounds
    (the bytes of text columns take a pass over the table, which has one row per class)."""
    texts = [f.name for f in table.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if n_rows > CLASS_TABLE_MAX_ROWS:
        return table
    size = 16 * len(table.columns) * n_rows
    if texts:
        size += table.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_MAX_BYTES else table


def encode_labels(df: DataFrame, target: str, task: str = "classification",
                  label_col: str = "label") -> tuple[DataFrame, DataFrame | None]:
    """classes sorted (numerically when numeric) → 0..k-1; regression → double.

    Returns ``(df with label_col, classes DataFrame(class, index) or None)``.
    The class table has one row per class; its counted size decides between a
    broadcast + one-task rank and a shuffle join + distributed running count.
    """
    if task != "classification":
        return df.withColumn(label_col, F.col(target).cast("double")), None
    classes = df.select(F.col(target).alias("class")).where(F.col("class").isNotNull()).distinct()
    k = classes.count()
    if k <= CLASS_TABLE_MAX_ROWS:
        classes = classes.select("class", (F.dense_rank().over(Window.orderBy("class")) - 1)
                                 .cast("double").alias("index"))
    else:
        ranked = ranks.running_totals(classes.withColumn("_one", F.lit(1).cast("long")), [],
                                      "class", ["_one"])
        classes = ranked.select("class", F.col("_one_before").cast("double").alias("index"))
    out = df.join(bounded(classes.withColumnRenamed("class", target)
                          .withColumnRenamed("index", label_col), k), on=target, how="left")
    return out, classes


def unseen_labels(df: DataFrame, target: str, classes: DataFrame) -> int:
    """Number of rows whose class is not in the fitted class table (anti-join)."""
    known = classes.select(F.col("class").alias(target))
    return df.where(F.col(target).isNotNull()).join(bounded(known, classes.count()), target,
                                                    "left_anti").count()


def apply_labels(df: DataFrame, target: str, classes: DataFrame, label_col: str = "label") -> DataFrame:
    """Encode with a fitted class table; unseen classes raise, as a label encoder does."""
    bad = unseen_labels(df, target, classes)
    if bad:
        raise ValueError(f"{bad} rows have labels unseen when the classes were fitted")
    return df.join(bounded(classes.withColumnRenamed("class", target)
                           .withColumnRenamed("index", label_col), classes.count()), target, "left")


def row_hash(key_cols: list[str], seed: int = SEED) -> Column:
    """``md5(key|seed)`` as hex; sorting it sorts the 128-bit uniform draw."""
    if len(key_cols) == 1:
        key = F.coalesce(F.col(key_cols[0]).cast("string"), F.lit(""))
    else:   # unambiguous encoding of a whole row
        key = F.to_json(F.struct(*[F.col(c) for c in key_cols]))
    return F.md5(F.concat(key, F.lit(f"|{seed}")))


def uniform(h: Column) -> Column:
    """First 32 bits of an md5 hex digest as a number in [0, 1)."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(2 ** 32)


def split_quotas(counts: DataFrame, test_size: float = TEST_SIZE, classes: int = 0) -> DataFrame:
    """Validation rows per class: ``(_g, quota)`` from ``(_g, n)``, one row per class.

    Training places go out by largest remainder: each class gets the whole part of its share,
    the places left over go one each to the largest remainders (smaller class first on ties);
    validation gets the rest.  Whole numbers throughout, ranked by Spark: in one window for a
    class table of bounded size, by distributed running counts if ``classes`` is beyond that.
    """
    n = counts.agg(F.sum("n")).scalar()
    share = counts.withColumn("_all", n).withColumn(
        "_places", F.col("_all") - F.ceil(F.lit(test_size) * F.col("_all")).cast("long"))
    share = (share.withColumn("_whole", F.expr("n * _places div _all"))
             .withColumn("_part", F.col("n") * F.col("_places") - F.col("_whole") * F.col("_all")))
    left = F.col("_places") - share.agg(F.sum("_whole")).scalar()
    if classes <= CLASS_TABLE_MAX_ROWS:
        share = share.withColumn("_one_before", F.row_number().over(Window.orderBy(F.desc("_part"), F.asc("_g"))) - 1)
    else:
        order = F.struct((-F.col("_part")).alias("p"), F.col("_g"))
        share = ranks.running_totals(share.withColumn("_one", F.lit(1).cast("long")).withColumn("_order", order),
                                     [], "_order", ["_one"])
    given = (F.col("_one_before") < left).cast("long")
    return share.select("_g", (F.col("n") - F.col("_whole") - given).alias("quota"))


# Digits of the hash that a counting pass adds, and the rows of a class's boundary that are
# ranked by one window task.
DIGITS = 4
BOUNDARY_ROWS = 100_000


def hash_cuts(work: DataFrame, group: str, hash_col: str, quotas: DataFrame) -> DataFrame:
    """``(_cg, _t)``: the hash at place ``quota`` (from 1) of every group, in ascending order.

    A pass counts the rows by group and leading digits, map-side combined, and finds the digits
    in which the group's place falls (at most 16^DIGITS rows a group); the next pass counts
    one set of digits further among the rows that share them.  Once no boundary holds more than
    ``BOUNDARY_ROWS`` rows, these are ranked."""
    todo = quotas.select(F.col("_g").alias("_cg"), F.lit("").alias("_lead"), F.col("quota").alias("_left"))
    rows = work.select(F.col(group).alias("_g"), F.col(hash_col).alias("_h"))
    length = 0
    while True:
        groups = todo.count()
        at = rows.join(bounded(todo, groups), F.col("_g").eqNullSafe(F.col("_cg")) & F.startswith("_h", "_lead"))
        length += DIGITS
        counts = at.groupBy("_cg", F.substring("_h", 1, length).alias("_to")).agg(
            F.count(F.lit(1)).alias("_n"), F.first("_left").alias("_left"))
        upto = F.sum("_n").over(Window.partitionBy("_cg").orderBy("_to"))
        todo = (counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_left"))
                                                       & (F.col("_upto") - F.col("_n") < F.col("_left")))
                .select("_cg", F.col("_to").alias("_lead"),
                        (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), "_n")).checkpoint()
        most = todo.agg(F.max("_n")).first()[0]
        todo = todo.drop("_n")
        if most is None or most <= BOUNDARY_ROWS or length >= 32:
            break
    if length >= 32:        # rows of one hash: all of them end at that hash
        return todo.select("_cg", F.col("_lead").alias("_t"))
    at = rows.join(bounded(todo, groups), F.col("_g").eqNullSafe(F.col("_cg")) & F.startswith("_h", "_lead"))
    nth = F.row_number().over(Window.partitionBy("_cg").orderBy("_h"))
    return at.withColumn("_nth", nth).where("_nth = _left").select("_cg", F.col("_h").alias("_t"))


def stratified_split(df: DataFrame, label_col: str, key_cols: list[str],
                     test_size: float = TEST_SIZE, seed: int = SEED, exact: bool = True,
                     split_col: str = "split") -> DataFrame:
    """add ``split`` ('train' | 'val').  Stratified iff every class has >= 2 rows."""
    h = row_hash(key_cols, seed)
    if not exact:
        return df.withColumn(split_col, F.when(uniform(h) < test_size, F.lit("val"))
                             .otherwise(F.lit("train")))
    work = df.withColumn("_h", h)
    by_class = work.groupBy(F.col(label_col).alias("_g")).agg(F.count(F.lit(1)).alias("n")).persist()
    classes, least, rows = by_class.agg(F.count(F.lit(1)), F.min("n"), F.sum("n")).first()
    if not rows:
        by_class.unpersist()
        return work.drop("_h").withColumn(split_col, F.lit("train"))
    counts, group = by_class, F.col(label_col)
    if least < 2:
        group = F.lit(None).cast(df.schema[label_col].dataType)
        counts = counts.agg(F.sum("n").alias("n")).select(group.alias("_g"), "n")
        classes = 1
    ensure_checkpoint_dir(df.sparkSession)
    quotas = split_quotas(counts, test_size, classes).where("quota > 0")
    cut = hash_cuts(work.withColumn("_g", group), "_g", "_h", quotas).checkpoint()   # one row per class
    by_class.unpersist()
    out = (work.withColumn("_g", group)
           .join(bounded(cut, classes), on=F.col("_g").eqNullSafe(F.col("_cg")), how="left")
           .drop("_cg"))
    return (out.withColumn(split_col, F.when(F.col("_h") <= F.col("_t"), F.lit("val"))
                           .otherwise(F.lit("train")))
            .drop("_h", "_t", "_g"))


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)
