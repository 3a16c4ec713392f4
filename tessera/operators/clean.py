"""Row and column cleaning.

All of these are plan-time projections or filters except the all-distinct
integer test (one aggregate over the long value table) and ``distinct_rows``
(one shuffle on the full row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import profile as P

# Id-like column names dropped by name (case-insensitive).
ID_NAMES = ("unnamed: 0", "id", "index", "row_id", "rowid")

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """B1: rows whose target is NULL (or NaN) go."""
    return df.where(P.present(df, target))


def id_name_columns(df: DataFrame, target: str | None = None) -> list[str]:
    return [c for c in df.columns if c.lower() in ID_NAMES and c != target]


def drop_id_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """B2: drop id-like columns by name (no job)."""
    return df.drop(*id_name_columns(df, target))


def all_distinct_int_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """Integer columns whose distinct count equals the row count (target kept, S3).

    Exact distinct counts come from one aggregate over the long value table,
    never from a many-``count(distinct)`` expand.
    """
    ints = [f.name for f in df.schema.fields
            if isinstance(f.dataType, INTEGER_TYPES) and f.name != target]
    if not ints:
        return []
    counts = P.distinct_counts(df.select(*ints))
    n = df.count()
    return [r["column"] for r in counts.collect() if r["n_unique"] == n and n > 0]


def drop_all_distinct_int_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    return df.drop(*all_distinct_int_columns(df, target))


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(features, target) projections."""
    return df.drop(target), df.select(target)


def keep_first_text(df: DataFrame, text_cols: list[str], keep_all: bool = False) -> DataFrame:
    """Keep the first free-text column, drop the others."""
    return df if keep_all or len(text_cols) < 2 else df.drop(*text_cols[1:])


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows (nulls equal). All copies are identical, so which stays is moot."""
    return df.dropDuplicates()


def clean_for_training(df: DataFrame, target: str) -> DataFrame:
    """B1 → B2/B3 → C1, in the reference's order."""
    out = drop_missing_target(df, target)
    out = drop_id_columns(out, target)
    out = drop_all_distinct_int_columns(out, target)
    return distinct_rows(out)
