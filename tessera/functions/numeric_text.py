"""Rules that pull numbers out of strings (operators D1–D7).

All expressions are native Column expressions: they stay inside whole-stage
codegen and need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# ---------------------------------------------------------------------------
# These must equal the reference's rules for identical results.
#   range pattern   ^\d+\.?\d*\s*[-–]\s*\d+\.?\d*$
#   unit pattern    ^(\d+\.?\d*)\s*(GB|MB|TB|kg|g|cm|mm|GHz|MHz|W|m|inch|")?$
#   leading number  ^(\d+\.?\d*)
#   range separator [-–]   (hyphen-minus or en dash)
#   thresholds      range share > 0.10 of non-null values, then parsed > 0.70
#                   of all rows; unit / leading parsed > 0.70 of non-null values
# ---------------------------------------------------------------------------
RANGE_PATTERN = r"^\d+\.?\d*\s*[-–]\s*\d+\.?\d*$"
UNIT_PATTERN = r'^(\d+\.?\d*)\s*(GB|MB|TB|kg|g|cm|mm|GHz|MHz|W|m|inch|")?$'
LEADING_PATTERN = r"^(\d+\.?\d*)"
RANGE_SEPARATOR = "[-–]"
RANGE_SHARE_MIN = 0.10
PARSED_SHARE_MIN = 0.70

PATTERNS = ("range", "unit", "leading")

# Java needs (?U) for Unicode \d and \s, as Python's re has by default.
_U = "(?U)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_range(c) -> Column:
    """D1 predicate on the stripped value."""
    return py_strip(_c(c)).rlike(_U + RANGE_PATTERN)


def range_midpoint(c) -> Column:
    """Split the raw value on '-'/'–' and average the first two parts."""
    parts = F.split(_c(c), RANGE_SEPARATOR, -1)
    a = F.get(parts, 0).try_cast("double")
    b = F.get(parts, 1).try_cast("double")
    return (a + b) / F.lit(2.0)


def unit_number(c) -> Column:
    """D3: the number in front of an optional unit, whole value only."""
    return _extract_number(c, UNIT_PATTERN)


def leading_number(c) -> Column:
    """The number at the start of the value."""
    return _extract_number(c, LEADING_PATTERN)


def coerce_number(c) -> Column:
    """``pd.to_numeric(errors='coerce')`` — bad values become NULL."""
    return _c(c).cast("string").try_cast("double")


def extract_with(pattern: str | Column, c) -> Column:
    """Apply one fitted pattern ('range' | 'unit' | 'leading' | other)."""
    if isinstance(pattern, str):
        if pattern == "range":
            return range_midpoint(c)
        if pattern == "unit":
            return unit_number(c)
        if pattern == "leading":
            return leading_number(c)
        return coerce_number(c)
    return (F.when(pattern == "range", range_midpoint(c))
            .when(pattern == "unit", unit_number(c))
            .when(pattern == "leading", leading_number(c))
            .otherwise(coerce_number(c)))


def _extract_number(c, pattern: str) -> Column:
    got = F.regexp_extract(py_strip(_c(c)), _U + pattern, 1)
    return F.nullif(got, F.lit("")).try_cast("double")


def detection_aggs(c, name: str) -> list[Column]:
    """Counts needed by the D5 decision for one column, as aggregate exprs."""
    col = _c(c)
    nn = col.isNotNull()
    return [
        F.count(F.lit(1)).alias(f"{name}__rows"),
        F.count(col).alias(f"{name}__nonnull"),
        F.count_if(nn & is_range(col)).alias(f"{name}__range_like"),
        F.count(range_midpoint(col)).alias(f"{name}__range_parsed"),
        F.count(unit_number(col)).alias(f"{name}__unit_parsed"),
        F.count(leading_number(col)).alias(f"{name}__lead_parsed"),
    ]


def decide_pattern(rows: Column, nonnull: Column, range_like: Column,
                   range_parsed: Column, unit_parsed: Column, lead_parsed: Column) -> Column:
    """D5 decision over the counts; NULL when the column is not numeric text."""
    nn = F.greatest(nonnull, F.lit(1)).cast("double")
    allr = F.greatest(rows, F.lit(1)).cast("double")
    return (F.when((range_like > nonnull * RANGE_SHARE_MIN)
                   & (range_parsed / allr > PARSED_SHARE_MIN), F.lit("range"))
            .when(unit_parsed / nn > PARSED_SHARE_MIN, F.lit("unit"))
            .when(lead_parsed / nn > PARSED_SHARE_MIN, F.lit("leading")))
