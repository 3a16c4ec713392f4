"""CSV scans (A1–A5): encoding choice, NA tokens, type inference, header, validation.

``read_csv`` reads every column as a string (no ``inferSchema`` pass), turns the
NA tokens into NULL, then decides each column's type with ONE aggregate that
counts how many values cast cleanly to bigint / double / boolean.  The
encoding and the need for multi-line fields are found in one pass over the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_records import records

# pandas' default missing-value tokens (public pandas documentation).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
BOOL_TOKENS = ("True", "False", "TRUE", "FALSE", "true", "false")
MIN_ROWS = 10
# Shape of every string Spark's ANSI cast turns into a bigint (optional sign, ASCII
# digits, edge whitespace / control characters): a superset, so guarding the cast
# with it changes no result but keeps failing values off the cast's exception path.
INT_SHAPE = r"^[\x00-\x20]*[+-]?[0-9]+[\x00-\x20]*$"


def as_bigint(v: Column) -> Column:
    return F.when(v.rlike(INT_SHAPE), v.try_cast("bigint"))


# Shape of every string Spark's ANSI cast may turn into a double: a superset, as above.
NUMBER_SHAPE = (r"(?i)^[\x00-\x20]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?[df]?|inf|infinity|nan|0x.*)"
                r"[\x00-\x20]*$")


def as_double(v: Column) -> Column:
    return F.when(v.rlike(NUMBER_SHAPE), v.try_cast("double"))


def detect_dialect(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding and whether a quoted field holds a line end, in one pass over the lines.

    UTF-8 unless some line is not valid UTF-8, then ISO-8859-1 (decodes every byte).  A line
    with an odd number of quotes opens or closes a field that goes over a line end."""
    line = F.col("value")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    r = spark.read.text(path).agg(F.max(~F.is_valid_utf8("value")), F.max(odd)).first()
    return "ISO-8859-1" if r[0] else "UTF-8", bool(r[1])


def detect_encoding(spark: SparkSession, path: str) -> str:
    return detect_dialect(spark, path)[0]


def read_strings(spark: SparkSession, path: str, encoding: str | None = None,
                 multi_line: bool | None = None) -> DataFrame:
    """Columns as strings; a quote inside a quoted field is doubled (RFC 4180, as pandas reads).

    ``multi_line`` reads line ends inside quoted fields, by default if some line has an odd
    number of quotes.  The files stay split into byte ranges: ``csv_records`` finds the records
    that begin in each, and every record is parsed where it was found."""
    if encoding is None or multi_line is None:
        found = detect_dialect(spark, path)
        encoding = encoding or found[0]
        multi_line = found[1] if multi_line is None else multi_line
    options = {"escape": '"', "mode": "PERMISSIVE"}
    reader = spark.read.options(**options, header=True, encoding=encoding, multiLine=multi_line, inferSchema=False)
    if not multi_line:
        return reader.csv(path)
    names = reader.csv(path).columns          # reads no further than the first record
    rows = records(spark, path, encoding).where(~F.col("first")).select(
        F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))),
                   options | {"multiLine": "true"}).alias("row"))
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])


def null_tokens(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """A2 (first half): NA tokens → NULL in every string column."""
    toks = list(tokens)
    return df.select(*[F.when(F.col(c).isin(toks) | F.col(c).isNull(), F.lit(None))
                       .otherwise(F.col(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """A2 (second half): a column becomes bigint / double / boolean when every
    non-null value parses as one; decided by one aggregate over all columns."""
    cols = df.columns
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c)
        aggs += [F.count(v).alias(f"n{i}"), F.count(as_bigint(v)).alias(f"i{i}"),
                 F.count(as_double(v)).alias(f"d{i}"),
                 F.count_if(v.isin(list(BOOL_TOKENS))).alias(f"b{i}")]
    r = df.agg(*aggs).first()    # one row: 4 counts per column
    out = []
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        if n and r[f"i{i}"] == n:
            out.append(as_bigint(F.col(c)).alias(c))
        elif n and r[f"d{i}"] == n:
            out.append(as_double(F.col(c)).alias(c))
        elif n and r[f"b{i}"] == n:
            out.append((F.lower(F.col(c)) == "true").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A1 + A2: the pandas-like typed table."""
    return infer_types(null_tokens(read_strings(spark, path, encoding)))


def get_columns(spark: SparkSession, path: str) -> list[str]:
    """A3: header names only (no data scan beyond the first line)."""
    return read_strings(spark, path, "UTF-8", False).columns


def validate_dataset(df: DataFrame, target: str) -> DataFrame:
    """A4: one row ``(is_valid, message, n_rows, n_cols)``."""
    spark = df.sparkSession
    n_cols = len(df.columns)
    if target not in df.columns:
        return spark.createDataFrame(
            [(False, f"Target column '{target}' not found in dataset.", None, n_cols)],
            "is_valid boolean, message string, n_rows long, n_cols int")
    n = df.count()
    if n < MIN_ROWS:
        row = (False, f"Dataset too small: only {n} rows.", n, n_cols)
    else:
        row = (True, f"Valid dataset: {n} rows, {n_cols} columns.", n, n_cols)
    return spark.createDataFrame([row], "is_valid boolean, message string, n_rows long, n_cols int")


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """A5: first rows."""
    return df.limit(n)
