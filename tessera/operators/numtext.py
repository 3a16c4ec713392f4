"""Strings to numbers (D1–D7): detection job and a fitted extractor.

``detect`` is one aggregate job over all string columns; ``NumericTextExtractor``
learns one pattern per column on the training rows (D5 rule, decision S6) and
applies it later with native Column expressions — no Python UDF.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric_text as NT
from .profile import detect_numeric_text

detect = detect_numeric_text


def extract_columns(df: DataFrame, patterns: dict[str, str | None], suffix: str = "") -> DataFrame:
    """Replace (or add with ``suffix``) each column by its extracted number."""
    out = df
    for c, p in patterns.items():
        out = out.withColumn(c + suffix, NT.extract_with(p or "numeric", F.col(c)))
    return out


class NumericTextExtractor:
    """``fit`` learns ``{column: pattern}`` on train rows; ``transform`` applies it."""

    def __init__(self, cols: list[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> "NumericTextModel":
        got = {r["column"]: r["pattern"] for r in detect(df, self.cols).collect()}  # one row per column
        return NumericTextModel({c: got.get(c) for c in self.cols})


class NumericTextModel:
    def __init__(self, patterns: dict[str, str | None]):
        self.patterns = patterns

    def transform(self, df: DataFrame) -> DataFrame:
        return extract_columns(df, self.patterns)

    def to_json(self) -> str:
        return json.dumps(self.patterns)

    @classmethod
    def from_json(cls, s: str) -> "NumericTextModel":
        return cls(json.loads(s))
