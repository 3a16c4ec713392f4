"""Score a streaming DataFrame with a fitted ``FittedFeatures`` + Spark ML model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import FittedFeatures
from ..operators.split import row_hash


def score_stream(stream: DataFrame, features: FittedFeatures, model, keep: list[str] | None = None,
                 row_id: str = "_row_id") -> DataFrame:
    """Stateless per-micro-batch scoring: features (stream–static joins only) then the model.

    TF-IDF needs a per-row id; when the stream has none, an md5 of the row is used.
    """
    src = stream
    if row_id not in src.columns:
        src = src.withColumn(row_id, row_hash([c for c in stream.columns]))
    scored = model.transform(features.transform(src))
    cols = (keep or [c for c in stream.columns]) + ["prediction"]
    return scored.select(*[F.col(c) for c in cols])
