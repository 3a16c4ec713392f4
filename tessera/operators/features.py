"""Column routing and the fitted feature pipeline.

``FeaturePipeline(target).fit(train)`` learns, from training rows only:

* the route of every column (numeric / numeric text / free text / one-hot /
  frequency) — one pass over the distinct string values (detection, word
  counts, distinct counts weighted by multiplicity);
* extraction patterns, exact medians (sketched brackets, refined), means and
  population standard deviations, modes (top-1 of the value table), one-hot
  categories, frequency maps and the TF-IDF vocabulary.

The fitted state is small DataFrames/dicts (one row per column, per category,
per vocabulary term) except frequency maps, whose size is the distinct count of
a high-cardinality column: they are broadcast only below ``BROADCAST_MAX_ROWS`` and
measured bytes, and joined in heavy and light values otherwise.  ``transform`` is pure Column expressions plus
those joins, so it also works on a stream.
"""

from __future__ import annotations

import json
import math

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric_text as NT
from ..functions.text import word_count
from . import profile as P
from . import ranks
from .split import bounded
from .text import TfidfModel, fit_tfidf

BROADCAST_MAX_ROWS = 1_000_000
# Share of the training rows from which a value's rows are joined without a shuffle.
HEAVY_SHARE = 0.001

ROUTES = ("numeric", "numeric_text", "text", "one_hot", "frequency")


# ------------------------------------------------------------------ F3 routing
def route_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """F3 / E12 / E17 core: ``(column, position, kind, pattern, n_unique, avg_words, route)``."""
    spark = df.sparkSession
    kinds = P.column_kinds(df)
    feats = [c for c in df.columns if c != target]
    strs = [c for c in feats if kinds[c] == "string"]
    rows = []
    pat, words, nuniq = {}, {}, {}
    if strs:
        # one shuffle: the (column, value, n) table; detection, word counts and
        # distinct counts then run once per distinct value, weighted by n
        svc = P.string_value_counts(df, strs)
        det = P._detect_from_counts(svc, df.count()).select("column", "pattern", "n_unique")
        wc = svc.groupBy("column").agg(
            (F.sum(F.col("n") * word_count(F.col("value"))) / F.sum("n")).alias("avg_words"))
        for r in det.join(wc, "column").collect():              # one row per column
            pat[r["column"]] = r["pattern"]
            nuniq[r["column"]] = r["n_unique"]
            words[r["column"]] = None if r["avg_words"] is None else round(r["avg_words"], 4)
    for pos, c in enumerate(feats):
        k = kinds[c]
        if k in ("numeric", "bool", "temporal"):
            route = "numeric"
        elif pat.get(c):
            route = "numeric_text"
        elif words.get(c) is not None and words[c] >= P.TEXT_MIN_AVG_WORDS:
            route = "text"
        elif nuniq.get(c, 0) <= P.ONE_HOT_MAX:
            route = "one_hot"
        else:
            route = "frequency"
        rows.append((c, pos, k, pat.get(c), nuniq.get(c), words.get(c), route))
    return spark.createDataFrame(
        rows, "column string, position int, kind string, pattern string, n_unique long, "
              "avg_words double, route string")


def numeric_expr(df: DataFrame, c: str, kind: str) -> Column:
    if kind == "temporal":
        return F.year(F.col(c)).cast("double")      # S5: dates as their year
    return P.numeric_value(df, c)


def column_medians(df: DataFrame, exprs: dict[str, Column], exact: bool = True) -> dict:
    """exact (or approximate) median per column; columns that are all NULL are absent."""
    if not exprs:
        return {}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), e.alias("value"))
                                        for c, e in exprs.items()]))).where("value is not null")
    if exact:
        q = ranks.exact_quantiles(long.where(~F.isnan("value")), ["column"], "value", [0.5])
    else:
        q = ranks.quantiles(long.withColumn("n", F.lit(1)), ["column"], "value", "n", [0.5], exact=False)
    return {r["column"]: r["value"] for r in q.collect()}


def column_modes(df: DataFrame, cols: list[str]) -> dict:
    """most frequent value per column, smallest on ties (top-1 of the value table)."""
    if not cols:
        return {}
    vc = P.string_value_counts(df, cols)
    maxd = max([r["n_unique"] for r in P.distinct_counts(df.select(*cols)).collect()] + [0])
    top = P.top_values(vc, 1, max_distinct=maxd)
    return {r["column"]: r["value"] for r in top.collect()}


def frequency_table(df: DataFrame, c: str) -> DataFrame:
    """F8: ``(value, share)`` — share among the non-null training values."""
    vc = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).count()
    tot = df.agg(F.count(F.col(c)).alias("t")).scalar()
    return vc.select("value", (F.col("count") / tot).alias("share"))


def apply_frequency(df: DataFrame, c: str, table: DataFrame, n_rows: int, out: str) -> DataFrame:
    """Left join to the train map, default 0.0; broadcast only below bounds of rows and bytes.

    A larger map is joined in two parts: values of at least ``HEAVY_SHARE`` of the training rows (no
    more than 1 / HEAVY_SHARE of them, broadcast if their bytes allow) take their rows where they
    are, null and missing values need no join, and only the rest is shuffled by value, so no value
    brings a large share of the rows to one task."""
    t = table.select(F.col("value").alias("_fv"), F.col("share").alias("_fs"))
    key = F.col(c).cast("string")
    joined = lambda rows, part: rows.join(part, key == F.col("_fv"), "left")
    small = bounded(t, n_rows) if n_rows <= BROADCAST_MAX_ROWS else t
    if small is not t:
        got = joined(df, small)
    else:
        heavy = t.where(F.col("_fs") >= HEAVY_SHARE)
        first = joined(df, bounded(heavy, math.ceil(1 / HEAVY_SHARE)))
        settled = F.col("_fv").isNotNull() | key.isNull()
        light = t.where(F.col("_fs") < HEAVY_SHARE)
        got = first.where(settled).unionByName(joined(first.where(~settled).drop("_fv", "_fs"), light))
    return got.withColumn(out, F.coalesce(F.col("_fs"), F.lit(0.0))).drop("_fv", "_fs")


# ------------------------------------------------------------ fitted pipeline
class FittedFeatures:
    """Everything learned on the training rows; ``transform`` adds ``features``."""

    def __init__(self, target, routes, kinds, patterns, medians, means, stds, modes,
                 categories, freq_tables, freq_sizes, text_col, tfidf, row_id):
        self.target = target
        self.routes = routes
        self.kinds = kinds
        self.patterns = patterns
        self.medians = medians
        self.means = means
        self.stds = stds
        self.modes = modes
        self.categories = categories
        self.freq_tables = freq_tables
        self.freq_sizes = freq_sizes
        self.text_col = text_col
        self.tfidf: TfidfModel | None = tfidf
        self.row_id = row_id

    # F17
    def feature_names(self) -> list[str]:
        names = [f"num__{c}" for c in self.numeric_cols()]
        for c in self.onehot_cols():
            names += [f"cat__{c}_{v}" for v in self.categories[c]]
        if self.tfidf is not None:
            names += [f"text__{r['term']}" for r in self.tfidf.vocab.orderBy("idx").collect()]
        return names

    def numeric_cols(self) -> list[str]:
        return [c for c, r in self.routes.items() if r in ("numeric", "numeric_text", "frequency")
                and c in self.medians]

    def onehot_cols(self) -> list[str]:
        return [c for c, r in self.routes.items() if r == "one_hot"]

    def numeric_frame(self, df: DataFrame) -> DataFrame:
        """Raw numeric values per numeric-route column (extraction, frequency encoding)."""
        out = df
        for c, r in self.routes.items():
            if r == "frequency":
                out = apply_frequency(out, c, self.freq_tables[c], self.freq_sizes[c], f"__n_{c}")
            elif r == "numeric_text":
                out = out.withColumn(f"__n_{c}", NT.extract_with(self.patterns[c], F.col(c)))
            elif r == "numeric":
                out = out.withColumn(f"__n_{c}", numeric_expr(df, c, self.kinds[c]))
        return out

    def transform(self, df: DataFrame, out_col: str = "features", keep: bool = False) -> DataFrame:
        out = self.numeric_frame(df)
        parts: list[Column] = []
        for c in self.numeric_cols():
            x = F.coalesce(F.col(f"__n_{c}"), F.lit(self.medians[c]))          # F4
            sd = self.stds.get(c) or 1.0                                       # F6: zero std → 1
            parts.append((x - F.lit(self.means[c])) / F.lit(sd))
        for c in self.onehot_cols():                                           # F5 + F7
            v = F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c)))
            parts += [F.when(v == F.lit(cat), F.lit(1.0)).otherwise(F.lit(0.0))
                      for cat in self.categories[c]]
        arr = F.array(*[p.cast("double") for p in parts]) if parts else F.array().cast("array<double>")
        out = out.withColumn("__tab", arr)
        if self.tfidf is not None:                                             # F9–F14
            out = self.tfidf.vector(out, "__txt")
            arr = F.concat(F.col("__tab"), F.col("__txt"))
        else:
            arr = F.col("__tab")
        out = out.withColumn(out_col, array_to_vector(arr))                    # F15
        drop = [c for c in out.columns if c.startswith("__")]
        return out.drop(*drop) if not keep else out

    # State as JSON + parquet beside the model
    def save(self, path: str) -> None:
        spark = None
        meta = dict(target=self.target, routes=self.routes, kinds=self.kinds,
                    patterns=self.patterns, medians=self.medians, means=self.means,
                    stds=self.stds, modes=self.modes, categories=self.categories,
                    freq_sizes=self.freq_sizes, text_col=self.text_col, row_id=self.row_id,
                    stop_words=self.tfidf.stop_words if self.tfidf else None)
        for c, t in self.freq_tables.items():
            spark = t.sparkSession
            t.write.mode("overwrite").parquet(f"{path}/freq/{c}")
        if self.tfidf is not None:
            spark = self.tfidf.vocab.sparkSession
            self.tfidf.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        js = json.dumps(meta)
        if spark is None:
            from pyspark.sql import SparkSession
            spark = SparkSession.getActiveSession()
        spark.createDataFrame([(js,)], "meta string").coalesce(1).write.mode("overwrite").json(
            f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> "FittedFeatures":
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        freq = {c: spark.read.parquet(f"{path}/freq/{c}") for c, r in meta["routes"].items()
                if r == "frequency"}
        tfidf = None
        if meta["text_col"]:
            tfidf = TfidfModel(spark.read.parquet(f"{path}/vocab"), meta["text_col"],
                               meta["stop_words"])
        return cls(meta["target"], meta["routes"], meta["kinds"], meta["patterns"],
                   meta["medians"], meta["means"], meta["stds"], meta["modes"],
                   meta["categories"], freq, meta["freq_sizes"], meta["text_col"], tfidf,
                   meta["row_id"])


class FeaturePipeline:
    """F16: fit on the training rows, transform any split."""

    def __init__(self, target: str, row_id: str = "_row_id", exact: bool = True,
                 max_features: int = 300, stop_words: list[str] | None = None,
                 keep_all_text: bool = False):
        self.target = target
        self.row_id = row_id
        self.exact = exact
        self.max_features = max_features
        self.stop_words = stop_words
        self.keep_all_text = keep_all_text

    def fit(self, train: DataFrame, exclude: tuple[str, ...] = ()) -> FittedFeatures:
        cols = [c for c in train.columns if c not in (self.target, self.row_id, *exclude)]
        rt = route_columns(train.select(*cols))
        info = {r["column"]: r for r in rt.collect()}       # one row per column
        routes = {c: info[c]["route"] for c in cols}
        kinds = {c: info[c]["kind"] for c in cols}
        patterns = {c: info[c]["pattern"] for c in cols if info[c]["pattern"]}
        text_cols = [c for c in cols if routes[c] == "text"]
        text_col = text_cols[0] if text_cols else None
        if not self.keep_all_text:                            # B5
            for c in text_cols[1:]:
                routes[c] = "dropped"
        freq_tables, freq_sizes = {}, {}
        for c in cols:
            if routes[c] == "frequency":
                freq_tables[c] = frequency_table(train, c)
                freq_sizes[c] = int(info[c]["n_unique"] or 0)
        fitted = FittedFeatures(self.target, routes, kinds, patterns, {}, {}, {}, {}, {},
                                freq_tables, freq_sizes, text_col, None, self.row_id)
        num_cols = [c for c, r in routes.items() if r in ("numeric", "numeric_text", "frequency")]
        # extraction and frequency joins run once for the medians' passes and the moments
        num = fitted.numeric_frame(train).select(*[f"__n_{c}" for c in num_cols])
        if any(routes[c] != "numeric" for c in num_cols):
            num = num.persist(StorageLevel.MEMORY_AND_DISK)
        fitted.medians = {c: v for c, v in column_medians(
            num, {c: F.col(f"__n_{c}") for c in num_cols}, self.exact).items() if v is not None}
        kept = [c for c in num_cols if c in fitted.medians]   # all-NULL columns are dropped (F4)
        if kept:
            imputed = {c: F.coalesce(F.col(f"__n_{c}"), F.lit(fitted.medians[c])) for c in kept}
            row = num.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(imputed.values())],
                          *[F.stddev_pop(e).alias(f"s{i}") for i, e in enumerate(imputed.values())]
                          ).collect()[0]
            fitted.means = {c: row[f"m{i}"] for i, c in enumerate(kept)}
            fitted.stds = {c: (row[f"s{i}"] or 0.0) for i, c in enumerate(kept)}
        num.unpersist()
        oh = [c for c, r in routes.items() if r == "one_hot"]
        fitted.modes = column_modes(train, oh)
        if oh:
            filled = train.select(*[F.coalesce(F.col(c).cast("string"), F.lit(fitted.modes.get(c)))
                                    .alias(c) for c in oh])
            cats = P.string_value_counts(filled, oh).select("column", "value")
            got: dict = {}
            for r in cats.collect():                           # <= 15 per column
                got.setdefault(r["column"], []).append(r["value"])
            fitted.categories = {c: sorted(got.get(c, [])) for c in oh}
        if text_col:
            fitted.tfidf = fit_tfidf(train, self.row_id, text_col, self.max_features,
                                     self.stop_words)
        return fitted
