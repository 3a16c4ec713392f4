"""Analyst operators (E11–E20): dataset facts, preprocessing plan, findings, summaries.

``analyze`` chains B1 → B2 → E11–E15 → profile → E17/E18.  Its outputs are
small DataFrames (one row per column / class / finding) plus a dict of scalar
facts; no data rows are collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric_text as NT
from . import clean as CL
from . import features as FT
from . import profile as P


@dataclass
class Analysis:
    facts: dict
    columns: DataFrame              # column profile (features and target)
    dataset: DataFrame              # one-row totals
    class_balance: DataFrame | None
    plan: DataFrame
    findings: DataFrame
    routes: DataFrame
    info: dict = field(default_factory=dict)


#: What the plan says for each route (route, raw type, treatment, steps, reason).
PLAN_WORDS = [
    ("numeric", None, "Numeric", "Median impute → StandardScaler", "Already numeric"),
    ("numeric_text", "string", "Numeric (extracted)",
     "Extract number from string → Median impute → StandardScaler", None),
    ("text", "free text", "TF-IDF", "TfidfVectorizer (max 300 features, unigrams+bigrams)",
     "High avg word count — free text column"),
    ("one_hot", "categorical", "One-Hot Encoded", "Mode impute → OneHotEncoder ({n} categories)",
     "Low cardinality: {n} unique values"),
    ("frequency", "categorical", "Frequency Encoded",
     "Replace category with its frequency in training set → StandardScaler",
     "High cardinality: {n} unique values (>15)"),
]


def _by_route(words: dict[str, str | None]) -> Column:
    """The text of the row's route, ``{n}`` replaced by its number of distinct values."""
    out = F.lit(None).cast("string")
    for route, text in words.items():
        if text is not None:
            out = F.when(F.col("route") == route, F.replace(
                F.lit(text), F.lit("{n}"), F.col("n_unique").cast("string")) if "{n}" in text else F.lit(text)
            ).otherwise(out)
    return out


def preprocessing_plan(df: DataFrame, target: str, routes: DataFrame | None = None) -> DataFrame:
    """Treatment per feature column, with an example for extracted numbers.

    The example is the smallest raw value (deterministic, instead of the first row); examples
    of all string columns come from one aggregate of the table and join the routes.
    """
    routes = routes if routes is not None else FT.route_columns(df, target)
    routes = routes.withColumn("route", F.when(F.col("route").isin([w[0] for w in PLAN_WORDS]), F.col("route"))
                               .otherwise("frequency"))
    strings = [c for c, t in df.dtypes if t == "string" and c != target]
    least = [F.struct(F.lit(c).alias("column"), F.min(c).alias("example")) for c in strings]
    none = [F.struct(F.lit("").alias("column"), F.lit(None).cast("string").alias("example"))]
    example = df.agg(F.array(*(least or none)).alias("all")).select(F.inline("all"))
    number = (F.when(F.col("pattern") == "range", NT.range_midpoint("example"))
              .when(F.col("pattern") == "unit", NT.unit_number("example"))
              .otherwise(NT.leading_number("example")))
    shown = F.concat(F.lit("e.g. '"), F.col("example"), F.lit("' → "), F.format_string("%.2f", number))
    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    word = {k: _by_route({w[0]: w[k] for w in PLAN_WORDS}) for k in (1, 2, 3, 4)}
    return routes.join(example, "column", "left").select(
        "column", F.coalesce(word[1], kinds[F.col("column")]).alias("raw_type"), word[2].alias("treatment"),
        word[3].alias("steps"), F.when(F.col("route") == "numeric_text", shown).otherwise(word[4]).alias("reason"))


def _listed(rows: DataFrame, share: str, order: list) -> DataFrame:
    """One row ``listed``: ``column (share%)`` of the rows in order, comma separated; null if none."""
    item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)],
                    F.concat(F.col("column"), F.lit(" ("), F.col(share).cast("string"), F.lit("%)")).alias("item"))
    items = F.array_sort(F.collect_list(item))     # one item per column
    return rows.agg(F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda i: i["item"]), ", "))
                    .alias("listed"))


def findings(facts: dict, columns: DataFrame, target: str) -> DataFrame:
    """Rule-based data-quality findings with recommendations, one query per rule."""
    fact = columns.sparkSession.range(1)
    feats = columns.where(F.col("column") != target)
    n_dup, pct = facts.get("n_duplicates", 0), facts.get("duplicate_pct", 0)
    high = _listed(feats.where(F.col("missing_pct") > 10), "missing_pct", [F.col("position")])
    worst = _listed(P.worst_outliers(columns, target), "pct", [-F.col("pct"), F.col("column")])
    converted = F.array_sort(F.collect_list(F.struct("position", "column")))
    named = feats.where("is_converted").agg(
        F.array_join(F.transform(converted, lambda c: F.concat(F.lit("'"), c["column"], F.lit("'"))), ", ")
        .alias("listed")).where("listed <> ''")
    #: Rule, its rows, severity, message around the list, recommendation.
    rules = [
        ("imbalance", fact.where(F.lit(bool(facts.get("is_imbalanced")))).select(F.lit("").alias("listed")), "risk",
         ("Class imbalance — minority class may be underlearned.", ""), "Use class_weight='balanced' in model."),
        ("missing", high.where(F.lit(facts.get("missing_ratio", 0) > 0.05)), "risk",
         ("High missing values in: ", "."), "Consider dropping or imputing high-null columns."),
        ("duplicates", fact.where(F.lit(n_dup > 0)).select(F.lit(f"{n_dup} duplicate rows ({pct}%)").alias("listed")),
         "risk", ("", " detected."), "Duplicates will be removed before training."),
        ("outliers", worst, "risk", ("Numeric outliers detected in: ", "."),
         "Review high-outlier columns; consider clipping, transformations, or robust "
         "tree-based models when values are valid extremes."),
        ("converted", named, "info", ("Columns [", "] contain numeric values stored as strings (e.g. '8GB', "
                                      "'1.37kg') — will be extracted automatically."), None),
    ]
    parts = [rows.where("listed IS NOT NULL").select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        F.concat(F.lit(before), F.col("listed"), F.lit(after)).alias("message"),
        F.lit(advice).cast("string").alias("recommendation"))
        for rule, rows, severity, (before, after), advice in rules]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_summary(columns: DataFrame, target: str, n: int = 15) -> DataFrame:
    """Compact view of the first ``n`` feature columns."""
    f = columns.where(F.col("column") != target).orderBy("position").limit(n)
    rng = F.when(F.col("col_type") == "numeric",
                 F.concat_ws(" – ", F.col("min").cast("string"), F.col("max").cast("string")))
    top3 = F.when(F.col("col_type") != "numeric",
                  F.transform(F.slice("top_values", 1, 3), lambda t: t["value"]))
    return f.select("column", F.col("col_type").alias("type"), "missing_pct", "n_unique",
                    rng.alias("range"), "mean", "outlier_count", "outlier_pct",
                    top3.alias("top_values"),
                    F.when(F.col("is_converted"), F.lit("originally string, extracted as numeric"))
                    .alias("note"))


def column_view(columns: DataFrame) -> DataFrame:
    """One formatted line per column (the interactive column table)."""
    return columns.orderBy("position").select(
        "column", F.format_string("%s | %s | missing %.2f%% | unique %d | mean %s | outliers %d",
                                  "column", "col_type", "missing_pct", "n_unique",
                                  F.coalesce(F.col("mean").cast("string"), F.lit("-")),
                                  "outlier_count").alias("line"))


def _facts(base: DataFrame, target: str, name: str) -> tuple[dict, DataFrame | None]:
    task = P.task_type(base, target).first()["task_type"]
    totals = P.dataset_totals(base).first().asDict()
    ratio = P.missing_ratio(base).first()["missing_ratio"]
    balance, imb = None, {"is_imbalanced": False, "n_classes": None}
    if task == "classification":
        balance = P.class_balance(base, target)
        r = P.imbalance(base, target).first()
        imb = {"is_imbalanced": bool(r["is_imbalanced"]), "n_classes": int(r["n_classes"])}
    facts = {"name": name, "target": target, "task_type": task, "n_samples": totals["n_rows"],
             "n_features": len(base.columns) - 1, "missing_ratio": ratio,
             "n_duplicates": totals["n_duplicates"], "duplicate_pct": totals["duplicate_pct"],
             **imb}
    return facts, balance


def dataset_facts(df: DataFrame, target: str, name: str = "dataset") -> dict:
    """E7, E11, E13–E15 only: the analyst's facts without the column profile, routing and
    plan (a handful of aggregates over the whole table)."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found.")
    base = CL.drop_id_columns(CL.drop_missing_target(df, target), target)
    return _facts(base, target, name)[0]


def analyze(df: DataFrame, target: str, name: str = "dataset") -> Analysis:
    """Analyst step: B1, B2, E7, E11–E18 on the whole table."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found.")
    base = CL.drop_id_columns(CL.drop_missing_target(df, target), target)
    facts, balance = _facts(base, target, name)
    cols = P.profile_columns(base)
    cols = cols.cache()
    routes = FT.route_columns(base, target)
    plan = preprocessing_plan(base, target, routes)
    return Analysis(facts, cols, P.dataset_totals(base), balance, plan,
                    findings(facts, cols, target), routes)


def feature_types(df: DataFrame, target: str | None = None, routes: DataFrame | None = None) -> DataFrame:
    """``(column, feature_type)`` — numeric / numeric_string / categorical."""
    routes = routes if routes is not None else FT.route_columns(df, target)
    return routes.select("column", F.when(F.col("route") == "numeric", "numeric")
                         .when(F.col("route") == "numeric_text", "numeric_string")
                         .otherwise("categorical").alias("feature_type"))
