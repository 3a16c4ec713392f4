"""Markdown run report (L1) and its sink.

A report is a projection: ``SECTIONS`` says which column a line shows and how, and
``reports`` turns every run of a table (an experiment table, or one run that ``run()``
has just finished) into one text.  Lines of columns that are null or absent are left
out; a section without lines shows its note.  Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headings, line labels and notes of the report, in their order.
#: (heading, [(label, column, format)], note of an empty section)
SECTIONS = [
    ("## Dataset Summary", [
        ("- **File:** ", "dataset_name", "text"), ("- **Task:** ", "task_type", "capital"),
        ("- **Rows:** ", "n_samples", "text"), ("- **Features:** ", "n_features", "text"),
        ("- **Target column:** ", "target", "text"), ("- **Class balance:** ", "class_balance", "text"),
        ("- **Imbalanced:** ", "is_imbalanced", "yes"), ("- **Missing ratio:** ", "missing_ratio", "percent")], None),
    ("## Planner Strategy", [
        ("- **Trials:** ", "optuna_trials", "text"), ("- **Max retries:** ", "max_retries", "text"),
        ("- **Strategy:** ", "strategy_notes", "text"), ("- **Risk flags:**", "planner_flags", "list")],
     "- No planner decision recorded."),
    ("## Data Analysis", [
        ("", "analyst_interpretation", "text"), ("**Risks identified:**", "analyst_risks", "list"),
        ("**Recommendations:**", "analyst_recommendations", "list")], "No analyst insight recorded."),
    ("## Model Selection", [
        ("- **Architecture:** ", "architecture", "text"), ("- **Reasoning:** ", "selection_reasoning", "text"),
        ("- **Alternatives considered:** ", "alternatives", "joined")], None),
    ("## Training", [
        ("- **Final hyperparameters:** ", "hyperparams", "json"),
        ("- **Best validation loss:** ", "best_val_loss", "four"),
        ("- **Training time:** ", "training_time", "seconds"), ("- **Retry count:** ", "retry_count", "text")], None),
    ("## Results", [
        ("", "metrics", "map"), ("**Interpretation:** ", "interpretation", "text"),
        ("**Strengths:**", "strengths", "list"), ("**Critical failures:**", "critical_failures", "list")], None),
    ("## Critic Decision", [
        ("- **Status:** ", "approved", "approved"), ("- **Score:** ", "critic_score", "of ten"),
        ("- **Reasoning:** ", "critic_reasoning", "text"), ("- **Retry strategy used:** ", "retry_strategy", "text")],
     "No critic decision recorded."),
]
TITLE, CREATED, FOOTER = "# Experiment Report: ", "*Created: {}*", "*Report generated by tessera*"

_FORMATS = {
    "text": lambda c: c.cast("string"),
    "capital": F.initcap,
    "yes": lambda c: F.when(c, "Yes").when(~c, "No"),
    "approved": lambda c: F.when(c, "Approved").when(~c, "Not approved"),
    "percent": lambda c: F.format_string("%.1f%%", c * 100),
    "four": lambda c: F.format_string("%.4f", c),
    "seconds": lambda c: F.format_string("%.1fs", c),
    "of ten": lambda c: F.concat(c.cast("string"), F.lit("/10")),
    "json": lambda c: F.concat(F.lit("`"), F.to_json(c), F.lit("`")),
    "joined": lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")),
}


def _bullets(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def _line(label: str, column: Column, kind: str) -> Column:
    """One line (or a label and its bullets); null if there is nothing to show."""
    if kind == "list":
        return F.concat(F.lit(label + "\n"), _bullets(column))
    if kind == "map":
        entries = F.array_sort(F.map_entries(column))
        return F.when(F.size(entries) > 0, F.array_join(F.transform(
            entries, lambda e: F.concat(F.lit("- **"), e["key"], F.lit(":** "), e["value"].cast("string"))), "\n"))
    return F.when(column.isNotNull(), F.concat(F.lit(label), _FORMATS[kind](column)))


def reports(runs: DataFrame) -> DataFrame:
    """L1: ``(run_id, report)`` for every row of a table of runs."""
    parts = [F.concat(F.lit(TITLE), F.coalesce("dataset_name", F.lit("")))]
    if "created_at" in runs.columns:
        before, after = CREATED.split("{}")
        parts.append(F.concat(F.lit(before), F.col("created_at").cast("string"), F.lit(after)))
    for heading, lines, note in SECTIONS:
        shown = [_line(label, F.col(c), kind) for label, c, kind in lines if c in runs.columns]
        body = F.concat_ws("\n", *shown) if shown else F.lit("")
        parts += [F.lit(""), F.lit(heading), F.when(body == "", F.lit(note or "")).otherwise(body)]
    return runs.select("run_id", F.concat_ws("\n", *parts, F.lit(""), F.lit(FOOTER)).alias("report"))


#: What ``run()`` knows about one run besides its experiment record.
RUN_FIELDS = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (
        "target", "class_balance", "strategy_notes", "analyst_interpretation", "selection_reasoning",
        "interpretation", "retry_strategy")],
    *[T.StructField(c, T.ArrayType(T.StringType())) for c in (
        "analyst_recommendations", "alternatives", "strengths", "critical_failures")],
    T.StructField("missing_ratio", T.DoubleType()), T.StructField("optuna_trials", T.LongType()),
    T.StructField("max_retries", T.LongType())])


def run_report(record: DataFrame, about: dict) -> DataFrame:
    """The report of one run: its experiment record (one row) and the facts beside it."""
    cols = []
    for f in RUN_FIELDS:
        value = about.get(f.name)
        if isinstance(f.dataType, T.ArrayType):
            value = F.array(*[F.lit(x) for x in value or []])
        else:
            value = F.lit(value)
        cols.append(value.cast(f.dataType).alias(f.name))
    return reports(record.select("*", *cols))


def write_reports(found: DataFrame, path: str) -> None:
    """One text record per run."""
    found.select(F.concat_ws("\n", F.concat(F.lit("<!-- run "), F.col("run_id"), F.lit(" -->")),
                             F.col("report")).alias("value")).write.mode("overwrite").text(path)
