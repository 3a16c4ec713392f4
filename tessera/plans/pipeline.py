"""``run()``: the whole supervised-learning loop as a plain driver loop of Spark jobs.

analyze (E) → similar past runs (K2, after profiling: S12) → search budget (J10)
→ prepare (B, C1, F1, F2, F3–F17; written once to the shared checkpoint folder)
→ model choice (J11) → search (H) → final fit (G) → evaluate (I) → rules (J)
→ retry while not approved → store (A7, A10) → report (L1, A12).

The driver only ever holds bounded metadata: facts, one profile row per
column, class lists, trial parameters, metric dicts.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis as AN
from ..operators import clean as CL
from ..operators import decide as DC
from ..operators import evaluate as EV
from ..operators import features as FT
from ..operators import memory as MM
from ..operators import models as MD
from ..operators import report as RP
from ..operators import search as SR
from ..operators import split as SP
from ..session import ensure_checkpoint_dir
from ..sources import artifacts as AR
from ..sources import experiments as EX

DEFAULT_TRIALS = 10
DEFAULT_RETRIES = 1


@dataclass
class Prepared:
    table: DataFrame            # label, split, _row_id, features (+ weight)
    features: FT.FittedFeatures
    classes: list | None
    task: str
    path: str

    @property
    def train(self) -> DataFrame:
        return self.table.where(F.col("split") == "train")

    @property
    def val(self) -> DataFrame:
        return self.table.where(F.col("split") == "val")


@dataclass
class RunResult:
    run_id: str
    facts: dict
    architecture: str
    hyperparams: dict
    metrics: dict
    approved: bool
    critic_score: float
    retry_count: int
    report: str
    trials: list = field(default_factory=list)
    record: dict = field(default_factory=dict)


def _write_read(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage with a written table in the shared folder (survives executor loss)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def prepare(df: DataFrame, target: str, task: str, work_dir: str, exact: bool = True,
            balanced: bool = False) -> Prepared:
    """F16: clean, encode, split, fit features on train, transform all rows."""
    # written once: class counts, ranks and the split all read it
    clean = _write_read(CL.clean_for_training(df, target), f"{work_dir}/clean")
    labeled, classes_df = SP.encode_labels(clean, target, task)
    feats = [c for c in clean.columns]
    labeled = labeled.withColumn("_row_id", SP.row_hash(feats, seed=0))
    if task == "classification":
        split = SP.stratified_split(labeled, "label", ["_row_id"], exact=exact)
    else:
        split = SP.stratified_split(labeled.withColumn("_g", F.lit(0)), "_g", ["_row_id"],
                                    exact=exact).drop("_g")
    split = _write_read(split, f"{work_dir}/split")
    train = split.where(F.col("split") == "train")
    fitted = FT.FeaturePipeline(target, row_id="_row_id", exact=exact).fit(
        train.drop("label", "split"))
    out = fitted.transform(split).select("_row_id", "label", "split", "features")
    if balanced and task == "classification":
        out = MD.balanced_weights(out, "label", "weight")
    table = _write_read(out, f"{work_dir}/prepared")
    classes = None
    if classes_df is not None:
        classes = [r["class"] for r in classes_df.orderBy("index").collect()]   # one per class
    return Prepared(table, fitted, classes, task, work_dir)


def evaluate_model(model, prep: Prepared) -> tuple[dict, float, float]:
    """I-operators on the validation rows; returns (metrics, train score, val score)."""
    pred = SR.predictions(model, prep.val).persist()      # scored once, read by every metric
    if prep.task == "classification" and "probability" not in pred.columns \
            and "rawPrediction" in pred.columns and len(prep.classes or []) > 2:
        # one-vs-rest models have no probabilities: normalised sigmoids of the margins
        raw = vector_to_array("rawPrediction")
        sig = F.transform(raw, lambda v: 1.0 / (1.0 + F.exp(-v)))
        tot = F.aggregate(sig, F.lit(0.0), lambda a, b: a + b)
        pred = pred.withColumn("probability", F.transform(sig, lambda v: v / tot))
    if prep.task == "classification":
        m = EV.classification_metrics(pred, "label", "prediction").first().asDict()
        if "probability" in pred.columns:
            n_cls = len(prep.classes or [])
            if n_cls == 2:
                scored = pred.select("label", vector_to_array("probability")[1].alias("score")
                                     if pred.schema["probability"].dataType.typeName() != "array"
                                     else F.col("probability")[1].alias("score"))
                auc = EV.roc_auc(scored, "label", "score", positive=1.0).first()["roc_auc"]
                if auc is not None:
                    m["roc_auc"] = auc
            elif n_cls > 2:
                auc = EV.roc_auc_ovr(pred, "label", "probability").first()["roc_auc_ovr"]
                if auc is not None:
                    m["roc_auc_ovr"] = auc
        m["recall_class_1"] = m.get("recall_class_1", 0.0)
    else:
        m = EV.regression_metrics(pred, "label", "prediction").first().asDict()
    val_score = m["f1_weighted"] if prep.task == "classification" else max(m["r2"], -1.0)
    train_score = SR.score_model(model, prep.train, prep.task)
    return m, train_score, val_score


def _judge_one(spark, architecture, task, metrics, train_score, val_score, hp, retry_count,
               max_retries) -> dict:
    row = spark.createDataFrame(
        [(architecture, task, float(train_score), float(val_score), metrics.get("accuracy"),
          metrics.get("f1_weighted"), metrics.get("roc_auc"), metrics.get("r2"),
          metrics.get("recall_class_1"), metrics.get("rmse"), metrics.get("mae"),
          {k: str(v) for k, v in hp.items()}, retry_count, max_retries)],
        "architecture string, task_type string, train_score double, val_score double, "
        "accuracy double, f1_weighted double, roc_auc double, r2 double, recall_class_1 double, "
        "rmse double, mae double, "
        "hyperparams map<string,string>, retry_count int, max_retries int")
    judged = DC.evaluation_findings(DC.retry_params(DC.judge(row)))
    return judged.first().asDict()


def run(df: DataFrame, target: str, name: str, runs_path: str, work_dir: str | None = None,
        max_retries: int | None = None, n_trials: int | None = None, exact: bool = True,
        parallelism: int = 4, on_step=None, experiment: str = "tessera",
        log_path: str | None = None) -> RunResult:
    """The whole loop.  Every attempt is logged under ``experiment`` in the run log at
    ``log_path`` (by default beside the experiment table, so that runs share it); the fitted
    features and the model are saved under ``work_dir/artifacts``."""
    spark = df.sparkSession
    ckpt = ensure_checkpoint_dir(spark)
    run_id = EX.new_run_id()
    work_dir = work_dir or f"{ckpt.rstrip('/')}/tessera-runs/{run_id}"
    step = on_step or (lambda node, info: None)

    # analyst (profile first, so the task type is known for memory: S12)
    an = AN.analyze(df, target, name)
    facts = an.facts
    task = facts["task_type"]
    step("analysis", facts)
    found = an.findings.collect()                                   # a handful of findings
    risks = [r["message"] for r in found]

    # memory + planner
    past = EX.read_experiments(spark, runs_path)
    similar_df = MM.find_similar(past, name, task)
    similar = [r.asDict(recursive=True) for r in similar_df.collect()]     # <= 3 rows
    budget = {"optuna_trials": DEFAULT_TRIALS, "max_retries": DEFAULT_RETRIES, "risk_flags": []}
    if similar:
        b = DC.search_budget(similar_df).first()
        budget.update(optuna_trials=b["optuna_trials"], max_retries=b["max_retries"])
        if b["n_approved"]:
            budget["risk_flags"].append(f"{b['n_approved']} past approved run(s) found — "
                                        "starting with fewer trials.")
        if b["n_failed"] >= 2:
            budget["risk_flags"].append("Multiple past failures detected — increasing retry budget.")
    if max_retries is not None:                      # S13: an explicit value wins
        budget["max_retries"] = max_retries
    if n_trials is not None:
        budget["optuna_trials"] = n_trials
    budget["strategy_notes"] = (f"Rule-based: {budget['optuna_trials']} trials, "
                                f"{budget['max_retries']} retries.")
    step("planner", budget)

    # selector (J11)
    arch, hp, reasoning = None, {}, ""
    for e in similar:
        if e.get("approved") and e.get("task_type") == task and e.get("architecture") in MD.ARCHITECTURES:
            arch, hp = e["architecture"], {k: SR._parse(v) for k, v in (e.get("hyperparams") or {}).items()}
            reasoning = f"Reusing approved architecture from past experiment: {arch}."
            break
    if arch is None:
        arch = spark.range(1).select(DC.default_architecture(F.lit(task), F.lit(facts["n_samples"]))
                                     ).first()[0]
        reasoning = f"Rule-based selection of {arch} for {facts['n_samples']}-row {task} dataset."
    step("selector", {"architecture": arch, "reasoning": reasoning})

    prep = prepare(df, target, task, work_dir, exact, balanced=arch in MD.BALANCED)
    weight = "weight" if "weight" in prep.table.columns else None
    n_classes = len(prep.classes or []) or 2
    step("prepare", {"features": len(prep.features.feature_names())})

    retry = 0
    trials_log = []
    narrow: dict = {}
    while True:
        trials = budget["optuna_trials"] if retry == 0 else max(5, budget["optuna_trials"] // 2)
        trial_df, best = SR.run_search(prep.train, prep.val, arch, task, trials, base_params=hp,
                                       n_classes=n_classes, weight=weight, parallelism=parallelism,
                                       narrow=narrow)
        trials_log += [r.asDict() for r in trial_df.collect()]        # <= 50 trials
        hp = {**hp, **best}
        t0 = time.time()
        model = SR.fit(arch, hp, task, prep.train, n_classes, MD.training_stats(prep.train, weight=weight),
                       weight)
        train_time = time.time() - t0
        metrics, train_score, val_score = evaluate_model(model, prep)
        j = _judge_one(spark, arch, task, metrics, train_score, val_score, hp, retry,
                       budget["max_retries"])
        step("evaluation", {"metrics": metrics, "judge": j})
        EX.log_run(spark, log_path or f"{runs_path.rstrip('/')}-log", f"{run_id}-{retry}", experiment,
                   f"{name}_retry_{retry}", {"architecture": arch, **hp},
                   {"val_score": val_score, "train_score": train_score,
                    "overfit_gap": train_score - val_score, "training_time_s": train_time})
        if j["approved"] or retry >= budget["max_retries"]:
            break
        retry += 1
        sugg = {k.replace("suggest_", ""): j[k] for k in ("suggest_max_depth", "suggest_min_samples_split",
                                                          "suggest_min_samples_leaf", "suggest_learning_rate")
                if j.get(k) is not None}
        if not sugg:
            sugg = {k.replace("retry_", ""): j[k] for k in ("retry_max_depth", "retry_min_samples_split",
                                                            "retry_min_samples_leaf", "retry_n_estimators",
                                                            "retry_learning_rate") if j.get(k) is not None}
        sugg = {k: (int(v) if k != "learning_rate" else float(v)) for k, v in sugg.items()}
        hp.update(sugg)
        narrow = {k: v for k, v in sugg.items() if k in ("max_depth", "learning_rate")}   # S7

    issues = []
    if j["is_overfit"]:
        issues.append(f"Overfitting gap {j['overfit_gap']:.3f} exceeds {j['threshold']} threshold.")
    if not j["passed"] and not (task == "regression" and (metrics.get("r2") or 0) >= 0.75):
        issues.append("Did not pass quality threshold.")
    reasoning_c = f"Score {j['critic_score']}/10. " + (f"Issues: {'; '.join(issues)}." if issues
                                                        else "No major issues.")
    record = {"dataset_name": name, "task_type": task, "n_samples": facts["n_samples"],
              "n_features": facts["n_features"], "is_imbalanced": facts.get("is_imbalanced", False),
              "architecture": arch, "hyperparams": hp, "metrics": metrics, "approved": j["approved"],
              "critic_score": j["critic_score"], "retry_count": retry, "run_id": run_id,
              "best_val_loss": 1 - val_score, "training_time": train_time,
              "planner_flags": budget["risk_flags"], "analyst_risks": risks,
              "critic_reasoning": reasoning_c}
    row = EX.experiment_row(spark, record)
    EX.append_experiments(row, runs_path)
    balance = None
    if an.class_balance is not None:
        balance = an.class_balance.agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("class").cast("string").alias("c"), "share"))),
            lambda x: F.concat(x["c"], F.lit(": "), x["share"].cast("string"))), ", ")).first()[0]
    text = RP.run_report(row, {
        "target": target, "class_balance": balance, "missing_ratio": float(facts["missing_ratio"]),
        "optuna_trials": budget["optuna_trials"], "max_retries": budget["max_retries"],
        "strategy_notes": budget["strategy_notes"],
        "analyst_interpretation": f"Dataset has {facts['n_samples']} rows, {facts['n_features']} features, "
                                  f"task={task}. Missing={facts['missing_ratio']:.1%}, "
                                  f"duplicates={facts['n_duplicates']}.",
        "analyst_recommendations": [r["recommendation"] for r in found if r["recommendation"]],
        "selection_reasoning": reasoning, "interpretation": j["interpretation"], "strengths": j["strengths"],
        "critical_failures": j["critical_failures"], "retry_strategy": j["retry_strategy"]})
    RP.write_reports(text, f"{work_dir}/report")
    text = text.first()["report"]
    AR.save_artifacts(f"{work_dir}/artifacts", prep.features, model)
    step("report", {"path": f"{work_dir}/report"})
    return RunResult(run_id, facts, arch, hp, metrics, bool(j["approved"]), float(j["critic_score"]),
                     retry, text, trials_log, record)
