"""Artefacts (A9): the fitted feature pipeline and the model, saved beside each other under
one folder (shared storage on a cluster), with a small description of the model's kind."""

from __future__ import annotations

import importlib
import json

from pyspark.sql import SparkSession

from ..operators.features import FittedFeatures
from ..operators.models import CalibratedLinearSVCModel
from ..operators.naive_bayes import GaussianNBModel
from ..operators.neighbors import KNN, KNNModel
from ..operators.trees import TreeEnsembleModel


def _put(spark: SparkSession, path: str, about: dict) -> None:
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_artifacts(path: str, features: FittedFeatures, model) -> None:
    """Save both; a model of no known kind raises ``TypeError``."""
    features.save(f"{path}/features")
    save_model(path, model)


def save_model(path: str, model) -> None:
    spark = SparkSession.active()
    about: dict = {"kind": type(model).__name__}
    if isinstance(model, (GaussianNBModel, TreeEnsembleModel)):
        about["model"] = model.to_dict()
    elif isinstance(model, CalibratedLinearSVCModel):
        about |= {"features": model.features, "sigmoid": [[a, b] for _, a, b in model.parts]}
        for k, (svc, _, _) in enumerate(model.parts):
            svc.write().overwrite().save(f"{path}/model/part{k}")
    elif isinstance(model, KNNModel):
        about["params"] = vars(model.p)
        model.train.write.mode("overwrite").parquet(f"{path}/model")
    elif hasattr(model, "write"):
        about |= {"kind": "spark", "module": type(model).__module__, "class": type(model).__name__}
        model.write().overwrite().save(f"{path}/model")
    else:
        raise TypeError(f"no way to save a {type(model).__name__}")
    _put(spark, f"{path}/about", about)


def load_features(spark: SparkSession, path: str) -> FittedFeatures:
    return FittedFeatures.load(spark, f"{path}/features")


def load_model(path: str, model_class=None):
    """The saved model; ``model_class`` overrides the class of a Spark ML model."""
    if model_class is not None:
        return model_class.load(f"{path}/model")
    spark = SparkSession.active()
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if about["kind"] == "GaussianNBModel":
        return GaussianNBModel.from_dict(about["model"])
    if about["kind"] == "TreeEnsembleModel":
        return TreeEnsembleModel.from_dict(about["model"])
    if about["kind"] == "CalibratedLinearSVCModel":
        from pyspark.ml.classification import LinearSVCModel
        parts = [(LinearSVCModel.load(f"{path}/model/part{k}"), a, b) for k, (a, b) in enumerate(about["sigmoid"])]
        return CalibratedLinearSVCModel(parts, about["features"])
    if about["kind"] == "KNNModel":
        return KNNModel.saved(spark.read.parquet(f"{path}/model"), KNN(**about["params"]))
    return getattr(importlib.import_module(about["module"]), about["class"]).load(f"{path}/model")
