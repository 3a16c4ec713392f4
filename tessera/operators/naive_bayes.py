"""Gaussian naive Bayes with scikit-learn's variance smoothing.

Fit: one ``groupBy(label)`` of ``Summarizer`` mean / variance / count over the
feature vector (JVM-side, combines map-side) plus one overall variance pass.
The model is classes × features numbers (bounded) and is applied as literal
arrays with higher-order functions, so prediction is a projection.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GaussianNB:
    def __init__(self, var_smoothing: float = 1e-9, features: str = "features", label: str = "label"):
        self.var_smoothing = var_smoothing
        self.features = features
        self.label = label

    def fit(self, df: DataFrame) -> "GaussianNBModel":
        summ = Summarizer.metrics("mean", "variance", "count")
        per = df.groupBy(self.label).agg(summ.summary(F.col(self.features)).alias("s")).collect()
        overall = df.agg(Summarizer.metrics("variance", "count").summary(F.col(self.features))
                         .alias("s")).first()["s"]
        n_all = overall["count"]
        var_all = [v * (n_all - 1) / n_all if n_all > 1 else 0.0 for v in overall["variance"].toArray()]
        eps = self.var_smoothing * (max(var_all) if var_all else 0.0)
        total = sum(r["s"]["count"] for r in per)
        classes = []
        for r in sorted(per, key=lambda r: r[self.label]):
            n = r["s"]["count"]
            mean = r["s"]["mean"].toArray().tolist()
            var = [v * (n - 1) / n if n > 1 else 0.0 for v in r["s"]["variance"].toArray()]
            classes.append((float(r[self.label]), math.log(n / total), mean, [v + eps for v in var]))
        return GaussianNBModel(classes, self.features)


class GaussianNBModel:
    def __init__(self, classes, features: str = "features"):
        self.classes = classes      # [(label, log_prior, means, vars)]
        self.features = features

    def joint_log_likelihood(self) -> Column:
        x = vector_to_array(F.col(self.features))
        jll = []
        for _, lp, mu, var in self.classes:
            const = lp - 0.5 * sum(math.log(2 * math.pi * v) for v in var)
            m = F.array(*[F.lit(float(a)) for a in mu])
            inv = F.array(*[F.lit(0.5 / float(v)) for v in var])
            quad = F.aggregate(F.zip_with(F.zip_with(x, m, lambda a, b: (a - b) * (a - b)), inv,
                                          lambda d, w: d * w), F.lit(0.0), lambda acc, t: acc + t)
            jll.append(F.lit(const) - quad)
        return F.array(*jll)

    def transform(self, df: DataFrame) -> DataFrame:
        labels = F.array(*[F.lit(c[0]) for c in self.classes])
        out = df.withColumn("_jll", self.joint_log_likelihood())
        # maximum and total are columns of their own: inside a lambda they would be evaluated per element
        out = (out.withColumn("_mx", F.array_max("_jll"))
               .withColumn("_ex", F.transform("_jll", lambda v: F.exp(v - F.col("_mx"))))
               .withColumn("_tot", F.aggregate("_ex", F.lit(0.0), lambda a, b: a + b)))
        best = F.array_position("_jll", F.col("_mx"))
        return (out.withColumn("prediction", F.element_at(labels, best.cast("int")))
                .withColumn("probability", F.transform("_ex", lambda e: e / F.col("_tot")))
                .drop("_jll", "_mx", "_ex", "_tot"))

    def to_dict(self) -> dict:
        return {"classes": self.classes, "features": self.features}

    @classmethod
    def from_dict(cls, d: dict) -> "GaussianNBModel":
        return cls([tuple(c) for c in d["classes"]], d["features"])
