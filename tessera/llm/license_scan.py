"""License scan with a trained paragraph classifier (DataFrame functions and Spark ML only).

Method
1. Paragraphs are single lines, and blocks of several lines between blank lines
   with line ends read as spaces, so that hard-wrapped notices are whole.  A
   confirmed block counts if no line of its document has its family.  Those that hold none of the anchor stems and none of the chosen template 3-grams
   (``GATE``) are of no family; the others are candidates.  So many 3-grams of each
   template are chosen that none can be covered to ``COVERAGE`` without one of them.
2. A multinomial logistic regression on sparse binary word 1- to 3-grams (those
   that occur in a template or decoy, a fixed vocabulary) is trained on the family templates, cut at both ends, with other numbers and
   between paragraphs of the corpus, against the class *unknown*: paragraphs of
   the corpus without anchors (of about ``train_documents`` documents chosen by
   a hash of their id, whatever the size of the corpus) and sentences that speak
   of licences without granting one.
3. A fifth of the training rows is held out; the temperature that gives the
   least log loss on them calibrates the probabilities.  A paragraph whose most
   likely class is unknown, or whose probability is below ``threshold``, is unknown.
4. A predicted family is confirmed if the paragraph holds at least ``coverage``
   of the word 3-grams of one of its templates (numbers count as equal).

Defined results: null and empty texts have no candidate (verdict ``none``);
null ids and repeated rows are scanned like other rows, each gives a row; an
empty table gives an empty table; only id and text of the input are used.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.llm.store import written

#: Stems of which a paragraph needs one, in lower case.
ANCHORS = "licen[cs]|copyleft|creative commons|gpl|permission is|permission to use|public domain|redistribut|spdx"

#: Notices by family, in natural order.
TEMPLATES = {
    "AGPL": ["This program is licensed under the GNU Affero General Public License, version 3.",
             "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
               "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:",
            "Released under the 3-clause BSD License.", "Use of this source code is governed by a BSD-style license.",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version.",
            "Released under the GPL, version 2.", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.",
             "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction",
            "SPDX-License-Identifier: MIT"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "SPDX-License-Identifier: MPL-2.0"],
    "Public domain": ["This is free and unencumbered software released into the public domain.",
                      "This work has been released into the public domain under CC0 1.0."],
}
#: Sentences with an anchor that grant nothing.
DECOYS = ["The driver lost his license for a year.", "A fishing licence costs ten pounds at the post office.",
          "She is a licensed doctor in two states.", "The council gave permission to use the hall on Sunday.",
          "The song entered the public domain last year.", "The club will redistribute the money among its members.",
          "Public licenses are a topic of chapter three.", "Read the license of each version before you buy a copy.",
          "The software came with a commercial license from the vendor.", "He was under license as a general contractor.",
          "A license plate was found near the river.", "Permission is rarely granted to visitors without notice."]
COVERAGE = 0.6


def _gate(coverage: float) -> str:
    """Pattern (lower case) that every paragraph with this share of a template's 3-grams matches."""
    shared: dict[str, int] = {}
    split = []
    for t in [t for ts in TEMPLATES.values() for t in ts]:
        words = [re.sub("^[0-9].*", "0", w) for w in re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", t.lower())]
        split.append(list(dict.fromkeys(zip(words, words[1:], words[2:]))))
        for w in set(words):
            shared[w] = shared.get(w, 0) + 1
    chosen = set()
    for grams in split:
        spare = len(grams) - max(1, math.ceil(coverage * len(grams) - 1e-9))
        # those that an anchor finds cost nothing; then those with the rarest and longest words
        anchored = [bool(re.search(ANCHORS, " ".join(g))) for g in grams]
        order = sorted(zip(anchored, grams), key=lambda x: (
            not x[0], min(shared[w] for w in x[1]), -len("".join(x[1])), x[1]))
        chosen.update(g for has, g in order[:spare + 1] if not has)

    def pattern(gram):
        out = ""
        for n, w in enumerate(gram):
            if n:
                out += r"[\x00-/:-`{-\x7f]" + ("*" if "0" in (w, gram[n - 1]) else "+")
            out += r"[0-9]+(?:\.[0-9]+)*" if w == "0" else w
        return out
    return ANCHORS + r"|(?<![a-z])(?:" + "|".join(pattern(g) for g in sorted(chosen)) + r")(?![a-z])"


#: What a paragraph needs to be a candidate, in lower case.
GATE = _gate(COVERAGE)
UNKNOWN = "unknown"
#: Blank lines, also with the comment marks of source files.
BLANK = r"\n(?:[ \t\r]*(?:#+|//+|\*+|;+|--+)?[ \t\r]*\n)+"
VARIANTS = 24


def tokens(text: Column) -> Column:
    word = r"[a-z]+|[0-9]+(?:\.[0-9]+)*|[^\x00-\x7F]+"
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0)),
                       lambda w: F.when(w.rlike("^[0-9]"), F.lit("0")).otherwise(w))


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams of an array of words."""
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))).otherwise(
        F.array().cast("array<string>"))


def with_features(rows: DataFrame) -> DataFrame:
    """Column ``paragraph`` to ``grams`` (1- to 3-grams) and ``three`` (distinct 3-grams)."""
    rows = rows.withColumn("words", tokens(F.col("paragraph")))
    return (rows.withColumn("three", F.array_distinct(ngrams(F.col("words"), 3)))
            .withColumn("grams", F.concat("words", ngrams(F.col("words"), 2), "three")).drop("words"))


def _literal(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """``family, paragraph`` rows of fixed values, without a Python process."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(p).alias("paragraph")) for f, p in rows])))


def template_table(spark: SparkSession) -> DataFrame:
    """One row per template (a fixed, small number of rows)."""
    return _literal(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts])


def notice_table(spark: SparkSession) -> DataFrame:
    """Templates by family and decoys as unknown (fixed values)."""
    return template_table(spark).unionByName(_literal(spark, [(UNKNOWN, d) for d in DECOYS]))


def training_rows(docs: DataFrame, id_col: str, text: str, train_documents: int) -> DataFrame:
    """``paragraph, family, id``: cut and embedded templates and decoys, and paragraphs of the corpus."""
    spark = docs.sparkSession
    part = min(1.0, train_documents / max(1, docs.count()))
    sample = docs.where(F.col(id_col).isNotNull()
                        & (F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 30)) < int(part * (1 << 30))))
    lines = (sample.select(F.explode(F.split(text, "\n")).alias("paragraph"))
             .where((F.length("paragraph") > 10) & ~F.lower("paragraph").rlike(GATE)).distinct())
    lines = written(lines.withColumn("n", F.row_number().over(Window.orderBy(F.xxhash64("paragraph"))) - 1),
                    "license-sample")  # bounded by train_documents
    count = max(1, lines.count())
    v = F.col("v")
    cut = (notice_table(spark).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
           .withColumn("w", F.split("paragraph", " "))
           .withColumn("w", F.when(F.size("w") > 7, F.slice("w", v % 3 + 1, F.size("w") - v % 3 - v % 2)
                                   ).otherwise(F.col("w")))
           .withColumn("paragraph", F.regexp_replace(F.concat_ws(" ", "w"), "[0-9]", (v % 9 + 1).cast("string")))
           .withColumn("id", F.xxhash64("family", "paragraph", "v"))
           .withColumn("before", F.when(v % 4 == 1, F.pmod("id", F.lit(count))))
           .withColumn("after", F.when(v % 4 >= 2, F.pmod(F.xxhash64("id"), F.lit(count)))))
    fill = lines.select("n", F.col("paragraph").alias("fill"))
    mixed = (cut.join(fill.withColumnsRenamed({"n": "before", "fill": "head"}), "before", "left")
             .join(fill.withColumnsRenamed({"n": "after", "fill": "tail"}), "after", "left")
             .select(F.concat_ws(" ", "head", "paragraph", "tail").alias("paragraph"), "family", "id"))
    return mixed.unionByName(lines.select("paragraph", F.lit(UNKNOWN).alias("family"),
                                          F.xxhash64("paragraph").alias("id")))


@dataclass
class Model:
    vocabulary: CountVectorizerModel
    regression: LogisticRegressionModel
    families: list[str]
    temperature: float
    held_out_accuracy: float


def _chances(raw: Column, temperature: float) -> Column:
    """Softmax of an array of scores at a temperature."""
    top = F.array_max(raw)
    power = F.transform(raw, lambda x: F.exp((x - top) / temperature))
    return F.transform(power, lambda x: x / F.aggregate(power, F.lit(0.0), lambda a, b: a + b))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, train_documents: int = 400) -> Model:
    families = [*TEMPLATES, UNKNOWN]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = written(with_features(training_rows(docs, id_col, text, train_documents))
                   .select("grams", label.alias("label"), (F.pmod("id", F.lit(5)) == 0).alias("held")),
                   "license-training")
    train = rows.where("NOT held")
    # n-grams that no notice holds tell no family from another; without them the model stays small
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0).fit(
        with_features(notice_table(docs.sparkSession)))
    regression = LogisticRegression(regParam=1e-3, maxIter=60, family="multinomial", standardization=False
                                    ).fit(vocabulary.transform(train).select("features", "label"))
    # families that the sample lacks get no score
    known = families[:regression.numClasses]
    held = written(regression.transform(vocabulary.transform(rows.where("held")))
                   .select("label", "prediction", vector_to_array("rawPrediction").alias("raw")), "license-held")
    grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    loss = [F.avg(-F.log(F.greatest(F.get(_chances(F.col("raw"), t), F.col("label").cast("int")), F.lit(1e-12))))
            for t in grid]
    *losses, right = held.agg(*loss, F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()
    best = min(zip([x if x is not None else 0.0 for x in losses], grid))[1]
    return Model(vocabulary, regression, known, best, right or 0.0)


def paragraphs(docs: DataFrame, id_col: str, text: str, gate: str = GATE) -> DataFrame:
    """Rows of ``docs`` as ``doc_id, row, found``: their distinct candidate lines and blocks."""
    def candidates(parts: Column, whole: bool) -> Column:
        return F.transform(F.array_distinct(F.filter(parts, lambda p: F.lower(p).rlike(gate))),
                           lambda p: F.struct(p.alias("paragraph"), F.lit(whole).alias("whole")))

    # comment marks at the start of lines are no words
    blocks = F.transform(F.filter(F.split(text, BLANK), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "").contains("\n")),
                         lambda b: F.regexp_replace(b, r"\s*\n\s*", " "))
    held = F.lower(F.regexp_replace(text, r"\s+", " ")).rlike(gate)
    found = F.when(held, F.concat(candidates(F.split(text, "\n"), False), candidates(blocks, True)))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"),
                       F.coalesce(found, F.array().cast("array<struct<paragraph:string,whole:boolean>>")).alias("found"))


def classified(candidates: DataFrame, model: Model, *, threshold: float = 0.6, coverage: float = COVERAGE) -> DataFrame:
    """Column ``paragraph`` judged: ``family, probability, covered, verdict`` are added."""
    rows = model.regression.transform(model.vocabulary.transform(with_features(candidates)))
    rows = (rows.withColumn("chance", _chances(vector_to_array("rawPrediction"), model.temperature))
            .withColumn("probability", F.array_max("chance"))
            .withColumn("family", F.get(F.array(*map(F.lit, model.families)),
                                        (F.array_position("chance", F.col("probability")) - 1).cast("int")))
            .drop("features", "rawPrediction", "prediction", "chance", "grams"))
    shapes = with_features(template_table(candidates.sparkSession)).where(F.size("three") > 0).groupBy("family").agg(
        F.collect_list("three").alias("shapes"))  # fixed values, a few rows
    share = F.array_max(F.transform("shapes", lambda t: F.size(F.array_intersect(t, "three")) / F.size(t)))
    rows = (rows.join(F.broadcast(shapes), "family", "left").withColumn("covered", F.coalesce(share, F.lit(0.0)))
            .drop("shapes", "three"))
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= threshold)
    return rows.withColumn("verdict", F.when(sure & (F.col("covered") >= coverage), "confirmed").otherwise(UNKNOWN))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, train_documents: int = 400,
         threshold: float = 0.6, coverage: float = COVERAGE, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, family, families, probability, n_candidates, n_confirmed, verdict``.

    ``family`` is the confirmed family with the highest probability, ``families``
    all confirmed ones in order; the verdict is ``confirmed``, ``unknown``
    (candidates, none confirmed) or ``none``.  Without a ``model`` one is fitted on ``docs``.
    """
    model = model or fit(docs, id_col, text, train_documents=train_documents)
    rows = paragraphs(docs, id_col, text, GATE if coverage == COVERAGE else _gate(coverage))
    without = rows.where(F.size("found") == 0).select(
        "doc_id", F.lit(None).cast("string").alias("family"), F.lit("").alias("families"),
        F.lit(None).cast("double").alias("probability"), F.lit(0).cast("long").alias("n_candidates"),
        F.lit(0).cast("long").alias("n_confirmed"), F.lit("none").alias("verdict"))
    some = rows.where(F.size("found") > 0).groupBy("doc_id", "row").agg(
        F.count("*").alias("times"), F.first("found").alias("found"))
    judged = classified(some.select("doc_id", "row", "times", F.inline("found")), model,
                        threshold=threshold, coverage=coverage)
    sure = F.col("verdict") == "confirmed"
    best = F.max(F.when(sure, F.struct("probability", "covered", "family")))
    found = (judged.groupBy("doc_id", "row", "times").agg(
        best.alias("best"), F.array_sort(F.collect_set(F.when(sure, F.col("family")))).alias("all"),
        F.sum((~F.col("whole")).cast("long")).alias("lines"),
        F.sum((sure & ~F.col("whole")).cast("long")).alias("sure_lines"),
        F.collect_set(F.when(sure & ~F.col("whole"), F.col("family"))).alias("of_lines"),
        F.collect_list(F.when(sure & F.col("whole"), F.col("family"))).alias("of_blocks"))
        .withColumn("more", F.size(F.filter("of_blocks", lambda f: ~F.array_contains("of_lines", f))).cast("long"))
        .withColumn("n_candidates", F.greatest(F.col("lines") + F.col("more"), F.lit(1).cast("long")))
        .withColumn("n_confirmed", F.col("sure_lines") + F.col("more"))
        .withColumn("one", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
        .select("doc_id", "best.family", F.concat_ws(",", "all").alias("families"), "best.probability",
                "n_candidates", "n_confirmed",
                F.when(F.col("n_confirmed") > 0, "confirmed").otherwise(UNKNOWN).alias("verdict")))
    return without.unionByName(found)
