"""License scans: a trained paragraph classifier, an unknown class, and comparison with templates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.llm.common import let, settle, text_or_empty

UNKNOWN = "unknown"
#: Notices of licence families; {v} stands for a version, {h} for a year and a holder.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version {v}.",
        'Licensed under the Apache License, Version {v} (the "License"); you may not use this file except in compliance with the License.',
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD License.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution {v} International License.", "Licensed under CC BY {v}."),
    "cc-by-nc": ("Licensed under CC BY-NC {v}.", "This work is licensed under a Creative Commons Attribution-NonCommercial {v} International License."),
    "cc-by-sa": ("Licensed under CC BY-SA {v}.", "This work is licensed under a Creative Commons Attribution-ShareAlike {v} International License."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version {v}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}.", "Licensed under the Mozilla Public License, version {v}."),
    "reserved": ("All rights reserved.", "Copyright {h}. All rights reserved."),
}
FAMILIES = (UNKNOWN, *TEMPLATES)
_VERSIONS = ("1.0", "1.1", "2", "2.0", "2.1", "3", "3.0", "4.0")
_HOLDERS = ("(c) 2019 the authors", "2021 Example Ltd", "(c) 2024 A. Writer")


def paragraph_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@cache
def told() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words, and pairs of neighbours, that the families' paragraphs hold: fixed lists, as the templates are."""
    found = [_plain(text) for text, _ in training_paragraphs()]
    return tuple(sorted({w for ws in found for w in ws})), tuple(sorted({f"{a} {b}" for ws in found for a, b in zip(ws, ws[1:])}))


def grams(text: Column) -> Column:
    """Different words and pairs of neighbours of a paragraph that the families' paragraphs hold too, in order."""
    words, pairs = told()

    def of(w: Column) -> Column:
        beside = F.zip_with(w, F.slice(w, 2, F.greatest(F.lit(1), F.size(w))), lambda a, b: F.when(a.isin(*words) & b.isin(*words), F.concat_ws(" ", a, b)))
        return F.array_sort(F.array_distinct(F.concat(F.filter(w, lambda x: x.isin(*words)), F.filter(beside, lambda x: x.isin(*pairs)))))

    return let(paragraph_words(text), of)


def training_paragraphs() -> list[tuple[str, int]]:
    """Paragraphs of each family: its templates with versions and holders filled in, marked, and with text around."""
    rows = []
    for label, family in enumerate(FAMILIES):
        for t in TEMPLATES.get(family, ()):
            fills = [t.format(v=v, h=h) for v in (_VERSIONS if "{v}" in t else ("",)) for h in (_HOLDERS if "{h}" in t else ("",))]
            for s in fills:
                rows += [(x, label) for x in (s, f"# {s}", f"// {s}", f"* {s}", s.lower(), s.rstrip("."), f"Notice. {s}", f"{s} See the file for details.")]
    return rows


class Grams:
    """Numbers of the families' words and pairs; the last stands for all others, which no feature counts."""

    def __init__(self):
        words, pairs = told()
        self.terms = [*words, *pairs, "\n"]
        self.numbers = {t: i for i, t in enumerate(self.terms)}

    def indexOf(self, gram: str) -> int:  # named as in Spark's HashingTF
        return self.numbers.get(gram, len(self.terms) - 1)

    def transform(self, rows: DataFrame) -> DataFrame:
        return CountVectorizerModel.from_vocabulary(self.terms, inputCol="_grams", outputCol="_features").setBinary(True).transform(rows)


@dataclass
class LicenseModel:
    hashing: Grams
    regression: LogisticRegressionModel
    threshold: float


def fit(docs: DataFrame, unknown_rows: int = 4000, width: int = 1 << 16, false_accepts: float = 0.001) -> LicenseModel:
    """Multinomial logistic regression over the families' words and pairs, and the threshold of the unknown class.

    Families learn from their templates; the unknown class from all different paragraphs of docs that hold no
    template, but a third, which gives the threshold: the score that only a share false_accepts of it exceeds,
    at least one half. Paragraphs with the same grams are one row with their number as its weight, so the table
    that is learnt from grows with the number of different sets of grams. All together they weigh as much as
    unknown_rows rows, at most: that is the class's prior, not a sample. Without such paragraphs (an empty table,
    null or empty texts) the families alone are learnt and the threshold is one half. width is no longer used:
    features have numbers of their own.
    """
    spark, hashing = docs.sparkSession, Grams()
    paragraph = docs.select(F.explode(F.split(text_or_empty(F.col("text")), r"\n+")).alias("_text")).where("trim(_text) <> ''")
    once = paragraph.select(F.xxhash64("_text").alias("_hash"), grams(F.col("_text")).alias("_grams")).distinct()
    sets = settle(once.groupBy("_grams", (F.pmod(F.col("_hash"), F.lit(3)) == 0).alias("_held")).agg(F.count("*").cast("double").alias("_n")))
    others = sets.where(match(F.col("_grams"), None) < 0.5)
    total = others.where("NOT _held").agg(F.sum("_n").alias("n")).first()["n"] or 1.0
    known = spark.createDataFrame(training_paragraphs(), "_text string, label int").select(grams(F.col("_text")).alias("_grams"), F.col("label").cast("double").alias("label"), F.lit(1.0).alias("_n"))
    rows = known.coalesce(1).unionByName(others.where("NOT _held").select("_grams", F.lit(0.0).alias("label"), (F.col("_n") * min(1.0, unknown_rows / total)).alias("_n")))
    regression = LogisticRegression(featuresCol="_features", weightCol="_n", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_best", maxIter=60, regParam=1e-3, family="multinomial").fit(hashing.transform(rows))
    model = LicenseModel(hashing, regression, 0.5)
    # what is below one half is so in any case; what is left are few different values
    level = classify(others.where("_held"), model).agg(F.percentile(F.greatest("_score", F.lit(0.5)), F.lit(1 - false_accepts), F.col("_n").cast("long")).alias("t")).first()["t"]
    model.threshold = max(0.5, level or 0.0)
    return model


def classify(rows: DataFrame, model: LicenseModel) -> DataFrame:
    """rows (with _grams) and _family, the likeliest but unknown, with _score, its probability."""
    p = vector_to_array(F.col("_p"))
    best = F.array_max(F.transform(F.slice(p, 2, len(TEMPLATES)), lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    scored = model.regression.transform(model.hashing.transform(rows)).withColumn("_top", best)
    return scored.drop("_features", "_raw", "_p", "_best").withColumns({"_score": F.col("_top.p"), "_family": F.element_at(F.array(*map(F.lit, TEMPLATES)), 1 - F.col("_top.i"))}).drop("_top")


def match(grams: Column, family: Column | None) -> Column:
    """Largest share of a template's word pairs that a paragraph's grams hold, over the family's templates or all.

    Versions and holders are left out of templates: a pair across a gap is not counted.
    """
    shares = []
    for name, texts in TEMPLATES.items():
        own = []
        for t in texts:
            want = sorted({f"{a} {b}" for part in t.replace("{h}", "{v}").split("{v}") for w in [_plain(part)] for a, b in zip(w, w[1:])})
            own.append(F.size(F.array_intersect(grams, F.array(*map(F.lit, want)))) / F.lit(len(want)))
        top = F.greatest(*own) if len(own) > 1 else own[0]
        shares.append(F.when(family == name, top) if family is not None else top)
    return F.greatest(*shares)


def _plain(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def scan(docs: DataFrame, model: LicenseModel | None = None, confirmed_at: float = 0.8) -> DataFrame:
    """One row per document: doc_id, license, score, n_licenses, confirmed.

    A paragraph (between line breaks) is of a family if the score reaches the model's threshold, and
    confirmed if it also holds confirmed_at of a template's word pairs. license names the families found, in
    order, joined by "+", or unknown; score is the greatest; confirmed says if all were. Paragraphs are scored
    where they are read; only those of a family are shuffled, with their row's id and text hash, which any
    task makes again alike. Null and empty texts have none; repeated rows give repeated results; null ids stay
    null; other columns are ignored.
    """
    model = model or fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    paragraph = rows.select("doc_id", "_key", F.posexplode(F.split("_text", r"\n+")).alias("_at", "_text")).where(F.rlike("_text", F.lit(r"[\p{L}\p{N}]")))
    scored = classify(paragraph.select("doc_id", "_key", "_at", grams(F.col("_text")).alias("_grams")), model)
    found = scored.where(F.col("_score") >= model.threshold).withColumn("_match", match(F.col("_grams"), F.col("_family")))
    once = found.groupBy("doc_id", "_key", "_at").agg(F.first("_family").alias("_family"), F.first("_score").alias("_score"), F.first("_match").alias("_match"))
    by_row = once.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_of")).agg(
        F.array_join(F.array_sort(F.collect_set("_family")), "+").alias("license"), F.max("_score").alias("score"), F.count("*").alias("n_licenses"), F.min(F.col("_match") >= confirmed_at).alias("confirmed")
    )
    joined = rows.select("doc_id", "_key").join(by_row, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    return joined.select(
        "doc_id", F.coalesce("license", F.lit(UNKNOWN)).alias("license"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"), F.coalesce("confirmed", F.lit(False)).alias("confirmed")
    )
