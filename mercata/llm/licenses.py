"""License scans by a trained paragraph classifier. DataFrame functions and Spark ML only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut

# Fixed license statements: (family, text, n-grams that must stand in a paragraph for this statement, n-grams that must not). "unknown" are
# statements of licensing that name no family of the list, many of them close to one that does.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license", "version 2.0"), ()),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", ("apache license", "version 2.0"), ()),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("spdx-license-identifier apache-2.0",), ()),
    ("mit", "Released under the MIT License.", ("mit license",), ()),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("permission is", "free of"), ()),
    ("mit", "SPDX-License-Identifier: MIT", ("spdx-license-identifier mit",), ()),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("general public", "version 3"), ("lesser", "affero")),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("general public", "version 3"), ("lesser", "affero")),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-only", ("spdx-license-identifier gpl-3.0-only",), ()),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later", ("spdx-license-identifier gpl-3.0-or-later",), ()),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("by-nc 4.0",), ()),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("attribution-noncommercial 4.0",), ()),
    ("cc-by-nc-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", ("spdx-license-identifier cc-by-nc-4.0",), ()),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("binary forms", "conditions are"), ()),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause", ("spdx-license-identifier bsd-3-clause",), ()),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause", ("spdx-license-identifier bsd-2-clause",), ()),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public",), ()),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0", ("spdx-license-identifier mpl-2.0",), ()),
    ("unknown", "This work is licensed under the terms given by its authors.", (), ()),
    ("unknown", "Released under a license of its own, version 1.0.", (), ()),
    ("unknown", "All rights reserved. Use of this file is subject to a separate agreement.", (), ()),
    ("unknown", "This work is licensed under the GNU General Public License, version 2.", (), ()),
    ("unknown", "This work is licensed under the GNU Lesser General Public License, version 3.", (), ()),
    ("unknown", "This work is licensed under the GNU Affero General Public License, version 3.", (), ()),
    ("unknown", "Licensed under CC BY 4.0.", (), ()),
    ("unknown", "This work is licensed under a Creative Commons Attribution 4.0 International License.", (), ()),
    ("unknown", "Distributed under the Boost Software License, Version 1.0.", (), ()),
    ("unknown", "Licensed under the Eclipse Public License, Version 2.0.", (), ()),
    ("unknown", "Released under the ISC License.", (), ()),
    ("unknown", "SPDX-License-Identifier: Unlicense", (), ()),
)
MARKER = r"(?i)\blicen[cs](?:e|ed|es|ing)\b"
#: Wording that puts something under a license, as distinct from a sentence that has a license as its subject.
STATES = (
    r"(?i)\blicen[cs](?:ed|ing)\b[^.]{0,60}\b(?:under|by|terms)\b|\blicen[cs]e(?:-identifier)?\s*:"
    r"|\b(?:under|terms of|subject to|see|governed by)\b[^.]{0,80}\blicen[cs]e\b|\blicen[cs]e\b[^.]{0,60}\b(?:applies|version|file|agreement|terms)\b"
)
#: The line break behind a line that ends with a stop, and those before and behind a blank line.
PARAGRAPH_END = r"(?md)(?<=[.!?:;])[^\S\n]{0,8}\n|\n(?=[^\S\n]*$)|^[^\S\n]*\n"
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"


def grams(text: Column) -> Column:
    """Distinct word unigrams and bigrams of ``text``, lower-cased."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def both(one: Column) -> Column:
        w = one["w"]
        pairs = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.concat(w, F.filter(pairs, lambda p: p.isNotNull())))

    return F.transform(F.array(F.struct(words.alias("w"))), both)[0]


def runs_of(text: Column, hint: str) -> Column:
    """array<struct<start, run>>: the runs of lines of ``text`` that match ``hint``, with the number of their first line."""

    def kept(one: Column) -> Column:
        runs = one["runs"]  # bound once, so that the text is split once
        lines = lambda r: F.length(r) - F.length(F.replace(r, F.lit("\n"), F.lit(""))) + 1
        marked = F.transform(runs, lambda r, i: F.when(r.rlike(hint), F.struct(F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda a, x: a + lines(x)).alias("start"), r.alias("run"))))
        return F.filter(marked, lambda r: r.isNotNull())

    return F.transform(F.array(F.struct(F.split(text, PARAGRAPH_END).alias("runs"))), kept)[0]


def units_of(run: Column, hint: str) -> Column:
    """array<struct<paragraph, p, wrapped>>: the lines of a run that match ``hint``, and the whole run where it has several lines."""
    lines = F.split(run["run"], r"\n")
    single = F.transform(lines, lambda p, i: F.when(p.rlike(hint), F.struct((run["start"] + i).alias("paragraph"), p.alias("p"), F.lit(False).alias("wrapped"))))
    whole = F.when(run["run"].contains("\n"), F.struct(run["start"].alias("paragraph"), run["run"].alias("p"), F.lit(True).alias("wrapped")))
    return F.filter(F.concat(single, F.array(whole)), lambda u: u.isNotNull())


def constant(value, kind: str) -> Column:
    """A nested constant as one expression; Spark folds it before the query runs."""
    return F.from_json(F.lit(json.dumps(value)), kind)


@dataclass
class LicenseModel:
    families: list[str]
    vocabulary: list[str]
    weights: np.ndarray  # family x n-gram
    bias: np.ndarray
    temperature: float
    threshold: float
    shapes: list[tuple]  # (family, n-grams, n-grams that must be there, n-grams that must not) of each template

    def logits(self, found: Column) -> Column:
        """array<double> by family from the distinct n-grams ``found``; only weighted n-grams are looked up."""
        used = np.flatnonzero(np.abs(self.weights).max(0) > 0)
        rows = [{"g": self.vocabulary[v], "w": self.weights[:, v].tolist()} for v in used]
        table = constant(rows, "array<struct<g:string,w:array<double>>>")
        start = constant(self.bias.tolist(), "array<double>")
        here = F.filter(table, lambda r: F.array_contains(found, r["g"]))
        return F.aggregate(here, start, lambda a, r: F.zip_with(a, r["w"], lambda x, y: x + y))

    def probabilities(self, found: Column) -> Column:
        def soft(one: Column) -> Column:
            e = F.transform(one, lambda x: F.exp((x - F.array_max(one)) / self.temperature))
            total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
            return F.transform(e, lambda x: x / total)

        return F.transform(F.array(self.logits(found)), soft)[0]

    def needed(self) -> list[str]:
        """N-grams of which a paragraph must hold one to reach the threshold for any family: a bound on the linear score.

        N-grams are set aside, heaviest first, until those that are left can't lift any family over the
        unknown class by enough; a paragraph without those set aside stays unknown. A bigram with a needed word is left out.
        """
        unknown = self.families.index("unknown")
        lift = np.maximum(0, self.weights - self.weights[unknown])
        margin = self.bias - self.bias[unknown]
        goal = self.temperature * math.log(self.threshold / (1 - self.threshold))
        left, aside = lift.copy(), []
        for v in np.argsort(-lift.max(0)):
            known = [k for k in range(len(self.families)) if k != unknown]
            if all(margin[k] + left[k].sum() < goal for k in known):
                break
            aside.append(int(v))
            left[:, v] = 0
        chosen = {self.vocabulary[v] for v in aside}
        return sorted(g for g in chosen if " " not in g or not chosen & set(g.split(" ")))


def train(
    docs: DataFrame, text_col: str = "text", sample_docs: int = 2000, variants: int = 60, threshold: float = 0.5, most_common: float = 0.01
) -> LicenseModel:
    """Fit the classifier on varied templates and on plain paragraphs of at most ``sample_docs`` documents (by a hash of the text).

    Every variant of a family's template loses about one word in nine, but none that tells the family, and stands between words of a plain paragraph. The temperature
    is the one under which a held-out quarter is most likely. N-grams that over ``most_common`` of plain paragraphs hold are no features. An empty table trains on the templates alone.
    """
    spark = docs.sparkSession
    hashed = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).where("t IS NOT NULL")
    last = hashed.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    texts = hashed.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min("t").alias("t"))
    plain = cut(
        texts.select(F.explode(F.split("t", r"\n+")).alias("p"))
        .where((F.length("p") > 0) & ~F.col("p").rlike(MARKER))
        .select("p", F.pmod(F.xxhash64("p"), F.lit(variants)).cast("int").alias("v"))
    )
    padding = plain.groupBy("v").agg(F.substring(F.min("p"), 1, 120).alias("pad"))
    given = spark.createDataFrame([(f, t, i) for i, (f, t, *_) in enumerate(TEMPLATES)], "family string, text string, no int")
    varied = given.select("family", "text", "no", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("v")).join(padding, "v", "left")
    telling = sorted({w for _, _, own, *_ in TEMPLATES for g in own for w in g.split(" ")})
    stays = lambda w: F.regexp_extract(F.lower(w), WORD, 0).isin(telling) | (F.col("family") == "unknown") | (F.col("v") == 0)
    kept = F.filter(F.split("text", " "), lambda w, i: (F.pmod(F.xxhash64(w, i, F.col("v")), F.lit(9)) != 0) | stays(w))
    edge = F.when(F.col("v") % 3 == 0, F.lit("")).otherwise(F.coalesce("pad", F.lit("")))
    positive = varied.select("family", F.concat_ws(" ", edge, F.array_join(kept, " ")).alias("p"), F.pmod(F.xxhash64("no", "v"), F.lit(4)).alias("fold"), F.lit(False).alias("plain"))
    negative = plain.select(F.lit("unknown").alias("family"), "p", F.pmod(F.xxhash64("p", F.lit(1)), F.lit(4)).alias("fold"), F.lit(True).alias("plain"))
    shapes = {r["no"]: (r["family"], r["g"], *TEMPLATES[r["no"]][2:]) for r in given.select("no", "family", grams(F.col("text")).alias("g")).collect()}
    vocabulary = sorted({g for _, gs, *_ in shapes.values() for g in gs})
    families = sorted({f for f, *_ in TEMPLATES})
    index = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    words = constant(vocabulary, "array<string>")
    rows = cut(
        positive.unionByName(negative)
        .select(index.cast("double").alias("label"), "fold", "plain", grams(F.col("p")).alias("g"))
        .select("label", "fold", "plain", "g", F.transform(words, lambda v: F.array_contains("g", v).cast("double")).alias("x"))
    )
    plain_rows = rows.where("plain")
    seen = {r["i"]: r["s"] for r in plain_rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("s")).collect()}
    # words common in plain text are no features: they tell nothing and would make every line a candidate
    kept = [i for i in range(len(vocabulary)) if seen.get(i, 0.0) <= most_common]
    chosen = F.transform(constant(kept, "array<int>"), lambda i: F.get("x", i))
    fit = LogisticRegression(family="multinomial", regParam=1e-3, elasticNetParam=0.5, maxIter=60, standardization=False).fit(
        rows.where("fold <> 0").select("label", array_to_vector(chosen).alias("features"))
    )
    weights, bias = np.zeros((len(families), len(vocabulary))), np.full(len(families), -50.0)
    got = fit.coefficientMatrix.toArray()
    weights[: len(got), kept], bias[: len(got)] = got, fit.interceptVector.toArray()
    weights[np.abs(weights) < 1e-6] = 0
    model = LicenseModel(families, vocabulary, weights, bias, 1.0, threshold, [v for v in shapes.values() if v[0] != "unknown"])
    tried = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0]
    held = rows.where("fold = 0").select(F.col("label").cast("int").alias("y"), model.logits(F.col("g")).alias("z"))

    def loss(t: float) -> Column:
        top = F.array_max("z")
        norm = F.aggregate(F.transform("z", lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda a, x: a + x)
        return F.avg(F.log(norm) - (F.get("z", F.col("y")) - top) / t)

    losses = held.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(tried)]).first()
    if losses[0] is not None:
        model.temperature = tried[int(np.argmin(list(losses)))]
    return model


def scan_licenses(
    docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.6
) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity): one row for each paragraph that states a license.

    A paragraph is a line, numbered from 0, or a run of lines of which each but the last ends without a stop (``PARAGRAPH_END``): a statement wrapped
    over such lines is reported once, at the first of them, if none of them states a family alone. A family is reported if its calibrated probability reaches the
    model's threshold and the paragraph holds at least ``confirm`` of the n-grams of one of its templates, those that tell it among them and none that tells another license; a line that puts something
    under a license (``STATES``) but fits no family so well, alone or in its run, is ``unknown``; one that only mentions a license gives no row. Null and empty
    texts give no rows, repeated documents each theirs. A word test derived from the weights (``LicenseModel.needed``) spares paragraphs that can't be reported.
    """
    words = "|".join(g.replace(".", r"\.").replace("-", r"\-").replace(" ", r"[^\p{L}\p{N}]+") for g in model.needed())
    hint = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words}|licen[cs](?:e|ed|es|ing))(?![\p{{L}}\p{{N}}])" if words else MARKER
    text = F.col(text_col)
    runs = docs.where(text.rlike(hint)).select(F.col(id_col).alias("doc_id"), F.explode(runs_of(text, hint)).alias("r"))
    runs = runs.select("doc_id", "r", F.monotonically_increasing_id().alias("run"))
    units = runs.select("doc_id", "run", F.explode(units_of(F.col("r"), hint)).alias("u")).select("doc_id", "run", "u.*")
    # the few paragraphs that pass are written, so that what follows reads their probabilities as columns
    found = units.withColumn("g", grams(F.col("p")))
    speaks = ~F.col("wrapped") & F.col("p").rlike(MARKER) & F.col("p").rlike(STATES)
    scored = cut(found.withColumn("pr", model.probabilities(F.col("g"))).withColumn("speaks", speaks).drop("p"))
    names = constant(model.families, "array<string>")
    known = F.transform(
        F.arrays_zip(F.col("pr").alias("pr"), names.alias("f")),
        lambda r: F.struct(F.when(r["f"] == "unknown", -1.0).otherwise(r["pr"]).alias("pr"), r["f"].alias("f")),
    )
    best = scored.withColumn("best", F.array_max(known))
    shapes = constant([dict(zip("fgyn", (f, g, list(y), list(n)))) for f, g, y, n in model.shapes], "array<struct<f:string,g:array<string>,y:array<string>,n:array<string>>>")
    held = lambda grams: F.size(F.array_intersect(grams, F.col("g")))
    tells = lambda s: (s["f"] == F.col("best.f")) & (held(s["y"]) == F.size(s["y"])) & (held(s["n"]) == 0)
    like = F.coalesce(F.array_max(F.transform(F.filter(shapes, tells), lambda s: held(s["g"]) / F.size(s["g"]))), F.lit(0.0))
    out = best.withColumn("similarity", F.round(like, 4))
    out = out.withColumn("sure", (F.col("best.pr") >= model.threshold) & (F.col("similarity") >= confirm))
    own_run, sure = W.partitionBy("run"), F.col("sure")
    out = out.withColumn("alone", F.max(sure & ~F.col("wrapped")).over(own_run)).withColumn("together", F.max(sure & F.col("wrapped")).over(own_run) & ~F.col("alone"))
    return out.where(F.when(F.col("wrapped"), F.col("together")).otherwise(sure | F.col("speaks") & ~F.col("together"))).select(
        "doc_id",
        "paragraph",
        F.when(sure, F.col("best.f")).otherwise("unknown").alias("family"),
        F.when(sure, F.col("best.pr")).otherwise(F.get("pr", F.lit(model.families.index("unknown")))).alias("probability"),
        "similarity",
    )

