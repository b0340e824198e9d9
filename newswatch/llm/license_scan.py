"""Licence notices in documents: a trained paragraph classifier, checked against templates.

Training: the template notices below, whole and with words left out or other text around them,
are the labelled paragraphs of each family; paragraphs of a bounded sample of documents that
share no three words in a row with any template are the others. A multinomial logistic
regression with an L1 penalty is fitted on their word and word-pair indicators, so few
weights differ from zero. A fifth of the labelled paragraphs is held out: there the
temperature of the probabilities and the threshold of the unknown class are calibrated.

Scanning: a line can only be predicted as a notice if its positive weights reach what the others'
class is ahead by, so those that hold none of the features needed for that are passed over and no
prediction is lost; all others are scored within their row. A family is
predicted at or above the threshold and confirmed when enough of a template's three-word
sequences are found; a line that looks like a notice but is neither is `unknown`.

Wrapped notices: lines between blank ones (and confirmed ones) are joined. Where enough of a template's
sequences lie within twice its length, that stretch is scored, and confirmed as its family in place of
the verdicts of its lines; it is named by its first line. Joined lines of which nothing is confirmed or
unknown are scored whole. Of one family, a joined stretch of lines counts once. `n_paragraphs` counts
lines that are not blank.

Everything is built-in expressions; the classifier is fitted by Spark ML on the bounded sample,
and its weights (one per feature and family) become literals of the scan.

Defined results: a null or empty text has no paragraphs; rows with equal ids are scanned one by
one; other columns are not read; an empty table gives no rows; a very long paragraph is read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newswatch.llm.common import text_of, written

NONE, UNKNOWN = "none", "unknown"

# Wordings of well-known licence notices, by family.
TEMPLATES = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
        "Released into the public domain under CC0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it under the terms of the GNU Lesser General Public License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Proprietary and confidential.",
        "No part of this publication may be reproduced without prior written permission.",
        "Copyright. All rights reserved. No part of this work may be reproduced without written permission of the publisher.",
    ),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def runs(words: Column, n: int) -> Column:
    """Distinct sequences of n words."""
    places = F.sequence(F.lit(1), F.size(words) - (n - 1))
    some = F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " ")))
    return F.when(F.size(words) >= n, some).otherwise(F.array().cast("array<string>"))


def features(words: Column) -> Column:
    return F.concat(F.array_distinct(words), runs(words, 2))


NOTICES = "array<struct<line:bigint,family:string,probability:double,overlap:double,confirmed:boolean,last:bigint>>"


@dataclass(frozen=True)
class Model:
    """The fitted classifier: plain values, a few hundred weights."""

    families: list[str]  # the last is NONE
    intercepts: list[float]
    weights: dict[str, list[float]]
    temperature: float
    threshold: float
    held_out_accuracy: float
    cues: list[str]  # words and word pairs of which a predicted notice has one


def _templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, ts in TEMPLATES.items() for t in ts]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def _examples(docs: DataFrame, sample_docs: int, sample_paragraphs: int) -> DataFrame:
    """family, words, held: labelled paragraphs; the documents and paragraphs with the smallest hashes."""
    spark = docs.sparkSession
    templates = _templates(spark).select("family", words_of(F.col("text")).alias("w"))
    all_runs = F.array(*[F.lit(t) for ts in TEMPLATES.values() for t in ts])
    template_runs = F.flatten(F.transform(all_runs, lambda t: let(words_of(t), lambda w: runs(w, 3))))
    # The sample is chosen by id alone, so that no text but its own meets in one task; at most sample_docs ids.
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    some = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(ids), "doc_id")
    lines = some.select(F.explode(F.split("text", "\n")).alias("line")).select(words_of(F.col("line")).alias("w"))
    others = (
        lines.filter(F.size("w") > 0)
        .filter(~let(F.col("w"), lambda w: F.arrays_overlap(runs(w, 3), template_runs)))
        .dropDuplicates(["w"])
        .orderBy(F.xxhash64("w"), "w")
        .limit(sample_paragraphs)
    )
    others = written(others.select(F.lit(NONE).alias("family"), "w", F.monotonically_increasing_id().alias("n")), "other-paragraphs")
    # Variants of a template: whole, each word left out (of three words none can be spared), the first and last two
    # thirds, and with text around.
    size = F.size("w")
    around = F.split(F.lit("as noted before the text above and below was kept by its makers for all readers"), " ")
    variants = F.concat(
        F.array(F.col("w"), F.concat(around, F.col("w")), F.concat(F.col("w"), around), F.concat(F.slice(around, 1, 8), F.col("w"), F.slice(around, 9, 8))),
        F.when(size > 3, F.transform(F.sequence(F.lit(0), size - 1), lambda d: F.filter(F.col("w"), lambda x, i: i != d))).otherwise(F.array().cast("array<array<string>>")),
        F.when(size >= 9, F.array(F.slice("w", 1, (size * 2 / 3).cast("int")), F.expr("slice(w, cast(size(w) / 3 as int) + 1, size(w))"))).otherwise(F.array().cast("array<array<string>>")),
    )
    own = templates.select("family", F.posexplode(variants).alias("n", "w")).select("family", "w", F.col("n").cast("long"))
    return own.unionByName(others).select("family", "w", (F.col("n") % 5 == 4).alias("held"), features(F.col("w")).alias("f"))


def train(docs: DataFrame, sample_docs: int = 400, sample_paragraphs: int = 4000, precision: float = 0.99) -> Model:
    """Fit and calibrate on the templates and at most `sample_paragraphs` of `sample_docs` documents."""
    examples = written(_examples(docs, sample_docs, sample_paragraphs), "notice-examples")
    names = [*sorted(TEMPLATES), NONE]
    index = F.create_map(*[x for k, f in enumerate(names) for x in (F.lit(f), F.lit(float(k)))])
    rows = examples.withColumn("label", index[F.col("family")])
    vectorizer = CountVectorizer(inputCol="f", outputCol="x", binary=True, minDF=2, vocabSize=4000).fit(rows.filter("NOT held"))
    x = written(vectorizer.transform(rows).select("label", "held", "x"), "notice-vectors")
    fitted = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=1e-4, elasticNetParam=1.0, maxIter=60).fit(
        x.filter("NOT held")
    )
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    held = fitted.transform(x.filter("held")).select("label", vector_to_array("rawPrediction").alias("raw"))
    held = written(held, "notice-held")
    softmax = lambda t: let(
        F.transform(F.col("raw"), lambda v: F.exp((v - F.array_max("raw")) / t)), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
    )
    grid = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    losses = held.agg(*[F.avg(-F.log(F.greatest(softmax(t)[F.col("label").cast("int")], F.lit(1e-12)))).alias(f"t{k}") for k, t in enumerate(grid)]).first()
    temperature = min(zip(losses, grid, strict=True))[1] if losses[0] is not None else 1.0
    top = held.select("label", softmax(temperature).alias("p")).select(
        F.array_max("p").alias("p"), (F.array_position("p", F.array_max("p")) - 1 == F.col("label")).alias("right")
    )
    steps = [k / 20 for k in range(8, 20)]
    shares = top.agg(F.avg(F.col("right").cast("int")).alias("all"), *[F.avg(F.when(F.col("p") >= s, F.col("right").cast("int"))).alias(f"s{k}") for k, s in enumerate(steps)]).first()
    threshold = next((s for s, share in zip(steps, shares[1:], strict=True) if share is not None and share >= precision), steps[-1])
    weights = {g: [float(v) for v in matrix[:, k]] for k, g in enumerate(vectorizer.vocabulary) if matrix[:, k].any()}
    often = rows.filter(F.col("family") == NONE).select(F.explode("f").alias("g")).filter(F.col("g").isin(list(weights))).groupBy("g").count()
    cues = needed(weights, [float(b) for b in bias], {r.g: r["count"] for r in often.collect()})
    return Model(names, [float(b) for b in bias], weights, temperature, threshold, float(shares[0] or 0.0), cues)


def needed(weights: dict[str, list[float]], intercepts: list[float], often: dict[str, int]) -> list[str]:
    """Features of which every line that the model predicts as a notice has one; [""] where it may have none.

    For each family, features are left out as long as all of them together cannot reach what the last
    class is ahead by: those first that are met in many other paragraphs for the little they add.
    """
    cues = set()
    for k, own in enumerate(intercepts[:-1]):
        ahead = intercepts[-1] - own
        if ahead <= 0:
            return [""]
        gains = {g: w[k] - w[-1] for g, w in weights.items() if w[k] > w[-1]}
        left = 0.0
        for g in sorted(gains, key=lambda g: (gains[g] / (1 + often.get(g, 0)), g)):
            left += gains[g]
            if left >= ahead * (1 - 1e-9):
                left -= gains[g]
                cues.add(g)
    return sorted(cues)


def any_of(cues: list[str]) -> str:
    """A pattern of any of the cues, their common beginnings written once: few branches are tried at each place."""
    by_first: dict[str, list[str]] = {}
    for c in cues:
        by_first.setdefault(c[:1], []).append(c[1:])
    ends = by_first.pop("", None)
    branches = [("[^a-z0-9]+" if c == " " else c) + any_of(rest) for c, rest in sorted(by_first.items())]
    if ends is not None:
        branches.append("")
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def _plain(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _template_runs(family: str) -> list[list[str]]:
    """The distinct three-word sequences of each template of a family."""
    return [list(dict.fromkeys(" ".join(w[k : k + 3]) for k in range(len(w) - 2))) for t in TEMPLATES[family] if len(w := _plain(t)) > 2]


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def predict(words: Column, model: Model, confirm: float = 0.6) -> Column:
    """struct(family, probability, overlap, confirmed) of a paragraph's words; family may be NONE or UNKNOWN."""
    table = F.map_from_arrays(F.array(*map(F.lit, model.weights)), F.array(*[F.array(*map(F.lit, v)) for v in model.weights.values()]))
    start = F.array(*map(F.lit, model.intercepts))
    scored = F.aggregate(
        features(words), start, lambda s, f: F.coalesce(F.zip_with(s, F.try_element_at(table, f), lambda a, b: a + b), s)
    )
    names = F.array(*map(F.lit, model.families))
    template_runs = F.map_from_arrays(_strings(list(TEMPLATES)), F.array(*[F.array(*map(_strings, _template_runs(f))) for f in TEMPLATES]))

    def finish(s: Column) -> Column:
        return let(F.transform(s, lambda v: F.exp((v - F.array_max(s)) / model.temperature)), lambda e: pick(e))

    def pick(e: Column) -> Column:
        p = F.array_max(e) / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
        return let(F.struct(p.alias("p"), names[F.array_position(e, F.array_max(e)).cast("int") - 1].alias("f")), decide)

    def decide(top: Column) -> Column:
        own = runs(words, 3)
        shares = F.transform(F.coalesce(F.try_element_at(template_runs, top["f"]), F.array().cast("array<array<string>>")), lambda t: F.size(F.array_intersect(own, t)) / F.size(t))
        overlap = F.coalesce(F.array_max(shares), F.lit(0.0))
        sure = (top["p"] >= model.threshold) & (overlap >= confirm)
        family = F.when(top["f"] == NONE, NONE).when(sure, top["f"]).otherwise(UNKNOWN)
        return F.struct(family.alias("family"), top["p"].alias("probability"), overlap.alias("overlap"), (sure & (top["f"] != NONE)).alias("confirmed"))

    return let(scored, finish)


def _notice(first: Column, last: Column, p: Column) -> Column:
    return F.struct(
        first.alias("line"), p["family"].alias("family"), p["probability"].alias("probability"), p["overlap"].alias("overlap"), p["confirmed"].alias("confirmed"), last.alias("last")
    )


def _wrapped(joined: Column, model: Model, confirm: float) -> Column:
    """The confirmed notices in joined lines: `joined` is an array of struct(line, word).

    For each template, the stretch of at most twice its length, from one of its sequences on, that holds most of them.
    """
    templates = F.array(*[F.struct(F.lit(f).alias("family"), _strings(t).alias("runs")) for f in TEMPLATES for t in _template_runs(f)])
    at = lambda i: F.concat_ws(" ", joined[i]["word"], joined[i + 1]["word"], joined[i + 2]["word"])
    last_place = F.size(joined) - 3
    three = F.transform(F.sequence(F.lit(0), last_place), lambda i: F.struct(i.alias("i"), at(i).alias("run")))

    def stretches(three: Column) -> Column:
        known = let(F.array_distinct(F.transform(three, lambda x: x["run"])), lambda own: F.filter(templates, lambda t: F.size(F.array_intersect(own, t["runs"])) >= confirm * F.size(t["runs"])))
        return F.filter(F.transform(known, lambda t: let(F.filter(three, lambda x: F.array_contains(t["runs"], x["run"])), lambda hits: best(t, hits))), lambda x: x.isNotNull())

    def best(t: Column, hits: Column) -> Column:
        held = lambda h: F.filter(hits, lambda x: (x["i"] >= h["i"]) & (x["i"] < h["i"] + 2 * (F.size(t["runs"]) + 2)))
        n = lambda own: F.size(F.array_distinct(F.transform(own, lambda x: x["run"])))
        # Of equal counts, the shortest stretch.
        options = F.transform(hits, lambda h: let(held(h), lambda own: F.struct(n(own).alias("n"), (h["i"] - F.element_at(own, -1)["i"]).alias("short"), h["i"].alias("i"))))
        return let(F.array_max(options), lambda o: F.when(o["n"] >= confirm * F.size(t["runs"]), let(F.slice(joined, o["i"] + 1, 3 - o["short"]), lambda own: judged(t, own))))

    def judged(t: Column, own: Column) -> Column:
        p = let(F.transform(own, lambda x: x["word"]), lambda w: predict(w, model, confirm))
        return let(p, lambda p: F.when(p["confirmed"] & (p["family"] == t["family"]), _notice(own[0]["line"], F.element_at(own, -1)["line"], p)))

    def one_each(found: Column) -> Column:
        # Of each family the best one, the first of equals.
        rank = lambda x: F.struct(x["overlap"], -x["line"], x["probability"], -x["last"])
        return F.array_distinct(F.filter(found, lambda x: ~F.exists(found, lambda y: (y["family"] == x["family"]) & (rank(y) > rank(x)))))

    return let(three, lambda x: let(stretches(x), one_each))


def scan(docs: DataFrame, model: Model, confirm: float = 0.6) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, notices (array of line, family, probability, overlap, confirmed)."""
    # Of plain words, one behind the other over whatever is between them, as words_of cuts them.
    cue = f"(?<![a-z0-9]){any_of(model.cues)}(?![a-z0-9])" if model.cues != [""] else ""
    lines = F.split("text", "\n")
    base = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    n_paragraphs = F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("n_paragraphs")
    rows = F.transform(lines, lambda x, i: F.struct(i.cast("bigint").alias("line"), words_of(x).alias("words"), F.lower(x).rlike(cue).alias("cue")))
    # Only a text with a cue somewhere is cut into words at all.
    some = F.when(F.lower("text").rlike(cue), rows) if model.cues else F.lit(None).cast("array<struct<line:bigint,words:array<string>,cue:boolean>>")
    alone = F.transform(F.filter("rows", lambda x: x["cue"]), lambda x: let(predict(x["words"], model, confirm), lambda p: _notice(x["line"], x["line"], p)))
    held = base.select("doc_id", n_paragraphs, some.alias("rows"))
    held = held.select("doc_id", "n_paragraphs", "rows", F.filter(alone, lambda x: x["family"] != NONE).alias("alone"))
    sure = F.transform(F.filter("alone", lambda x: x["confirmed"]), lambda x: x["line"])
    # Lines between those that are blank or confirmed alone, two at least.
    ends = F.concat(
        F.array(F.lit(-1).cast("bigint")),
        F.transform(F.filter("rows", lambda x: (F.size(x["words"]) == 0) | F.array_contains(sure, x["line"])), lambda x: x["line"]),
        F.array(F.size("rows").cast("bigint")),
    )
    blocks = let(
        ends,
        lambda e: F.filter(
            F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: F.slice("rows", (e[k] + 2).cast("int"), (e[k + 1] - e[k] - 1).cast("int"))), lambda b: F.size(b) > 1
        ),
    )
    joined = F.transform(blocks, lambda b: F.flatten(F.transform(b, lambda x: F.transform(x["words"], lambda w: F.struct(x["line"].alias("line"), w.alias("word"))))))
    held = held.withColumn("joined", F.when(F.col("rows").isNotNull(), joined)).drop("rows")

    def block(j: Column) -> Column:
        return let(F.struct(j[0]["line"].alias("a"), F.element_at(j, -1)["line"].alias("b")), lambda s: let(_wrapped(j, model, confirm), lambda found: F.when(whole_too(s, found), whole(j, s)).otherwise(found)))

    def whole_too(s: Column, found: Column) -> Column:
        return (F.size(found) == 0) & ~F.exists("alone", lambda x: (x["line"] >= s["a"]) & (x["line"] <= s["b"]))

    def whole(j: Column, s: Column) -> Column:
        return F.filter(F.array(let(let(F.transform(j, lambda x: x["word"]), lambda w: predict(w, model, confirm)), lambda p: _notice(s["a"], s["b"], p))), lambda x: x["family"] != NONE)

    over = F.flatten(F.transform("joined", lambda j: F.when(F.size(j) > 2, block(j)).otherwise(F.array().cast(NOTICES))))
    held = held.select("doc_id", "n_paragraphs", "alone", F.coalesce(over, F.array().cast(NOTICES)).alias("over"))
    kept = F.filter(F.coalesce("alone", F.array().cast(NOTICES)), lambda x: ~F.exists("over", lambda y: (y["line"] <= x["line"]) & (x["line"] <= y["last"])))
    return held.select("doc_id", "n_paragraphs", F.transform(F.array_sort(F.concat(kept, "over")), lambda x: x.dropFields("last")).alias("notices"))


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, families (confirmed, sorted, comma-separated), n_confirmed, n_unknown."""
    sure = F.filter("notices", lambda x: x["confirmed"])
    return scanned.select(
        "doc_id",
        "n_paragraphs",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(sure).cast("long").alias("n_confirmed"),
        (F.size("notices") - F.size(sure)).cast("long").alias("n_unknown"),
    )
