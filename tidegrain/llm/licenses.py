"""Licence scans: a paragraph classifier trained here, an unknown class calibrated on ordinary paragraphs, and template comparison.

Paragraphs stand between blank lines; a notice may be wrapped over their lines, which are scanned one by one and joined. Lines and
paragraphs are cut into overlapping windows; the word n-grams (1 to 3) of each are hashed to sparse vectors and classified by multinomial
logistic regression. A family is taken if its probability exceeds the level that windows unlike every template reach (``FALSE_RATE`` of
them at most, a level for each family), and confirmed if the window holds ``CONFIRM`` of a template's word pairs. For each
paragraph and kin of families, lines that hold a template count first, then the best window of the joined lines, then the best one
that holds ``CONFIRM`` of a part of ``PART`` words of a template (a notice that breaks off). Within a kin (GPL, CC-BY), the template
most alike names the family.

Cue words spare the classifier what the comparison could not confirm: they are chosen from the templates so that of every template and
part more than 1 - ``CONFIRM`` of the pairs hold one; a window without a cue word thus cannot hold ``CONFIRM`` of any, and no finding is
lost to them.

The training set is the templates with their parts, the counter-examples, and every distinct window with a cue word of all documents
that is unlike every template: no other window is ever classified. However many these are, they weigh ``BACKGROUND`` in all at most.
For the levels, each half of them (by hash) is scored by a model that learned from the other half; a level is the least step of
1 / ``STEPS`` that at most ``FALSE_RATE`` of all of them exceed. All work is DataFrame expressions and Spark's own JVM learner.

Defined results: a null or empty text has no findings; very long texts and lines are scanned whole; repeated rows get equal results
(a paragraph found in several rows of an id counts once); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import cut, table

UNKNOWN = "unknown"
FEATURES = 1 << 13
WIDTHS = (8, 16, 48)  # words of a window; each width moves by half of itself
BACKGROUND = 2_000  # weight of all background windows together
STEPS = 1_000_000
FALSE_RATE = 0.001
CONFIRM = 0.6
PART = 16  # words
UNLIKE = 0.3  # of a template's word pairs: what holds less of every template is background
MARGIN = 0.2  # a line this much less alike than the joined lines is a piece of them
BREAK = r"\n[ \t\r]*\n"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"

#: Short public statements of each licence family.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License v3.0.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License v3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["Released under CC0 1.0; no copyright is claimed.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "This work is dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["All rights reserved. No part of this work may be reproduced without written permission.", "Copyright. All rights reserved.", "This software is proprietary; unauthorized copying is prohibited, all rights reserved."],
}
#: Sentences that hold cue words without granting anything.
COUNTER = [
    "He lost his driving licence on the way to work.", "She is a licensed doctor in three countries.", "The license plate was covered with mud.", "The course explains the history of copyright law.",
    "Ask for permission before you enter.", "Poets take licence with grammar.", "The bar had its licence revoked last year.", "Copyright disputes fill the courts every year.",
    "A fishing license costs ten crowns a season.", "The footage is believed to be in the public domain in some countries.", "The pilot renewed her license in May.", "Which license should I choose for my project?",
]


#: Words of the templates that are too common elsewhere to be cues.
COMMON = frozenset("a an and any are as at be by can either for free from in is it may mit no not of on or part person such that the this to under version with without".split())


def cue_words() -> list[str]:
    """Words that stand in more than 1 - CONFIRM of the word pairs of every template and every part of one, taken greedily."""
    words_of = re.compile(TOKEN).findall
    texts = [t for own in TEMPLATES.values() for t in own] + [t for _, t in part_texts()]
    units = [{*zip(w, w[1:], strict=False)} for w in (words_of(t.lower()) for t in texts)]
    cues: set[str] = set()
    while short := [own for own in units if sum(not cues.isdisjoint(pair) for pair in own) <= (1 - CONFIRM) * len(own)]:
        gain = Counter(w for own in short for pair in own if cues.isdisjoint(pair) for w in {*pair} - COMMON)
        cues.add(min(gain, key=lambda w: (-gain[w], w)))
    return sorted(cues)


def part_texts() -> list[tuple[str, str]]:
    """family, text: every run of PART words of the longer templates."""
    return [(f, " ".join(w[k : k + PART])) for f, own in TEMPLATES.items() for w in map(str.split, own) for k in range(len(w) - PART + 1) if len(w) > PART]


CUES = r"(?i)\b(?:" + "|".join(map(re.escape, cue_words())) + r")\b"


def grams(text: Column, *sizes: int) -> Column:
    """Distinct word n-grams of a text; its words are found once and bound, not once for every n-gram."""

    def all_of(words: Column) -> Column:
        def of(n: int) -> Column:
            if n == 1:
                return words
            return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(reduce(F.concat, [of(n) for n in sizes]))

    return F.element_at(F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))), all_of), 1)


def windows(text: Column) -> Column:
    """Overlapping runs of words of each width, the last one reaching the end; a text no longer than a width is one window of it."""
    return windows_of(F.split(F.trim(text), r"\s+"))


def windows_of(words: Column) -> Column:
    """The same of words; as a column they are split once and not for every window."""

    def of(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - width // 2), F.lit(width // 2))
        return F.transform(starts, lambda s: F.array_join(F.slice(words, s, width), " "))

    return F.array_distinct(reduce(F.concat, [of(w) for w in WIDTHS]))


def _table_of(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in pairs])))


def templates(spark: SparkSession) -> DataFrame:
    return _table_of(spark, [(f, t) for f, own in TEMPLATES.items() for t in own])


def template_parts(spark: SparkSession) -> DataFrame:
    return _table_of(spark, part_texts())


class Scanner:
    """A fitted classifier with its calibrated level for each family."""

    def __init__(self, spark: SparkSession, model: LogisticRegressionModel, families: list[str]):
        self.spark, self.model, self.families = spark, model, families
        self.levels = [0.5] * len(families)

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Adds ``p_``, the probability of each family, to rows with a column ``window``."""
        counted = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams_", outputCol="features_").transform(df.withColumn("grams_", grams(F.col("window"), 1, 2, 3)))
        scored = self.model.setFeaturesCol("features_").setProbabilityCol("p_").setPredictionCol("").setRawPredictionCol("").transform(counted)
        return scored.withColumn("p_", vector_to_array("p_")).drop("grams_", "features_")

    def classify(self, df: DataFrame) -> DataFrame:
        """Adds family and probability (of the likeliest family; unknown below its level) to rows with a column ``window``."""
        scored = self.probabilities(df)
        options = F.array(*[F.struct(F.col("p_")[i].alias("p"), F.lit(f).alias("f"), F.lit(level).alias("level")) for i, (f, level) in enumerate(zip(self.families, self.levels, strict=True)) if f != UNKNOWN])
        best = F.array_max(options)
        scored = scored.withColumn("best_", best)
        return scored.withColumn("family", F.when(F.col("best_.p") > F.col("best_.level"), F.col("best_.f")).otherwise(UNKNOWN)).withColumn("probability", F.col("best_.p")).drop("p_", "best_")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scanner:
    return train_on(cued_windows(docs, id_col, text_col))


def train_on(cued: DataFrame) -> Scanner:
    """A scanner from all windows of ``cued_windows``."""
    spark = cued.sparkSession
    families = [UNKNOWN, *TEMPLATES]
    every = cut(cued.select("window").distinct())
    known = templates(spark).unionByName(template_parts(spark)).select(grams(F.col("text"), 2).alias("template"))
    pairs = every.withColumn("pairs", grams(F.col("window"), 2)).crossJoin(F.broadcast(known))  # the templates: a constant
    like = pairs.where(F.size(F.array_intersect("pairs", "template")) >= UNLIKE * F.size("template")).select("window").distinct()
    ordinary = cut(every.join(like, "window", "left_anti").withColumn("part", F.pmod(F.xxhash64("window", F.lit(1)), F.lit(2))))
    words = F.split("text", " ")
    # Each template whole, and its parts without up to a third of the words at either end.
    parts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 3).cast("int")), lambda k: F.array_join(F.slice(words, k + 1, F.size(words)), " ")))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 3).cast("int")), lambda k: F.array_join(F.slice(words, F.lit(1), F.size(words) - k), " ")))
    positive = templates(spark).select("family", F.explode(F.array_distinct(F.concat(F.array("text"), parts, heads))).alias("window"))
    fixed = positive.unionByName(_table_of(spark, [(UNKNOWN, t) for t in COUNTER]).select("family", F.col("text").alias("window"))).withColumn("part", F.lit(None).cast("long"))
    number = reduce(lambda c, i: c.when(F.col("family") == families[i], float(i)), range(1, len(families)), F.when(F.col("family") == UNKNOWN, 0.0))
    rows = fixed.unionByName(ordinary.select(F.lit(UNKNOWN).alias("family"), "window", "part")).withColumn("label", number).withColumn("grams_", grams(F.col("window"), 1, 2, 3))
    counted = cut(HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams_", outputCol="features").transform(rows).select("label", "features", "part"))
    sizes = {r.part: r.n for r in ordinary.groupBy("part").agg(F.count("*").alias("n")).collect()}  # two numbers

    def fitted(used: Column, n: int) -> LogisticRegressionModel:
        weight = F.when(F.col("part").isNull(), 1.0).otherwise(min(1.0, BACKGROUND / max(n, 1)))
        return LogisticRegression(maxIter=25, regParam=0.002, family="multinomial", tol=1e-4, weightCol="weight").fit(counted.where(F.col("part").isNull() | used).withColumn("weight", weight))

    n = sum(sizes.values())
    scanner = Scanner(spark, fitted(F.lit(True), n), families)
    # Windows above a half for one family are all that a level depends on; they are counted by steps, which bounds what the driver reads.
    step = F.floor(F.col("p_")[F.col("i")] * STEPS)
    seen = []
    for part in sizes:
        other = Scanner(spark, fitted(F.col("part") != part, n - sizes[part]), families)
        scored = other.probabilities(ordinary.where(F.col("part") == part)).select("p_", F.explode(F.sequence(F.lit(0), F.lit(len(families) - 1))).alias("i"))
        seen.append(scored.where(F.col("p_")[F.col("i")] > 0.5).select("i", step.alias("step")))
    if seen:
        above = F.sum("n").over(Window.partitionBy("i").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0))
        over = reduce(DataFrame.unionByName, seen).groupBy("i", "step").agg(F.count("*").alias("n")).withColumn("above", above).where(F.col("above") > FALSE_RATE * n)
        for r in over.groupBy("i").agg(F.max("step").alias("step")).collect():  # a row a family at most
            scanner.levels[r.i] = max(0.5, (r.step + 1) / STEPS)
    return scanner


def cued_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_, block, paragraph, tier (1: a line, 2: joined lines), window: the windows with a cue word of all texts."""
    blocks = F.split(df[text_col], BREAK)
    cued = df.where(df[text_col].rlike(CUES)).select(df[id_col].alias("id_"), blocks.alias("blocks"), F.posexplode(blocks).alias("block", "body")).where(F.col("body").rlike(CUES))
    before = F.size(F.split(F.array_join(F.slice("blocks", F.lit(1), F.col("block")), "\n\n"), "\n")) + 1  # lines: a break has two line ends
    cued = cued.select("id_", "block", F.when(F.col("block") == 0, 0).otherwise(before).alias("at"), "body")
    lines = F.transform(F.split("body", "\n"), lambda t, i: F.struct((F.col("at") + i).alias("paragraph"), t.alias("text"), F.lit(1).alias("tier")))
    joined = F.array(F.struct(F.col("at").alias("paragraph"), F.col("body").alias("text"), F.lit(2).alias("tier")))
    cutted = cued.select("id_", "block", F.inline(F.concat(lines, joined))).where(F.col("text").rlike(CUES)).select("id_", "block", "paragraph", "tier", F.split(F.trim("text"), r"\s+").alias("words"))
    cutted = cutted.select("id_", "block", "paragraph", "tier", F.explode(windows_of(F.col("words"))).alias("window"))
    return cutted.where(F.col("window").rlike(CUES))


def scan(df: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, paragraph (number from 0 of the line, or of the first line of the joined ones), family, probability, similarity: confirmed findings."""
    return confirmed(cued_windows(df, id_col, text_col), scanner, id_col)


def confirmed(cutted: DataFrame, scanner: Scanner, id_col: str = "doc_id") -> DataFrame:
    """The findings of ``scan`` in the windows of ``cued_windows``."""
    kin = lambda c: F.regexp_replace(F.regexp_replace(c, "^CC-BY.*$", "CC-BY"), "^[AL]?GPL.*$", "GPL")
    found = scanner.classify(cutted).where(F.col("family") != UNKNOWN).withColumnRenamed("family", "said").withColumn("kin", kin("said"))
    spark = cutted.sparkSession
    known = templates(spark).withColumn("part", F.lit(0)).unionByName(template_parts(spark).withColumn("part", F.lit(1))).select("family", kin("family").alias("kin"), "part", grams(F.col("text"), 2).alias("template"))
    met = found.withColumn("pairs", grams(F.col("window"), 2)).join(F.broadcast(known), "kin")  # TEMPLATES: a constant
    met = met.withColumn("similarity", F.size(F.array_intersect("pairs", "template")) / F.greatest(F.size("template"), F.lit(1)))
    met = met.where((F.col("similarity") >= CONFIRM) & ((F.col("tier") == 2) | (F.col("part") == 0))).withColumn("tier", F.col("tier") + F.col("part"))
    kin_of = Window.partitionBy("id_", "block", "kin")
    joined_best = F.max(F.when(F.col("tier") == 2, F.col("similarity"))).over(kin_of)
    met = met.withColumn("top", F.coalesce(joined_best, F.lit(0.0))).where((F.col("tier") > 1) | (F.col("similarity") >= F.col("top") - MARGIN))
    met = met.withColumn("least", F.min("tier").over(kin_of)).where("tier = least")
    best = met.groupBy("id_", "paragraph", "tier", F.when(F.col("tier") > 1, F.col("kin")).alias("k")).agg(F.max(F.struct("similarity", (F.col("said") == F.col("family")).alias("own"), "probability", "family")).alias("b"))
    return best.select(F.col("id_").alias(id_col), F.col("paragraph").cast("long").alias("paragraph"), "b.family", "b.probability", "b.similarity")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cued = cut(cued_windows(docs))
    found = confirmed(cued, train_on(cued)).groupBy(F.col("doc_id").alias("d_")).agg(F.count("*").alias("n_found"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    rows = docs.select("doc_id").join(found, docs["doc_id"].eqNullSafe(F.col("d_")), "left")
    return rows.select("doc_id", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"), F.coalesce("families", F.lit("")).alias("families"))
