"""Licence scans: a trained paragraph classifier, in DataFrame functions only.

A multinomial logistic regression over sparse word n-grams (one to three words)
tells licence families, other licences and no licence apart. A second,
one-dimensional logistic regression, fitted on held-out documents, turns its odds
into a calibrated probability of being a licence at all. A prediction counts as
confirmed when a template of the predicted family is found in the paragraph by
its word pairs.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable
from .samples import bounded

#: Statements by which the licence families are named or granted.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "License: MIT"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-3.0", "GNU GPLv3"),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "Distributed under the GNU GPL v3 or any later version."),
    ("gpl-3.0", "Distributed under GPLv3 or any later version."),
    ("agpl-3.0", "Released under the AGPLv3."),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("lgpl", "Available under LGPL 2.1."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Available under the MPL 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("all-rights-reserved", "All rights reserved."),
)
#: Sentences about licences that grant or name none.
CONTRARY = (
    "The license of the driver was checked by the police.",
    "A fishing license is valid for one year in all public waters.",
    "The version of the source code was released by the general.",
    "All public work is under way and all terms are reserved for later.",
    "This work is done under the terms of the project in version 2.",
    "The rights of the person are reserved to the public.",
    "Creative work is common in the public domain of the general version.",
    "Permission to use the file is subject to the terms of use.",
    "The software is distributed free of charge and without modification.",
)
#: Statements of licences that no family here is of, and of ones without a name.
OTHERS = (
    "Licensed under the Eclipse Public License 2.0.",
    "This program is made available under the terms of the Eclipse Public License.",
    "Licensed under the EUPL.",
    "Released under the zlib License.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is licensed under the terms in the accompanying license file.",
    "This work is licensed under a license of its own.",
    "Available under the Open Database License.",
    "Licensed under the Universal Permissive License.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Zlib",
)
NONE, UNKNOWN = "none", "unknown"
#: Documents that paragraphs are learned from, at most (half of them for calibration), and paragraphs of these without a licence.
SAMPLE, PLAIN = 20_000, 3_000
#: Least share of a template's word pairs in the paragraph; least calibrated
#: probability of a licence; least share of its family where no template confirms it.
SIMILAR, CERTAIN, CLEAR = 0.7, 0.5, 0.9
#: Probability of any licence that a further family without a template's confirmation needs.
SURE = 0.9

_BREAK = r"(?:\r\n|[\n\r\x{2028}\x{2029}])"
#: Blank lines end a paragraph, and so does a line that ends a sentence; other lines go on in the next.
_PARAGRAPH_END = rf"{_BREAK}[ \t]*{_BREAK}\s*|(?<=[.!?])[ \t]*{_BREAK}"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?=[^\p{N}]|$)"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of ``n`` words."""
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")))


def _grams(tokens: Column) -> Column:
    return F.concat(*(ngrams(tokens, n) for n in (1, 2, 3)))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, paragraph, body``: the paragraphs of each text that have any character."""
    parts = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), _PARAGRAPH_END))
    return docs.select(F.col(id_col).alias("doc_id"), parts.alias("paragraph", "body")).where(F.trim("body") != "")


def runs(text: Column, known: list[str]) -> Column:
    """The distinct runs of consecutive words of ``known`` in a text. Every n-gram
    of such words is in one of them; other words are not looked at again."""
    marks = F.array_join(F.transform(words(text), lambda w: F.when(w.isin(known), w).otherwise("")), " ")
    return F.array_distinct(F.filter(F.transform(F.split(marks, "  +"), lambda r: F.trim(r)), lambda r: r != ""))


def _grams_of_runs(r: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(r, lambda one: _grams(F.split(one, " ")))))


@dataclass
class Scanner:
    labels: list[str]  # none, unknown, families
    vocabulary: CountVectorizerModel
    classes: LogisticRegressionModel
    calibration: LogisticRegressionModel | None
    templates: DataFrame

    @property
    def known(self) -> list[str]:
        return sorted({w for term in self.vocabulary.vocabulary for w in term.split(" ")})

    def _odds(self, grams: DataFrame) -> DataFrame:
        """``grams`` with ``p`` (by class) and ``odds`` of any licence, as log."""
        scored = self.classes.transform(self.vocabulary.transform(grams)).withColumn("p", vector_to_array("probability"))
        return scored.drop("features", "rawPrediction", "probability", "prediction").withColumn("odds", F.log((1 - F.col("p")[0] + 1e-12) / (F.col("p")[0] + 1e-12)))

    def reachable(self, tokens: Column) -> Column:
        """False only where the classifier gives less than ``CERTAIN`` to these
        words in any order.

        Against no licence, a class has its intercept and at most the weights of
        its terms that are positive. A term is present only with all its words, so
        its weight is put on the longest of them; the odds of any licence are
        the sum over the classes."""
        slope, base = float(self.calibration.coefficients[0]), float(self.calibration.intercept)
        if slope <= 0:
            return F.lit(True)
        weights, intercepts = self.classes.coefficientMatrix.toArray(), self.classes.interceptVector.toArray()
        more, gain = np.maximum(0, weights[1:] - weights[0]), {}
        for term, w in zip(self.vocabulary.vocabulary, more.T, strict=True):
            word = max(term.split(" "), key=lambda x: (len(x), x))
            gain[word] = gain.get(word, 0) + w
        gain = {word: w.tolist() for word, w in gain.items() if w.any()}
        need = (math.log(CERTAIN / (1 - CERTAIN)) - base) / slope - 1e-6
        present = F.array_intersect(tokens, _fixed(sorted(gain), "array<string>"))
        start = _fixed((intercepts[1:] - intercepts[0]).tolist(), "array<double>")
        each = F.aggregate(present, start, lambda s, x: F.zip_with(s, F.element_at(_fixed(gain, "map<string,array<double>>"), x), lambda a, b: a + b))
        return F.log(F.aggregate(each, F.lit(0.0), lambda s, x: s + F.exp(x))) >= need


def _fixed(value: list | dict, kind: str) -> Column:
    """A constant of any type; the optimizer folds it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["odds"], outputCol="one").transform(df)


def train(corpus: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Scanner:
    """Learn from statements and from the paragraphs of ``SAMPLE`` documents.

    Families are learned from the templates, whole and with every single word
    left out, alone and after other text, and from the sample's paragraphs that
    hold ``SIMILAR`` of a template; other licences from ``OTHERS`` and from
    templates without the words that only one family has; no licence from
    ``CONTRARY``, from fragments of the templates that name none, and from ``PLAIN`` paragraphs
    of the sample that hold no half of any template. Half of the sample's documents
    train the classes. On the other half, which the classes have not seen, the
    calibration is fitted. Null ids and texts are rows like others; repeated rows count once.
    """
    spark = corpus.sparkSession
    rows = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, family string, body string").coalesce(1)
    held = reliable(rows.select("template", "family", words(F.col("body")).alias("w")).withColumn("pairs", ngrams(F.col("w"), 2)))
    templates = held.orderBy("template").collect()
    families: dict[str, set[str]] = {}
    for r in templates:
        for w in r.w:
            families.setdefault(w, set()).add(r.family)
    names = sorted(w for w, f in families.items() if len(f) == 1)  # words of one family only
    others = spark.createDataFrame([(t,) for t in OTHERS], "body string").select(words(F.col("body")).alias("w")).coalesce(1)
    contrary = spark.createDataFrame([(t,) for t in CONTRARY], "body string").select(words(F.col("body")).alias("w")).coalesce(1)
    given = held.select("w").unionByName(others)
    terms = [r.g for r in given.select(F.explode(_grams(F.col("w"))).alias("g")).distinct().orderBy("g").collect()]
    labels = [NONE, UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    vocabulary = CountVectorizerModel.from_vocabulary(terms, "grams", "features")
    vocabulary = vocabulary.setBinary(True) if hasattr(vocabulary, "setBinary") else vocabulary
    out = Scanner(labels, vocabulary, None, None, held)
    # Paragraphs of the corpus.
    placed = corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("place"))
    picked = bounded(placed.select("place"), SAMPLE, "place")
    some = placed.join(F.broadcast(picked), "place", "left_semi").dropDuplicates(["place"])  # repeated rows count once
    said = paragraphs(some).select((F.abs(F.xxhash64("doc_id", "body")) % 2 == 0).alias("test"), "body")
    said = reliable(said.select("test", "body", _grams_of_runs(runs(F.col("body"), out.known)).alias("grams")))
    each = _fixed([r.pairs for r in templates], "array<array<string>>")
    share = F.transform(each, lambda t, i: F.struct((F.size(F.array_intersect(t, F.col("grams"))) / F.size(t)).alias("share"), (-i).alias("t")))
    said = reliable(said.withColumn("best", F.array_max(share)))
    name = F.element_at(_fixed([r.family for r in templates], "array<string>"), 1 - F.col("best.t"))
    found = said.where(F.col("best.share") >= SIMILAR).select(name.alias("family"), "grams", "test")
    plain = bounded(said.where(F.col("best.share") < 0.5).select(F.lit(NONE).alias("family"), "body", "grams", "test"), PLAIN, "body").select("family", "grams", "test")
    # Statements.
    drop = F.transform(F.sequence(F.lit(0), F.size("w")), lambda i: F.filter("w", lambda x, j: (j + 1) != i))
    part = lambda size: F.slice("w", 1, F.greatest(F.lit(1), F.floor(F.size("w") * size).cast("int")))
    tail = F.reverse(F.slice(F.reverse("w"), 1, F.greatest(F.lit(1), F.floor(F.size("w") * 0.35).cast("int"))))
    whole = held.select("family", "w").unionByName(others.select(F.lit(UNKNOWN).alias("family"), "w"))
    told = whole.select("family", F.explode(drop).alias("w")).where(F.size("w") > 1)
    led = whole.select("family", F.concat(F.array(*map(F.lit, ("see", "below", "for", "more", "here"))), "w").alias("w"))
    nameless = held.where(F.exists("w", lambda w: w.isin("license", "licensed"))).select(F.lit(UNKNOWN).alias("family"), F.filter("w", lambda w: ~w.isin(names)).alias("w")).where(F.size("w") > 1)
    broken = held.select(F.lit(NONE).alias("family"), F.explode(F.array(part(0.35), tail)).alias("w")).where(~F.exists("w", lambda w: w.isin(names)))
    stated = told.unionByName(led).unionByName(nameless).unionByName(broken).unionByName(contrary.select(F.lit(NONE).alias("family"), "w"))
    stated = stated.select("family", "w", (F.abs(F.xxhash64("w", "family")) % 4 == 0).alias("test")).unionByName(whole.select("family", "w", F.lit(False).alias("test")))
    stated = stated.select("family", _grams(F.col("w")).alias("grams"), "test")
    index = F.array_position(F.array(*map(F.lit, labels)), F.col("family")) - 1
    examples = reliable(stated.unionByName(found).unionByName(plain).select(index.cast("double").alias("label"), "grams", "test"))
    known = examples.where("not test")
    shown = known.groupBy("label").agg((1 / F.count("*")).alias("weight"))  # every class counts alike
    known = vocabulary.transform(known.join(F.broadcast(shown), "label"))
    out.classes = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0005, maxIter=80, tol=1e-5).fit(known)
    odds = _vector(out._odds(examples.where("test")).withColumn("label", (F.col("label") > 0).cast("double")))
    out.calibration = LogisticRegression(featuresCol="one", regParam=0.0005, maxIter=50).fit(odds)
    return out


def scan(docs: DataFrame, scanner: Scanner, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that reads as a licence: ``doc_id, paragraph,
    family, probability, template, similarity, confirmed``.

    A paragraph ends at a blank line or where a line ends a sentence, so wrapped
    notices are one. ``probability`` is the calibrated one of any licence,
    ``CERTAIN`` at least. ``family`` is the likeliest where a template of it is
    found by ``SIMILAR`` of its word pairs (``confirmed``) or where it has ``CLEAR``
    of the probability of all licences; else ``unknown``: a licence that is none
    of the families or not clearly one. ``families`` has it first and then the others
    that the paragraph grants: what reads as a further family, told by a word that
    only it has, once the terms with words that only the families before have are left
    out; by a template, or by ``CLEAR`` and ``SURE``. Null and empty texts have no paragraph; repeated rows give
    repeated results; of equally similar templates the first holds (null without
    a family). Whole texts are read; other columns are not carried.
    """
    once = F.explode(F.array(runs(F.col("body"), scanner.known)))  # else the filter below would compute the runs anew
    near = paragraphs(docs, id_col, text_col).select("doc_id", "paragraph", once.alias("runs"))
    near = near.where((F.size("runs") > 0) & scanner.reachable(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.split(r, " "))))))
    terms = _fixed(list(scanner.vocabulary.vocabulary), "array<string>")  # others count nowhere
    found = reliable(near.select("doc_id", "paragraph", F.array_intersect(_grams_of_runs(F.col("runs")), terms).alias("grams")))
    family = F.when(F.col("confirmed") | (F.col("share") >= CLEAR), F.col("guess")).otherwise(UNKNOWN)
    judged = reliable(_judged(found, scanner).where(F.col("probability") >= CERTAIN).withColumns({"family": family, "row": F.monotonically_increasing_id()}))
    further = _further(judged, scanner)
    families = F.when(F.col("more").isNull(), F.array("family")).otherwise(F.concat(F.array("family"), "more"))
    out = judged.join(further, "row", "left") if further is not None else judged.withColumn("more", F.lit(None).cast("array<string>"))
    return out.select("doc_id", "paragraph", "family", "probability", "template", "similarity", "confirmed", families.alias("families"))


def _further(judged: DataFrame, scanner: Scanner) -> DataFrame | None:
    """``row, more``: the families of licence paragraphs after their first, in the order
    found. Each pass leaves out the terms with a word that only the family found last
    has, so it ends after as many passes as there are families."""
    own: dict[str, set[str]] = {}
    for r in scanner.templates.select("family", "w").collect():  # the templates of this module
        own.setdefault(r.family, set()).update(r.w)
    names = {f: sorted(w for w in ws if sum(w in other for other in own.values()) == 1) for f, ws in own.items()}
    names_of = lambda c: F.element_at(_fixed(names, "map<string,array<string>>"), c)
    left, passes = judged.where(F.col("family") != UNKNOWN).select("row", "grams", "family", F.array("family").alias("seen")), []
    while True:
        rest = F.filter("grams", lambda g: ~F.arrays_overlap(F.split(g, " "), names_of(F.col("family"))))
        again = _judged(left.select("row", "seen", rest.alias("grams")).where(F.size("grams") > 0), scanner)
        told = F.col("confirmed") | ((F.col("share") >= CLEAR) & (F.col("probability") >= SURE))
        new = (F.col("guess") != UNKNOWN) & ~F.array_contains("seen", F.col("guess")) & F.arrays_overlap("grams", names_of(F.col("guess")))
        left = reliable(again.where((F.col("probability") >= CERTAIN) & told & F.coalesce(new, F.lit(False))).select("row", "grams", F.col("guess").alias("family"), F.concat("seen", F.array("guess")).alias("seen")))
        if left.isEmpty():
            break
        passes.append(left.select("row", F.struct(F.lit(len(passes)).alias("n"), "family").alias("found")))
    if not passes:
        return None
    every = passes[0]
    for more in passes[1:]:
        every = every.union(more)
    return every.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("found")), lambda x: x["family"]).alias("more"))


def _judged(rows: DataFrame, scanner: Scanner) -> DataFrame:
    """``rows`` (with ``grams``) and ``guess, share, probability, template, similarity, confirmed``."""
    slope, base = float(scanner.calibration.coefficients[0]), float(scanner.calibration.intercept)
    scored = scanner._odds(rows).withColumn("probability", 1 / (1 + F.exp(-(F.col("odds") * slope + base))))
    licences = F.slice("p", 2, len(scanner.labels) - 1)
    scored = scored.withColumn("guess", F.element_at(_fixed(scanner.labels[1:], "array<string>"), F.array_position(licences, F.array_max(licences)).cast("int")))
    scored = scored.withColumn("share", F.array_max(licences) / (1 - F.col("p")[0] + 1e-12))
    families = scanner.templates.groupBy(F.col("family").alias("guess")).agg(F.collect_list(F.struct("template", "pairs")).alias("templates"))
    likeness = F.transform("templates", lambda t: F.struct((F.size(F.array_intersect(t["pairs"], F.col("grams"))) / F.size(t["pairs"])).alias("similarity"), (-t["template"]).alias("t")))
    scored = scored.join(F.broadcast(families), "guess", "left").withColumn("best", F.array_max(likeness))  # one row for each family
    best = {"template": -F.col("best.t"), "similarity": F.coalesce("best.similarity", F.lit(0.0)), "confirmed": F.coalesce(F.col("best.similarity") >= SIMILAR, F.lit(False))}
    return scored.withColumns(best).drop("p", "odds", "templates", "best")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
