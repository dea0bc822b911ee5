import math
import random
import re

import numpy as np
import pytest

from matchloom.llm import license_scan as ls


@pytest.fixture(scope="module")
def scanner(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "under", "this", "is", "work"] + [f"w{i}" for i in range(300)]
    rows = [(i, "\n".join(" ".join(rng.choices(vocab, k=rng.randint(3, 30))) for _ in range(4))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, ls.train(docs)


def test_families_held_out_wording(spark, scanner):
    told = {
        "mit": "Some text before. RELEASED UNDER THE MIT LICENSE, see below",
        "apache-2.0": "licensed   under the Apache License, version 2.0; w1 w2 w3",
        "gpl-3.0": "The work is licensed under the GNU General Public License, version 3",
        "gpl-2.0": "This program is licensed under the GNU General Public License, version 2.",
        "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0!",
        "cc-by-4.0": "Licensed under CC BY 4.0",
        "all-rights-reserved": "(c) w7 All Rights Reserved",
    }
    rows = [(i, f"w1 w2 w3\n\n{t}\r\nthe end") for i, t in enumerate(told.values())]
    plain = ["All work and no play", "the license plate of the car", "a driving license is needed", "rights and duties", "the public domain of ideas"]
    rows += [(100 + i, t) for i, t in enumerate(plain)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, family string")
    got = {r.doc_id: r for r in ls.scan(df, scanner[1]).collect() if r.confirmed}
    assert {i: r.family for i, r in got.items()} == dict(enumerate(told))
    assert all(r.paragraph == 1 and r.similarity >= ls.SIMILAR for r in got.values())


def test_edges(spark, scanner):
    docs, s = scanner
    assert ls.scan(docs, s).count() == 0
    long = "w " * 30_000 + "Released under the MIT License." + " w" * 30_000
    odd = spark.createDataFrame([(None, None), (None, ""), (1, "\n\n"), (2, "All rights reserved."), (2, "All rights reserved."), (None, "Released under the MIT License."), (3, long)], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.family)) for r in ls.scan(odd, s).collect()) == ["(2, 'all-rights-reserved')", "(2, 'all-rights-reserved')", "(3, 'mit')", "(None, 'mit')"]
    assert ls.scan(docs.limit(0), s).collect() == []


def test_names_without_a_keyword(spark, scanner):
    told = {"gpl-3.0": "Distributed under GPLv3 or any later version.", "lgpl": "Available under LGPL-2.1.", "agpl-3.0": "Released under the AGPLv3.", "mpl-2.0": "Available under the MPL 2.0."}
    df = spark.createDataFrame([(i, f"w1 w2.\n{t}") for i, t in enumerate(told.values())], "doc_id long, text string")
    got = {r.doc_id: (r.family, r.paragraph) for r in ls.scan(df, scanner[1]).collect() if r.confirmed}
    assert got == {i: (f, 1) for i, f in enumerate(told)}


def test_wordings_that_no_template_has(spark, scanner):
    told = {
        "Subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
        "SPDX-License-Identifier: MIT": "mit",
        "GNU GPLv3": "gpl-3.0",
        "Published under the Creative Commons Attribution 4.0 International licence": "cc-by-4.0",
        "Licensed under the European Union Public License": "unknown",
        "Licensed under the Open Software License 3.0": "unknown",
        "Licensed under the Eclipse Public License 2.0.": "unknown",
    }
    df = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    got = {r.doc_id: r.family for r in ls.scan(df, scanner[1]).collect()}
    assert {t: got.get(i) for i, t in enumerate(told)} == told


def test_wrapped_notices(spark, scanner):
    mit = "w5 w6 w7\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nw8 w9"
    narrow = "w5\n" + "\n".join("Redistribution and use in source and binary forms, with or without modification, are permitted".split())
    cut = "Permission is hereby granted, free of charge, to any person\n\nobtaining a copy of this software and associated documentation files"
    df = spark.createDataFrame([(1, mit), (2, narrow), (3, cut), (4, "w1 w2 w3.\nReleased under the MIT License.\nw4")], "doc_id long, text string")
    got = [(r.doc_id, r.family) for r in ls.scan(df, scanner[1]).collect() if r.confirmed]
    assert sorted(got) == [(1, "mit"), (2, "bsd"), (4, "mit")]


def brute(rows, s):
    """The scan in plain Python, from the model's numbers."""
    words = lambda t: [w for w in re.split(r"[^\w.]+|_+|\.(?=\D|$)", t.lower()) if w]
    grams = lambda w: {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    at = {t: i for i, t in enumerate(s.vocabulary.vocabulary)}
    weights, bias = s.classes.coefficientMatrix.toArray(), s.classes.interceptVector.toArray()
    slope, base = s.calibration.coefficients[0], s.calibration.intercept
    out = []
    for doc, text in rows:
        for k, body in enumerate(re.split(r"\n[ \t]*\n\s*|(?<=[.!?])[ \t]*\n", text or "")):
            mine = grams(words(body))
            z = bias + weights[:, [at[g] for g in mine if g in at]].sum(axis=1)
            p = np.exp(z - z.max())
            p /= p.sum()
            chance = 1 / (1 + math.exp(-(math.log((1 - p[0] + 1e-12) / (p[0] + 1e-12)) * slope + base)))
            if chance < ls.CERTAIN or not body.strip():
                continue
            guess = s.labels[1 + int(p[1:].argmax())]
            like = []
            for i, (f, t) in enumerate(ls.TEMPLATES):
                w = words(t)
                pairs = {" ".join(w[j : j + 2]) for j in range(len(w) - 1)}
                if f == guess:
                    like.append((len(pairs & mine) / len(pairs), -i))
            best = max(like, default=(0.0, None))
            sure = best[0] >= ls.SIMILAR
            out.append((doc, k, guess if sure or p[1:].max() / (1 - p[0] + 1e-12) >= ls.CLEAR else "unknown", round(chance, 6), None if best[1] is None else -best[1], round(best[0], 6), sure))
    return out


def test_scan_against_brute_force(spark, scanner):
    rng = random.Random(9)
    said = [t for _, t in ls.TEMPLATES] + list(ls.OTHERS) + list(ls.CONTRARY)
    rows = []
    for i in range(160):
        parts = [rng.choice(said) for _ in range(rng.randint(1, 3))] + ["w1 the of " * rng.randint(1, 5)]
        parts = [" ".join(w for w in p.split() if rng.random() > 0.15) for p in parts]
        rng.shuffle(parts)
        rows.append((i, rng.choice(["\n", "\n\n", " ", ". \n"]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.paragraph, r.family, round(r.probability, 6), r.template, round(r.similarity, 6), r.confirmed) for r in ls.scan(df, scanner[1]).collect()]
    assert len(got) > 50 and len({r[2] for r in got}) > 8
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, scanner[1])))


def test_samples_are_whole_or_bounded(spark):
    df = spark.range(5000).withColumn("text", ls.F.col("id").cast("string"))
    assert ls.bounded(df, 6000, "id").count() == 5000 and ls.bounded(df, 300, "id").count() == 300
    assert ls.bounded(df, 300, "id").collect() == ls.bounded(df.repartition(7), 300, "id").collect()


def test_paragraphs_passed_over_are_uncertain(spark, scanner):
    class Open(ls.Scanner):
        def reachable(self, tokens):
            return ls.F.lit(True)

    docs, s = scanner
    odd = docs.limit(40).unionByName(spark.createDataFrame([(900 + i, t[: 3 * len(t) // 4] + "\n" + t.upper()) for i, (_, t) in enumerate(ls.TEMPLATES)], docs.schema))
    every = Open(s.labels, s.vocabulary, s.classes, s.calibration, s.templates)
    assert sorted(map(str, ls.scan(odd, s).collect())) == sorted(map(str, ls.scan(odd, every).collect()))


def test_every_licence_of_a_paragraph(spark, scanner):
    lines = {
        "Licensed under the MIT License or the Apache License, Version 2.0, at your option.": {"mit", "apache-2.0"},
        "Available under the BSD 3-Clause License and the Mozilla Public License 2.0.": {"bsd", "mpl-2.0"},
        "This file is licensed under the GNU Lesser General Public License v3.": {"lgpl"},
        "License: MIT": {"mit"},
    }
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.families for r in ls.scan(df, scanner[1]).collect()}
    assert [set(got[n]) for n in range(len(lines))] == list(lines.values())
    assert all(len(f) == len(set(f)) for f in got.values())
