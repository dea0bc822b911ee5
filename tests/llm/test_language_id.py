import math
import random

import numpy as np
import pyarrow as pa

from matchloom.llm import language_id as li


def texts(seed, n=160):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "ti", "mo", "re"], "bb": ["schu", "ölt", "ganz", "ei"], "cc": ["que", "ción", "lla", "os"]}
    out = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        out.append((lang, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))).capitalize() for _ in range(rng.randint(5, 40)))))
    return out


def slow_log_scores(model, text):
    """The method, one word and one character at a time."""
    total = np.zeros(len(model.langs))
    for word in "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in text.lower()).split():
        row = model.words.find(li._hashes(pa.array([word])))[0]
        if row >= 0:
            total += model.words.scores[row]
            continue
        padded, scores = f" {word} ", []
        for i in range(len(padded)):
            score = np.zeros(len(model.langs))
            for n in range(li.LONGEST, 0, -1):
                if i + n <= len(padded) and (r := model.grams[n - 1].find(li._hashes(pa.array([padded[i : i + n]])))[0]) >= 0:
                    score = model.grams[n - 1].scores[r]
                    break
            scores.append(score)
        total += np.mean(scores, axis=0)
    return total


def test_accuracy_and_brute_force(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts(1))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(df.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in li.identify(df, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i % 4 == 2]) > 0.95
    strange = ["unseenwörd ktmo xyz", "schuqueka", rows[0][1], "日本語 текст"]
    sums, count = model.log_scores(pa.array(strange))
    for s, text in zip(sums, strange, strict=True):
        assert np.allclose(s, slow_log_scores(model, text))
    assert count.tolist() == [len(t.split()) for t in strange]


def test_edges(spark):
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts(2, 60))], "doc_id long, text string, lang string")
    model = li.train(df)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 -- !", "x"), (4, "KATI MORE", "x"), (4, "KATI MORE", "x"), (None, "schu " * 200_000, "x")], "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in li.identify(odd, model).collect()]
    assert [g[:2] for g in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "aa"), (None, "bb")]
    assert all(0 <= s <= 1 and not math.isnan(s) for *_, s in got)
    empty = df.limit(0)
    assert li.identify(empty, model).collect() == []
    assert {r.lang_pred for r in li.identify(df, li.train(empty)).collect()} == {"und"}
    assert li.keep_identified(df.unionByName(odd.selectExpr("doc_id", "text", "cast(null as string) as lang"))).count() == 63
