import random

import corpus_pipeline
from tests.llm import test_decontaminate as td
from tests.llm import test_jaccard_join as tj


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = {"aa": ["kamo", "tire", "moka", "reti"], "bb": ["schu", "ganzei", "öltei", "eischu"]}
    rows = []
    for i in range(120):
        lang = ("aa", "bb")[i % 2]
        text = rng.choices([w + v for w in words[lang] for v in words[lang]], k=30) + ["vermin"] * (i % 5 == 0)
        rows.append((i, " ".join(text), lang, f"s{i % 3}"))
    item = " ".join(f"q{j}" for j in range(20))
    rows += [(200 + i, rows[i][1] if i % 2 else rows[i][1] + " kamokamo", "aa", "s0") for i in range(1, 40, 3)]
    rows += [(300, "12 34 --", "aa", "s1"), (301, rows[3][1] + " " + item, "bb", "s1"), (302, None, None, None), (303, rows[0][1], "aa", "s9")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1, int("vermin" in r[1])) for r in rows[:120]], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    kept, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, kept, str(tmp_path)).cache()
        at[name] = kept.collect()
        if name != "packing":
            assert kept.columns == before.columns
    ids = lambda name: {r.doc_id for r in at[name]}
    texts = {r[0]: r[1] for r in rows}
    assert ids("language_id") == set(texts) - {300, 302}
    clean = {i for i in ids("language_id") if "vermin" not in texts[i]}
    assert ids("toxicity") <= clean and len(clean - ids("toxicity")) <= 4  # a model learned from 120 labels
    mine = [(i, texts[i]) for i in ids("toxicity")]
    assert ids("jaccard_join") == {d for d, _, c in tj.brute(mine) if d == c}
    dirty = {d for d, *_ in td.brute([(i, texts[i]) for i in ids("jaccard_join")], [(1, item)])}
    assert dirty == {301} and ids("decontamination") == ids("jaccard_join") - dirty
    assert ids("packing") == ids("decontamination")
    assert {(r.doc_id, r.bin_group, r.bin) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r.doc_id, r.bin_group, r.bin) for r in at["packing"]}


def test_stages_take_odd_rows_and_names(spark, tmp_path):
    names = ["doc", "verdict", "score", "row", "key", "item", "print", "no", "id"]
    rows = [(i, f"word{i % 3} kamo tire moka {i}", "aa", None, 1) for i in range(20)] + [(None, None, None, None, None), (3, "", "bb", "s", 0), (None, "schu ganzei", "bb", "s", 2), (None, "schu ganzei", "bb", "s", 2)]
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            got = out.collect()
            if name != "packing":
                assert out.columns == docs.columns and all(r.verdict == "x" for r in got)
            if given is docs:
                assert len(got) == {"language_id": 22, "jaccard_join": 23}.get(name, 24)
