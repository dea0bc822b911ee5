import random

import numpy as np
import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from matchloom.llm import jaccard_join as jj
from matchloom.llm import words


def sets_of(text, n=5):
    ws = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, count):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "the", "a"]
    lines = [" ".join(rng.choices(vocab, k=rng.randint(3, 15))) for _ in range(6)]
    texts = []
    for _ in range(count):
        kind = rng.random()
        if texts and kind < 0.5:
            ws = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            texts.append(" ".join(ws[: len(ws) - rng.choice([0, 0, 3])] or ["x"]))
        else:
            texts.append("\n".join(rng.choice([" ".join(rng.choices(vocab, k=rng.randint(1, 60))), *lines]) for _ in range(rng.randint(1, 4))))
    return texts


def test_words_and_pieces(monkeypatch):
    texts = ["", "A b\tC", None, "one", " lead and trail \n", "x" * 100 + " é ü" * 40, "end"]
    whole = words.word_hashes(pa.array(texts))
    assert [int(b - a) for a, b in zip(whole[1][:-1], whole[1][1:])] == [len((t or "").split()) for t in texts]
    monkeypatch.setattr(words, "PIECE", 16)
    cut = words.word_hashes(pa.array(texts))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    one = words.word_hashes(pa.array(["b c one"]))[0]
    assert one[0] == whole[0][1] and one[1] == whole[0][2] and one[2] == whole[0][3]
    assert len(set(words.word_hashes(pa.array([" ".join(f"{i:x}" for i in range(20000))]))[0].tolist())) == 20000


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jj, "FRAGMENT", 2000)
    texts = corpus(3, 220)
    texts += ["", "   ", None, "solo", "SOLO", "two words", "a b c d", "A B c D", "a b c d e"] + [texts[0]] * 5 + [" ".join(f"v{i}" for i in range(9000))] * 2
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, -1) for r in rows], "doc_id long, text string, component_id int").repartition(5)
    got = sorted(tuple(r) for r in jj.jaccard_join(df).collect())
    assert got == brute(rows)
    monkeypatch.setattr(jj, "SENT_IDS", 0)
    assert sorted(tuple(r) for r in jj.jaccard_join(df).collect()) == got


def test_large_group_of_near_copies_makes_few_pairs(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(400) for k in [i % 120]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, links, _ = jj.jaccard_classes(df)
    assert links.count() < 3 * len(rows)
    assert {r.component_id for r in jj.jaccard_join(df).collect()} == {0}


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_join(df).collect() == []
    some = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, jj.jaccard_join(some).collect()), key=str) == sorted([(None, 1, 4), (4, 1, 4), (3, 0, 3)], key=str)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=12).map(" ".join), max_size=50))
def test_small_tables_against_brute_force(spark, texts):
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_unlike_short_texts(spark):
    rows = [(1, "alpha"), (2, "beta"), (3, "gamma")]
    got = jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]


def test_links_through_a_row_without_id(spark):
    first = [f"w{i}" for i in range(60)]
    middle = first[:10] + ["x"] + first[11:]
    last = middle[:40] + ["y"] + middle[41:]
    rows = [(5, " ".join(first)), (None, " ".join(middle)), (7, " ".join(last))]
    assert [c for _, _, c in brute([(5, rows[0][1]), (7, rows[2][1])])] == [5, 7]
    got = {r.doc_id: r.component_id for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, None: 5, 7: 5}


def test_keep_one_goes_by_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "p"), (2, base + " x", "q"), (2, "quite another text of some words here", "r"), (None, base, "s"), (None, "alone in this table of six words", "t"), (4, None, "u"), (1, base, "v"), (4, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(1, base), (2, rows[2][1]), (0, rows[4][1]), (4, ""), (4, "")])


def test_unlinked_texts_of_one_passage_make_few_pairs(spark):
    passage = [f"p{i}" for i in range(80)]
    rng = random.Random(2)
    rows = [(i, " ".join(passage + [f"u{rng.random()}" for _ in range(20)])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jj._ordered(jj._sets(docs, 5, "text"))
    assert sets.count() == 600 and jj.jaccard_classes(docs)[2] == 0
    none = spark.createDataFrame([], "node binary, root binary")
    assert jj._prefix_pairs(sets, none).count() == 0
    assert len({r.component_id for r in jj.jaccard_join(docs).collect()}) == 600


def test_common_shingles_are_one_entry_a_batch():
    common = np.arange(10, dtype=np.uint64) << np.uint64(58)
    sets = {i: np.unique(np.concatenate([common[:8], np.array([i * 977 + 13], np.uint64) << np.uint64(40)])) for i in range(100)}
    rows = list(jj._fragments(sets, 4))
    assert sum(len(r["common"]) for r in rows) <= jj.WIDTH * 9 and sum(len(r["grams"]) for r in rows) <= jj.WIDTH * 100
    shared: dict[int, int] = {}
    for f in {r["f"] for r in rows}:
        table = pa.Table.from_pylist([r for r in rows if r["f"] == f], schema=jj._SEGMENT_ARROW)
        for key, n in zip(*jj._shared_in_fragment(table), strict=True):
            shared[int(key)] = shared.get(int(key), 0) + int(n)
    count = {}
    for g in sets.values():
        for x in g.tolist():
            count[x] = count.get(x, 0) + 1
    assert shared == {k: sum(count[x] > 1 for x in g.tolist()) for k, g in sets.items()}
