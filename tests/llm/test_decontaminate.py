import itertools
import random
import re

from matchloom.llm import decontaminate as dc


def toks(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = toks(t)
        for i, b in items:
            v = toks(b)
            if len(v) < dc.SHORTEST:
                continue
            best = 0
            for s in range(-len(v), len(w)):
                same = [int(0 <= s + j < len(w) and w[s + j] == v[j]) for j in range(len(v))]
                if (any(sum(same[a : a + 13]) >= 11 for a in range(len(v) - 12)) if len(v) >= 13 else sum(same) >= len(v) - (len(v) >= dc.LENIENT)):
                    best = max(best, sum(same))
            if best:
                out.add((d, i, best))
    return out


def test_masks_are_lossless():
    for miss in itertools.combinations(range(dc.WINDOW), dc.MISSES):
        assert any(all(o + p not in miss for p, c in enumerate(m) if c == "1") for m in dc.MASKS for o in range(dc.WINDOW - len(m) + 1))


def test_short_mask_is_lossless():
    for n in range(dc.SHORTEST, dc.WINDOW):
        for miss in [(), *(((i,) for i in range(n)) if n >= dc.LENIENT else ())]:
            assert any(all(o + p not in miss for p in range(4)) for o in range(n - 3))


def corpus():
    rng = random.Random(5)
    vocab = ["the", "of", "É", "z9"] + [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 4, 6, 7, 9, 12, 13, 14, 30, 50])))) for i in range(25)] + [(99, None), (98, ""), (25, "the " * 20)]
    docs = []
    for d in range(60):
        words = rng.choices(vocab, k=rng.randint(0, 120))
        if d % 2 == 0:
            part = toks(rng.choice(items[:25])[1])
            for _ in range(rng.choice([0, 1, 2, 3])):
                part[rng.randrange(len(part))] = "sub"
            lo = rng.choice([0, 0, 3])
            at = rng.randint(0, len(words))
            words[at:at] = part[lo:]
        docs.append((d, ", ".join(words).upper() if d % 5 == 0 else "\n".join(words)))
    return docs + [(70, None), (71, ""), (72, "the " * 3000), (0, "another text of id 0 " + items[10][1])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs + docs[:3]], "doc_id long, text string, item long")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    for sent in (10**6, 0):
        monkeypatch.setattr(dc, "SENT_SEEDS", sent)
        monkeypatch.setattr(dc, "SENT_HITS", sent)
        got = {(r["__row"].id, r.item, r.matched) for r in dc.leaks(df, bench).collect()}
        assert got == brute(docs, items)
        kept = sorted((r.doc_id, r.text or "") for r in dc.decontaminate(df, bench).collect())
        dirty = [(d, t) for d, t in docs if brute([(d, t)], items)]
        assert kept == sorted((d, t or "") for d, t in docs + docs[:3] if (d, t) not in dirty)


def test_empty_and_null_ids(spark):
    docs, bench = "doc_id long, text string", "item_id long, text string"
    text = "one two three four five six seven eight nine"
    some = spark.createDataFrame([(None, text), (0, "clean")], docs)
    items = spark.createDataFrame([(5, text)], bench)
    assert [(r["__row"].no, r.item, r.matched) for r in dc.leaks(some, items).collect()] == [(True, 5, 9)]
    assert [r.doc_id for r in dc.decontaminate(some, items).collect()] == [0]
    assert dc.leaks(some.limit(0), items).collect() == [] == dc.leaks(some, items.limit(0)).collect()
    assert dc.decontaminate(some, items.limit(0)).count() == 2


def test_items_without_id_count_too(spark):
    text = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, "ten eleven twelve thirteen fourteen fifteen sixteen")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (None, "ten eleven twelve thirteen fourteen fifteen sixteen"), (4, text)], "item_id long, text string")
    assert sorted(((r["__row"].id, r.item or 0, r.matched) for r in dc.leaks(docs, items).collect())) == [(1, 0, 9), (1, 4, 9), (3, 0, 7)]
    assert [r.doc_id for r in dc.decontaminate(docs, items).collect()] == [2]
