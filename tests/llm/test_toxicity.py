import itertools
import random

import numpy as np
import pyarrow as pa

from matchloom.llm import toxicity as tx


def corpus(seed, n=900):
    """Toxic where an insult meets a group; each alone is harmless."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices([f"w{chr(97 + k)}" for k in range(20)], k=12) + ["Vermin"] * insult + ["GROUP,"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_learns_the_pair_held_out(spark):
    df = spark.createDataFrame(corpus(1), "doc_id long, text string, toxic int")
    machine = tx.train(df, df.where("doc_id % 5 <> 0"))
    held = {r.doc_id: r.score for r in tx.score(df.where("doc_id % 5 = 0"), machine).collect()}
    right = [(held[i] >= 0.5) == bool(t) for i, _, t in corpus(1) if i in held]
    assert np.mean(right) > 0.95
    bad, good = ([held[i] for i, _, t in corpus(1) if i in held and t == kind] for kind in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert auc > 0.97


def test_margin_is_every_pair():
    rng = np.random.default_rng(0)
    feature = np.full(tx.BUCKETS, -1, np.int32)
    feature[: tx.BUCKETS : 2] = rng.integers(0, 50, tx.BUCKETS // 2)
    m = tx.Machine(feature, 0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    texts = ["a b c d e f g", "", None, "a a a", " ".join(map(chr, range(97, 123)))]
    for z, text in zip(m.margin(pa.array(texts)), texts, strict=True):
        h = tx.word_hashes(pa.array([text]), tx.NOT_LETTER)[0]
        on = sorted({int(feature[int(x) % tx.BUCKETS]) for x in h} - {-1})
        assert np.isclose(z, 0.3 + sum(m.weight[i] for i in on) + sum(m.factor[i] @ m.factor[j] for i, j in itertools.combinations(on, 2)))


def test_edges(spark):
    df = spark.createDataFrame([*corpus(2, 300), (None, None, 1), (1, "", None)], "doc_id long, text string, toxic int")
    machine = tx.train(df, df)
    got = tx.score(df.withColumn("score", df.doc_id), machine).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got)
    for some in (df.limit(0), df.where("toxic = 0")):
        plain = tx.train(df, some)
        assert len({r.score for r in tx.score(df, plain).collect()}) == 1
    assert tx.score(df.limit(0), machine).collect() == []
    assert 0 < tx.keep_clean(df, df.where("doc_id is not null")).count() < 302


def test_repeated_rows_and_long_texts(spark):
    machine = tx.train(*2 * [spark.createDataFrame(corpus(3, 400), "doc_id long, text string, toxic int")])
    long = "wa wb " * 700_000  # several pieces
    df = spark.createDataFrame([(1, "vermin group wa"), (1, "vermin group wa"), (2, long + "vermin group"), (3, "wb wa vermin group")], "doc_id long, text string")
    got = [(r.doc_id, r.score) for r in tx.score(df, machine).collect()]
    assert got[0] == got[1] and np.isclose(got[2][1], got[3][1])


def auc(z, y):
    order = np.argsort(z, kind="stable")
    rank = np.empty(len(z))
    rank[order] = np.arange(1, len(z) + 1)
    return (rank[y > 0].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def pairs(rule, n, seed):
    """Two terms in half of the texts each, other terms beside them; the rule's label."""
    rng = np.random.default_rng(seed)
    a, b = rng.random((2, n)) < 0.5
    texts = [np.unique([*rng.choice(np.arange(10, 50), 12, replace=False), *[1] * int(x), *[2] * int(y)]) for x, y in zip(a, b, strict=True)]
    return texts, rule(a, b).astype(float)


def margins(machine, texts):
    return machine._margin(np.repeat(np.arange(len(texts)), [len(t) for t in texts]), machine.feature[np.concatenate(texts)], len(texts))


def test_terms_that_tell_nothing_alone_are_learned_as_pairs():
    for rule in (np.not_equal, np.equal, np.logical_and):
        texts, label = pairs(rule, 6000, 1)
        feature = np.full(tx.BUCKETS, -1, np.int32)
        feature[np.unique(np.concatenate(texts))] = np.arange(len(np.unique(np.concatenate(texts))))
        machine = tx._fit(feature, feature[np.concatenate(texts)], np.array([len(t) for t in texts]), label, 0)
        fresh, truth = pairs(rule, 3000, 2)
        assert auc(margins(machine, fresh), truth) > 0.95
        if rule is not np.logical_and:  # additive weights alone are no better than chance
            plain = tx.Machine(machine.feature, machine.bias, machine.weight, machine.factor * 0)
            assert abs(auc(margins(plain, fresh), truth) - 0.5) < 0.1


def test_held_out_rows_of_the_given_tables(spark):
    base = "/root/testdata/sf0.1"
    scored = tx.op7_toxicity(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out and toxic is not null").select("score", "toxic").toPandas()
    assert auc(scored.score.to_numpy(), scored.toxic.to_numpy()) > 0.97
