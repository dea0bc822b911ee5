import math

import numpy as np

from matchloom.llm.topk_search import Best, search_block, top_k


def brute(rows, queries, k):
    ok = [(i, [int(float(x)) * 256 if abs(float(x)) > 2**53 else math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in queries:
        mine = next((v for i, v in ok if i == q), None)
        if mine is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(mine))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(400, None), (401, []), (402, [None] * 24), (403, [float("nan")] * 24), (404, [float("inf")] * 24), (405, [0.5] * 3), (410, [0.25] * 3), (None, [1.0] * 24)]
    rows += [(5, rows[5][1])]  # a repeated row
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    queries = [i for i in range(0, 411, 10)]
    for sizes in ({}, {"query_rows": 7, "candidate_rows": 11, "blocks_a_task": 2}):
        got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 10 = 0"), 5, **sizes).collect())
        assert got == brute(rows, queries, 5)
    assert top_k(df.limit(0), df, 5).collect() == []
    assert top_k(df, df.limit(0), 5).collect() == []


def test_equal_vectors_of_large_norm():
    rng = np.random.default_rng(1)
    for trial in range(60):
        scale = (2e6, 5e7)[trial % 2]  # norms' products of about 3e14 and 2e17
        query = np.floor(rng.normal(size=(1, 32)) * scale)
        ids = rng.permutation(np.arange(1, 61))
        columns = np.repeat(query.T, 60, axis=1)
        columns[:, 40:] = np.floor(rng.normal(size=(32, 20)) * scale)
        best = Best(1, 5)
        for part in (slice(0, 30), slice(30, 60)):
            search_block(best, np.array([0]), query, ids[part], np.ascontiguousarray(columns[:, part]))
        assert best.ids[0].tolist() == sorted(ids[:40].tolist())[:5]
        assert set(best.scores[0].tolist()) == {sum(int(x) ** 2 for x in query[0])}


def test_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=24) * 2.0 ** rng.integers(0, 20)]) for i in range(120)]
    rows += [(200, [1e30] * 24), (210, [-1e30] * 24), (211, [3e7] * 24), (212, [1.7e308] * 24), (213, [-1.7e308, 5e-324] * 12), (214, [1e30] * 24), (220, [3e7] * 8), (221, [0.1] * 8), (230, [0.2] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = [(q, r, i, s if -(2**63) <= s < 2**63 else None) for q, r, i, s in brute(rows, range(0, 231, 10), 5)]
    assert any(w[3] is None for w in want)
    assert sorted(tuple(r) for r in top_k(df, df.where("vec_id % 10 = 0"), 5).collect()) == want


def test_vectors_of_large_norm_are_found(spark):
    df = spark.createDataFrame([(0, [3e7] * 8), (1, [0.1] * 8), (2, [0.2] * 8)], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in top_k(df, df.where("vec_id = 1"), 5).collect()]
    assert got == [(1, 1, 0, 8 * math.floor(256 * float(np.float32(3e7))) * 25), (1, 2, 2, 8 * 51 * 25)]
