import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom import session
from matchloom.operators import nearest
from matchloom.operators.nearest import Index


def lumps(n, codes, seed=0, lumps=200):
    """Rows that lie around some middles, as descriptors of repeated views do."""
    rng = np.random.default_rng(seed)
    own = rng.integers(0, lumps, n)
    if not codes:
        middles = rng.normal(size=(lumps, 16)) * 4
        return [(i, [float(x) for x in middles[own[i]] + rng.normal(size=16)]) for i in range(n)]
    middles = rng.integers(-(2**63), 2**63 - 1, lumps)
    flip = (rng.random((n, 64)) < 0.08).astype(np.uint8)
    turned = middles[own] ^ np.packbits(flip, axis=1).view(">i8").ravel().astype(np.int64)
    return [(i, int(x)) for i, x in enumerate(turned)]


def distances(rows, codes):
    if codes:
        v = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        return np.bitwise_count(v[:, None] ^ v[None, :]).astype(float)
    v = np.array([r[1] for r in rows])
    return np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))


@pytest.mark.parametrize("codes", [False, True])
def test_recall_with_under_a_tenth_of_all_pairs(spark, codes):
    rows = lumps(3000, codes)
    df = spark.createDataFrame(rows, f"item_id long, vec {'long' if codes else 'array<double>'}").repartition(4)
    with session.scratch():
        path = session.folder(spark, "index")
        Index.build(df, path)
        index = Index(spark, path)  # opened anew
        asked = df.where("item_id % 20 = 0")
        probes = index.probes_for(0.95, 5, others=True)
        got = {}
        for r in index.search(asked, 5, probes=probes, others=True).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.item_id))
        away = distances(rows, codes)
        np.fill_diagonal(away, np.inf)
        hits = sum(d <= np.sort(away[q])[4] + 1e-9 for q in got for _, d, _ in got[q])
        assert len(got) == 150 and hits >= 0.9 * 5 * 150
        for q in got:
            assert all(abs(away[q][i] - d) < 1e-9 for _, d, i in got[q])
        sizes = {r["cell"]: r["n"] for r in spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.sum(F.size("items")).alias("n")).collect()}
        assert sum(sizes.values()) == 3000
        compared = probes * 150 * max(np.mean(list(sizes.values())), 1)
        assert compared < 0.1 * 150 * 3000
        # All cells are an exact search, ties by item.
        exact = {(r.query_id, r["rank"]): r.item_id for r in index.search(asked, 5, probes=10**6, others=True).collect()}
        for q in (0, 20, 400):
            assert [exact[q, k] for k in range(1, 6)] == np.lexsort((np.arange(3000), away[q].round(9) if codes else away[q]))[:5].tolist()


def test_one_value_of_a_third_of_all_rows_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 50)
    rows = lumps(600, True) + [(1000 + i, 12345) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id long, vec long").repartition(4)
    with session.scratch():
        index = Index.build(df, session.folder(spark, "index"), cells=20)
        blocks = spark.read.parquet(f"{index.path}/cells").select("cell", F.size("items").alias("n"))
        assert blocks.agg(F.sum("n")).first()[0] == 900
        assert blocks.groupBy("cell").count().agg(F.max("count")).first()[0] >= 6
        near = index.search(df.where("item_id = 1000"), 4, probes=3, others=True).orderBy("rank").collect()
        assert [(r.item_id, r.distance) for r in near] == [(1001 + k, 0.0) for k in range(4)]


def test_odd_rows(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [0.0, 1.0]), (6, [0.0, 1.0]), (6, [0.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "item_id long, vec array<double>").coalesce(1)
    with session.scratch():
        index = Index.build(df, session.folder(spark, "index"))
        got = index.search(df, 10, probes=99, others=True).collect()
        assert sorted((r.query_id or 0, r.item_id or 0) for r in got if r.query_id) == [(1, 0), (1, 6), (1, 6), (6, 0), (6, 0), (6, 1), (6, 1)]
        empty = Index.build(df.limit(0), session.folder(spark, "index"))
        assert empty.search(df, 3, probes=2).collect() == [] == index.search(df.limit(0), 3, probes=2).collect()


def test_the_kth_distance_of_codes():
    """By bounds and counts as by order, with ties and own rows (255), in whole numbers that take an eighth of the memory."""
    rng = np.random.default_rng(2)
    for width, k in ((4096, 10), (500, 5), (161, 10), (40, 10), (12, 10)):
        d = rng.binomial(64, 0.5, (70, width)).astype(np.uint8)
        d[3], d[5, : width - 4] = 7, 255
        assert (nearest._kth(d, k) == np.sort(d, axis=1)[:, k - 1]).all()
