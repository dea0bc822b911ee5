from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import sharding
from matchloom.llm.sharding import communication_matrix, exact_sizes, shard_rows


def test_matrix_sums():
    counts = {0: 7, 3: 0, 4: 50, 9: 13}
    sizes = exact_sizes(70, 8)
    matrix = communication_matrix(counts, sizes, 1)
    assert {k: int(v.sum()) for k, v in matrix.items()} == counts
    assert (sum(matrix.values()) == sizes).all() and sizes.max() - sizes.min() <= 1


def test_matrix_law():
    draws = [communication_matrix({0: 4, 1: 4}, np.array([4, 4]), s)[0][0] for s in range(4000)]
    expected = {0: 1 / 70, 1: 16 / 70, 2: 36 / 70, 3: 16 / 70, 4: 1 / 70}
    for k, p in expected.items():
        assert abs(draws.count(k) / 4000 - p) < 0.03


def test_shards(spark):
    rows = [(i % 40 if i % 9 else None, "x" * (i % 5), "clash") for i in range(203)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    got = shard_rows(df, 8, rows_per_block=10).collect()
    by = Counter(r.shard for r in got)
    assert len(got) == 203 and max(by.values()) - min(by.values()) <= 1
    for s, n in by.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
    assert shard_rows(df.limit(0), 8).collect() == []
    assert sorted((r.shard, r.slot, str(r.doc_id)) for r in got) == sorted((r.shard, r.slot, str(r.doc_id)) for r in shard_rows(df, 8, rows_per_block=10).collect())


@pytest.mark.parametrize("large", [1, 10])
def test_large_populations_have_the_same_law(monkeypatch, large):
    monkeypatch.setattr(sharding, "LARGE", large)
    draws = [communication_matrix({0: 4, 1: 3, 2: 1}, np.array([4, 4]), s) for s in range(3000)]
    expected = {0: 1 / 70, 1: 16 / 70, 2: 36 / 70, 3: 16 / 70, 4: 1 / 70}
    for k, p in expected.items():
        assert abs(sum(d[0][0] == k for d in draws) / 3000 - p) < 0.03
    assert abs(sum(d[2][0] for d in draws) / 3000 - 0.5) < 0.04
    assert all((sum(d.values()) == [4, 4]).all() for d in draws)


def test_ten_billion_rows():
    counts = {p: 10**8 + p for p in range(100)}
    sizes = exact_sizes(sum(counts.values()), 8)
    matrix = communication_matrix(counts, sizes, 5)
    assert {p: int(r.sum()) for p, r in matrix.items()} == counts and (sum(matrix.values()) == sizes).all()
    far = np.array([(r - counts[p] / 8) / np.sqrt(counts[p] * 7 / 64) for p, r in matrix.items()])
    assert 0.85 < far.std() < 1.15 and abs(far).max() < 5


def test_shards_against_a_plain_replay(spark):
    rows = [(i, "x" * (i % 5)) for i in range(157)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = sharding.reliable(df)
    held = {}
    for r in parts.withColumn("p", F.spark_partition_id()).collect():
        held.setdefault(r.p, []).append((r.doc_id, r.text))
    for block_rows, blocks in ((200_000, 1), (5, 4)):
        matrix = communication_matrix({p: len(v) for p, v in held.items()}, exact_sizes(157, 8), 3)
        sent = []
        for p, mine in held.items():
            rng = np.random.default_rng([3, p])
            to = np.repeat(np.arange(8, dtype=np.int32), matrix[p])
            rng.shuffle(to)
            block, key = rng.integers(0, blocks, len(mine), dtype=np.int32), rng.integers(-(2**63), 2**63 - 1, len(mine), dtype=np.int64)
            sent += [(int(s), int(b), int(k), *row) for s, b, k, row in zip(to, block, key, mine, strict=True)]
        want, place = set(), Counter()
        for s, _, _, doc, text in sorted(sent):
            want.add((doc, text, s, place[s]))
            place[s] += 1
        assert {tuple(r) for r in shard_rows(parts, 8, seed=3, rows_per_block=block_rows).collect()} == want
