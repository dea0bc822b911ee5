import random

import pytest
from pyspark.sql import functions as F

from matchloom import session
from matchloom.operators import selection
from matchloom.operators.selection import percentiles


@pytest.mark.parametrize(("bins", "few"), [(2, 100), (1024, 0), (16, 10**6)])
def test_against_the_built_in_percentile(spark, monkeypatch, bins, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(3), rng.choice([rng.gauss(0, 1), rng.randrange(5) * 1.0, 1e300 * rng.random(), -1e-300, None])) for _ in range(700)] + [("one", 0, 4.5), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, h int, lo double").repartition(3)
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    with session.scratch():
        for by in ((), ("g", "h")):
            got = {tuple(r[c] for c in by): [r[c] for c in shares] for r in percentiles(df, by, "lo", shares, bins=bins).collect()}
            want = {tuple(r[c] for c in by): [r[c] for c in shares] for r in df.where("lo is not null").groupBy(*by).agg(*(F.percentile("lo", p).alias(n) for n, p in shares.items())).collect()}
            assert got.keys() == want.keys()
            for k in got:
                assert got[k] == pytest.approx(want[k], rel=1e-12)
        assert percentiles(df.limit(0), ("g",), "lo", shares).collect() == []


@pytest.mark.parametrize("few", [0, 100])
def test_infinite_values_and_nan(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (-inf, -1.0, 0.0, 2.0, inf, float("nan"))], "v double")
    with session.scratch():
        got = percentiles(df, (), "v", {"a": 0.0, "b": 0.2, "c": 0.4, "d": 0.6, "e": 1.0}).first()
    assert tuple(got) == (-inf, -1.0, 0.0, 2.0, inf)
