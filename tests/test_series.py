"""Long keys, cut into ranges, against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom import session
from matchloom.operators import series as sr
from matchloom.operators import state as st

CUT = {"long": 60, "rows": 17}


@pytest.fixture(scope="module")
def df(spark):
    """One key has half of the rows, one is null; order and values have ties and nulls."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(200), n, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(5)]), rng.random() < 0.3, rng.choice(["start", "stop", "x", "y", "z"])) for n in range(500)]
    return spark.createDataFrame(rows, "entity_id long, ts_ms long, seq long, item_id string, v int, motion boolean, marker string").withColumns({"value": F.col("v").cast("double"), "confidence": F.col("v") / 5, "item": F.col("item_id")}).repartition(3)


STEPS = {
    "rolling_mean": lambda d, **s: st.rolling_mean(d, "value", n=60, **s),
    "rolling_mean_short": lambda d, **s: st.rolling_mean(d, "value", n=3, **s),
    "reading_change": lambda d, **s: st.reading_change(d.drop("motion"), "value", threshold=1, **s),
    "settle_detection": lambda d, **s: st.settle_detection(d, 2, **s),
    "identity_streak": lambda d, **s: st.identity_streak(d, confirm=2, least=0.4, **s),
    "empty_streak": lambda d, **s: st.empty_streak(d, **s),
    "change_only": lambda d, **s: st.change_only(d, ["item_id", "v"], **s),
    "carry_forward": lambda d, **s: st.carry_forward(d, "last", F.when(F.col("item_id") == "a", F.col("v")), **s),
    "refresh_hold": lambda d, **s: st.refresh_hold(d, "value", every=7, **s),
    "timeline": lambda d, **s: st.timeline(d, **s),
    "as_of_join": lambda d, **s: st.as_of_join(d.where("motion"), d.where("not motion"), order=("seq",), **s),
}


def rows(out):
    return sorted((tuple(r) for r in out.select(*sorted(out.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", STEPS)
def test_ranges_give_what_windows_give(spark, df, name):
    with session.scratch():
        plain, cut = STEPS[name](df), STEPS[name](df, **CUT)
        assert rows(plain) == rows(cut) and plain.count()
        assert dict(plain.dtypes) == dict(cut.dtypes)
        assert STEPS[name](df.limit(0), **CUT).collect() == []


def test_no_group_of_a_hot_key_is_longer_than_a_range(spark):
    hot = spark.range(30_000).select((F.col("id") % 3 > 0).cast("long").alias("entity_id"), F.col("id").alias("ts_ms"), F.col("id").alias("seq"))
    with session.scratch():
        seen = []

        def steps(s):
            seen.append(s)
            return s.add(n=sr.number())

        out = sr.along(hot, steps, long=15_000, rows=1_000)
        at = Window.partitionBy("entity_id").orderBy("ts_ms")
        assert rows(out) == rows(hot.withColumn("n", F.row_number().over(at)))
        ranged = next(s for s in seen if isinstance(s, sr.Ranged))
        largest = ranged.df.groupBy("entity_id", "__range").count().agg(F.max("count"), F.count("*")).first()
        assert largest[0] <= 2_000 and largest[1] >= 15


def test_as_of_join_by_hand(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 0, "b"), (2, 9, "c"), (None, 9, "d"), (1, None, "e"), (1, 5, "a")], "entity_id long, ts_ms long, match string")
    right = spark.createDataFrame([(1, 1, 1), (1, 5, 2), (1, 5, 1), (1, 6, 3), (None, 3, 4), (1, None, 5)], "entity_id long, ts_ms long, seq long")
    got = sorted((r[2], r[3] and r[3].seq) for r in st.as_of_join(left, right, order=("seq",)).collect())
    assert got == [("a", 2), ("a", 2), ("b", None), ("c", None), ("d", 4), ("e", None)]
