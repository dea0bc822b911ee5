import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm.packing import pack, pack_documents

PIECES = st.lists(st.tuples(st.integers(0, 12), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2, 3, 4])), max_size=40)


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_first_choice_is_the_tightest_compatible_bin(pieces):
    capacity = 12
    got = pack([p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], capacity)
    bins = {}
    for b, (size, s, c) in zip(got, pieces, strict=True):
        ok = lambda x: x["room"] >= size and (s is None or s not in x["s"]) and (c is None or c not in x["c"])  # noqa: B023, E731
        rooms = [x["room"] for x in bins.values() if ok(x)]
        if b in bins:
            assert ok(bins[b]) and bins[b]["room"] == min(rooms)
        else:
            assert not rooms
            bins[b] = {"room": capacity, "s": set(), "c": set()}
        bins[b]["room"] -= size
        bins[b]["s"].add(s)
        bins[b]["c"].add(c)


def check(rows, got, capacity):
    bins, spans = defaultdict(list), defaultdict(int)
    for r in got:
        bins[r.bin_group, r.bin].append(r)
        spans[r.doc_id] += r.n_tokens
    text = {d: t for d, t, _ in rows}
    for members in bins.values():
        assert sum(r.n_tokens for r in members) <= capacity
        sources = [r.source for r in members if r.source is not None]
        assert len(set(sources)) == len(sources)
        assert len({text[r.doc_id] or "" for r in members}) == len(members)
    assert spans == {d: len((t or "").split()) for d, t, _ in rows}


def test_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 70, 99, 250])) + f" {i % 90}", "hot" if i % 3 == 0 else rng.choice([None, "a", "b", "c", "d"])) for i in range(400)]
    rows += [(1000, None, None), (1001, "x " * 12345, "hot"), (1002, "same", None), (1003, "same", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, bin int").repartition(5)
    got = pack_documents(df, capacity=100, group_rows=150).collect()
    check(rows, got, 100)
    assert len({r.bin_group for r in got}) > 2
    again = pack_documents(df.repartition(2), capacity=100, group_rows=150).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert pack_documents(df.limit(0)).collect() == []
    twice = pack_documents(df.unionByName(df).withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id"))), capacity=100)
    assert twice.count() == 2 * len(got)


def test_ids_come_back_as_they_are(spark):
    ids = [9007199254740993, None, 9007199254740995]
    df = spark.createDataFrame([(i, "a b c", "s") for i in ids], "doc_id long, text string, source string")
    got = pack_documents(df).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i in ids)
    assert len({r.bin for r in got}) == 3  # one source, equal texts
    named = pack_documents(df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))).collect()
    assert sorted(r.doc_id or "" for r in named) == ["", "d9007199254740993", "d9007199254740995"]
