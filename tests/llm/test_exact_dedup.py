import hashlib
import random

from pyspark.sql import functions as F

from matchloom import session
from matchloom.llm import exact_dedup
from matchloom.llm.exact_dedup import DigestIndex, digests, mark

DDL = "doc_id long, text string, digest int, row string, keep_id string, batch string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", "k", "b") for i, t in rows], DDL)


def lowest(i):
    return (i is not None, i or 0)


def brute(batches):
    """Over rows of several batches: a list of (id, digest, keep_id, group_size) and how many rows are kept."""
    kept, sizes = {}, {}
    for batch in batches:
        best = {}
        for i, t in batch:
            best[t or ""] = max([i, *([best[t or ""]] if (t or "") in best else [])], key=lowest)
            sizes[t or ""] = sizes.get(t or "", 0) + 1
        for t, i in best.items():
            kept.setdefault(t, i)
    rows = [(i, hashlib.sha256((t or "").encode()).digest(), kept[t or ""], sizes[t or ""]) for batch in batches for i, t in batch]
    return sorted(rows, key=repr), len(kept)


def random_rows(seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "a", "A", "a ", "ä", "x" * 100_000, "x" * 99_999, *map(str, range(20))]
    return [(rng.choice([None, *range(40)]), rng.choice(texts)) for _ in range(120)] + [(7, "hot")] * 60


def test_against_brute_force_over_batches(spark):
    with session.scratch():
        batches = [random_rows(s) for s in range(3)]
        path = session.folder(spark, "index")
        every, groups = None, []
        for n, batch in enumerate(batches):
            index = DigestIndex(spark, path, buckets=3)  # opened anew each time
            rows = digests(table(spark, batch).repartition(4)).withColumn("row", F.col("row") + n * 2**50)
            groups.append(session.stored(index.add(rows, f"b{n}")))
            every = rows if every is None else every.union(rows)
        got = [tuple(r) for r in mark(every, *groups).collect()]
        want, kept = brute(batches)
        assert sorted([(i, bytes(d), k, s) for i, d, k, s, _ in got], key=repr) == want
        assert sum(r[4] for r in got) == kept == index.known().count()
        assert len({bytes(r[1]) for r in got if r[4]}) == kept
        assert all(r[0] == r[2] for r in got if r[4])


def test_a_batch_run_again_gives_the_same(spark):
    with session.scratch():
        index = DigestIndex(spark, session.folder(spark, "index"), buckets=2)
        index.add(digests(table(spark, [(1, "a"), (2, "b")])), "one")
        rows = digests(table(spark, [(3, "b"), (4, "c"), (5, "c")]))
        tries = [sorted((bytes(r.digest), r.keep_id, r.copies, r.fresh) for r in index.add(rows, "two").collect()) for _ in range(2)]
        assert tries[0] == tries[1] and index.known().count() == 3
        assert {r.keep_id: r.batch for r in index.known().collect()} == {1: "one", 2: "one", 5: "two"}
        new = index.rewritten(session.folder(spark, "index"), buckets=5)
        assert (new.buckets, new.known().count()) == (5, 3)
        assert index.add(rows.limit(0), "three").collect() == [] and index.known().count() == 3


def test_the_index_is_not_shuffled(spark):
    with session.scratch():
        index = DigestIndex(spark, session.folder(spark, "index"))
        rows = digests(table(spark, random_rows(1)))
        index.add(rows, "one")
        plan = index.add(rows, "two")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and "SortMergeJoin" in plan


def test_drop_copies_keeps_whole_rows(spark):
    with session.scratch():
        index = DigestIndex(spark, session.folder(spark, "index"), buckets=2)
        first, second = [(1, "a"), (9, "a"), (2, None), (3, ""), (4, "b"), (4, "b")], [(5, "a"), (6, "c"), (None, "c")]
        got = index.drop_copies(table(spark, first), "one")
        assert got.columns == [c.split()[0] for c in DDL.split(", ")]
        assert sorted((r.doc_id, r.text, r.keep_id) for r in got.collect()) == [(3, "", "k"), (4, "b", "k"), (9, "a", "k")]
        assert sorted(r.doc_id for r in index.drop_copies(table(spark, second), "two").collect()) == [6]
        assert index.drop_copies(table(spark, []), "three").collect() == []


def test_query_on_odd_tables(spark):
    with session.scratch():
        for n, rows in enumerate(([], [(None, "a"), (None, "a")], random_rows(5))):
            path = session.folder(spark, f"t{n}")
            table(spark, rows).write.parquet(f"{path}/documents.parquet")
            got = exact_dedup.op13_exact_dedup(spark, path).collect()
            want, kept = brute([rows])
            assert sorted([(r.doc_id, bytes.fromhex(r.text_sha256), r.keep_id, r.group_size) for r in got], key=repr) == want
            assert sum(r.kept for r in got) == kept
