"""Cases of the operators' own semantics, small enough to check by eye."""

import pytest
from pyspark.sql import functions as F

from matchloom.functions import boxes as bx
from matchloom.functions import scalars as sc
from matchloom.functions import scores as so
from matchloom.operators import matching as mt
from matchloom.operators import quality as ql
from matchloom.operators import spatial as sp
from matchloom.operators import state as st
from matchloom.operators import tables as tb
from matchloom.operators.components import connected_components

BOX = "frame_id long, box_id long, x long, y long, w long, h long, score double"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_identity_streak(spark):
    def last(params, readings):
        df = spark.createDataFrame([(1, i, i, n, c) for i, (n, c) in enumerate(readings)], "entity_id int, ts_ms long, seq long, item_id string, confidence double")
        return tuple(st.identity_streak(df, confirm=params[0], least=params[1]).orderBy(F.desc("seq")).select("phase", "state_id", "frames").first())

    star, moon = ("star", 0.91), ("moon", 0.91)
    assert last((3, 0.8), [star] * 3) == ("confirmed", "star", 3)
    assert last((3, 0.8), [star, moon]) == ("candidate", "moon", 1)
    assert last((3, 0.8), [("star", 0.5)]) == ("empty", None, 0)
    assert last((3, 0.8), [star, star, ("star", 0.5), star]) == ("candidate", "star", 1)


def test_settle_fires_once(spark):
    moves = [False, False, True, False, False, False, True, True, False, False]
    df = spark.createDataFrame([(1, i, i, m) for i, m in enumerate(moves)], "entity_id int, ts_ms long, seq long, motion boolean")
    assert [r.seq for r in st.settle_detection(df, 2).where("settled").collect()] == [4, 9]


def test_assignment_and_overlap(spark):
    tracked = spark.createDataFrame([(1, 1, 10, 10, 50, 80, 0.0), (1, 2, 200, 10, 50, 80, 0.0)], BOX)
    near = spark.createDataFrame([(1, 7, 12, 12, 50, 80, 0.0)], BOX)
    assert rows(sp.assign(tracked, near), "a_box_id", "b_box_id") == [(1, 7)]
    far = spark.createDataFrame([(1, 7, 200, 200, 50, 80, 0.0)], BOX)
    assert rows(sp.assign(tracked.where("box_id = 1"), far)) == []
    table = spark.createDataFrame([(1, 1, 100, 100, 80, 120, 0.0), (1, 2, 260, 100, 80, 120, 0.0)], BOX)
    region = spark.createDataFrame([(1, 9, 110, 110, 60, 90, 0.0)], BOX)
    assert rows(sp.iou_join(table, region, 0.10), "a_box_id") == [(1,)]


def brute_nms(boxes, least):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[6], b[1])):
        def iou(a, c):
            w, h = max(0, min(a[2] + a[4], c[2] + c[4]) - max(a[2], c[2])), max(0, min(a[3] + a[5], c[3] + c[5]) - max(a[3], c[3]))
            return w * h / (a[4] * a[5] + c[4] * c[5] - w * h)
        if all(k[0] != b[0] or iou(k, b) < least for k in kept):
            kept.append(b)
    return sorted((b[0], b[1]) for b in kept)


def brute_merge(boxes, pad):
    now = [(b[0], b[2], b[3], b[2] + b[4], b[3] + b[5]) for b in boxes]
    while True:
        for i, a in enumerate(now):
            j = next((j for j, b in enumerate(now) if j > i and a[0] == b[0] and not (a[3] + pad < b[1] or b[3] + pad < a[1] or a[4] + pad < b[2] or b[4] + pad < a[2])), None)
            if j is not None:
                b = now.pop(j)
                now[i] = (a[0], min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]))
                break
        else:
            return sorted((f, x, y, r - x, d - y) for f, x, y, r, d in now)


def test_suppression_and_merge_against_brute_force(spark):
    import random

    rng = random.Random(2)
    boxes = [(f, i, rng.randint(0, 150), rng.randint(0, 150), rng.randint(5, 40), rng.randint(5, 40), rng.randint(0, 5) / 5) for f in range(4) for i in range(18)]
    df = spark.createDataFrame(boxes, BOX)
    assert rows(sp.suppress(df, 0.2, rank=-F.col("score")), "frame_id", "box_id") == brute_nms(boxes, 0.2)
    assert rows(sp.merge(df, 3), "frame_id", "x", "y", "w", "h") == brute_merge(boxes, 3)


@pytest.mark.parametrize("ordered", [10**6, 20, 0])
def test_suppression_by_frames_components_and_rounds(spark, ordered):
    import random

    rng = random.Random(8)
    boxes = [(rng.choice([1, 1, 1, 2]), n, rng.randrange(60), rng.randrange(20), 10, 10, rng.randrange(6) / 5) for n in range(90)]
    df = spark.createDataFrame(boxes, "frame_id long, box_id long, x long, y long, w long, h long, score double").repartition(3)
    assert rows(sp.suppress(df, 0.2, rank=-F.col("score"), ordered=ordered), "frame_id", "box_id") == brute_nms(boxes, 0.2)


def test_a_long_chain_takes_as_many_jobs_as_a_short_one(spark):
    jobs, next_id = [], lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    for n in (100, 10_000):
        chain = spark.range(n).select(F.lit(1).alias("frame_id"), F.col("id").alias("box_id"), (F.col("id") * 5).alias("x"), F.lit(0).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"), (-F.col("id")).alias("score"))
        before = next_id()
        kept = sorted(r.box_id for r in sp.suppress(chain, 0.3, rank=-F.col("score")).collect())
        jobs.append(next_id() - before)
        assert kept == list(range(0, n, 2))
    assert abs(jobs[0] - jobs[1]) <= 6  # adaptive execution may plan a stage more


def test_a_hundred_thousand_prefixes_meet_by_equality(spark):
    from matchloom.operators import tables as tb

    owners = spark.range(100_000).select(F.concat(F.lit("o"), "id").alias("owner"), F.concat(F.lit("p"), "id").alias("prefix"), F.col("id").alias("ordinal"))
    ids = spark.createDataFrame([("p7",), ("p99999x",), ("p123456_z",), ("q_1",), ("Ab_c",), ("none",), ("",), (None,)], "id string")
    out = tb.prefix_join(ids, owners, "other")
    assert {r.id: r.owner for r in out.collect()} == {"p7": "o7", "p99999x": "o9", "p123456_z": "o1", "q_1": "q", "Ab_c": "ab", "none": "other", "": "other", None: "other"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "prefix" not in "".join(line for line in plan.splitlines() if "NestedLoopJoin" in line)  # that join is with the one row of lengths


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(100, 101), (5, 5), (None, 3), (101, 100)], "a long, b long")
    for known in (None, 34):
        assert rows(connected_components(edges, rows=known)) == sorted([(i, 0) for i in range(31)] + [(100, 100), (101, 100)])


def test_nearest_neighbours_and_ranking(spark):
    q = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [5.0, 5.0])], "item_id long, desc_no int, vec array<double>")
    r = spark.createDataFrame([(7, 0, [0.0, 1.0]), (7, 1, [4.0, 4.0]), (8, 0, [1.0, 1.0])], "item_id long, desc_no int, vec array<double>")
    got = {(x.query_no, x.item_id): (x.d1, x.d2) for x in mt.knn_join(q, r).collect()}
    assert got[0, 7] == (1.0, pytest.approx(32**0.5)) and got[0, 8] == (pytest.approx(2**0.5), None)
    assert rows(mt.good_matches(mt.knn_join(q, r, reduce=0.79))) == rows(mt.good_matches(mt.knn_join(q, r))) == [(1, 7, 2, 2), (1, 8, 0, 2)]
    with pytest.raises(ValueError):
        mt.run_method("none", q, r)
    odd = r.unionByName(spark.createDataFrame([(9, 0, None), (9, 1, []), (None, 0, [1.0, 1.0]), (9, 2, [None, 1.0]), (9, 3, [1.0, 2.0, 3.0])], r.schema))
    assert rows(mt.good_matches(mt.knn_join(q.unionByName(odd.where("item_id = 9")), odd, reduce=0.79)))[:2] == [(1, 7, 2, 2), (1, 8, 0, 2)]
    assert mt.knn_join(q, r.limit(0)).collect() == [] == mt.knn_join(q.limit(0), r).collect()
    best = mt.rank_candidates(spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.9), (1, 9, 0.1)], "query_id long, item_id long, score double")).first()
    assert (best.predicted_id, best.gap, best.ambiguous) == (7, 0.0, True)


@pytest.mark.parametrize("metric", ["l2", "hamming"])
def test_items_in_parts_have_the_same_neighbours(spark, monkeypatch, metric):
    import numpy as np

    rng = np.random.default_rng(4)
    made = [(i, k, [float(x) for x in rng.normal(size=3)], int(rng.integers(-(2**63), 2**63 - 1))) for i in range(12) for k in range(1 + 3 * i)]
    d = spark.createDataFrame(made, "item_id long, desc_no int, vec array<double>, code long").repartition(3)
    q = d.where("item_id % 4 = 3")
    whole, counts = rows(mt.knn_join(q, d, metric=metric)), rows(mt.good_matches(mt.knn_join(q, d, metric=metric, reduce=0.9)))
    assert len(whole) == q.count() * 12
    by = {i: [m for m in made if m[0] == i] for i in range(12)}
    far = (lambda a, b: sum((x - y) ** 2 for x, y in zip(a[2], b[2], strict=True)) ** 0.5) if metric == "l2" else (lambda a, b: float(((a[3] ^ b[3]) & (2**64 - 1)).bit_count()))
    for qid, no, item, d1, d2 in whole:
        mine = sorted(far(by[qid][no], m) for m in by[item])
        assert d1 == pytest.approx(mine[0]) and (d2 == pytest.approx(mine[1]) if len(mine) > 1 else d2 is None)
    monkeypatch.setattr(mt, "PART", 5)
    assert rows(mt.knn_join(q, d, metric=metric)) == whole
    assert rows(mt.good_matches(mt.knn_join(q, d, metric=metric, reduce=0.9))) == counts


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_approximate_neighbours_recall(spark, sf):
    from matchloom.plans import matching as pm

    n, found, wrong = pm.j2(spark, f"/root/testdata/{sf}").agg(F.sum("n"), F.sum("found"), F.sum("wrong")).first()
    print(sf, n, found)
    assert n >= 100 and found >= 0.9 * n and wrong == 0


def test_approximate_neighbours_are_counted_once(spark):
    q = spark.createDataFrame([(1, 0, 5)], "item_id long, desc_no int, code long")
    r = spark.createDataFrame([(7, 0, 5), (7, 1, -1), (8, 0, 4), (8, 1, 4)], "item_id long, desc_no int, code long")
    assert rows(mt.knn_codes_lsh(q, r)) == [(1, 0, 7, 0.0, None), (1, 0, 8, 1.0, 1.0)]


def test_every_registered_method_runs(spark):
    from matchloom.plans import matching as pm

    base = "/root/testdata/sf0.001"
    got = pm.g1(spark, base).unionByName(pm.g1_approximate(spark, base)).groupBy("method").count().collect()
    assert {x["method"] for x in got} == set(mt.REGISTRY) and len({x["count"] for x in got}) == 1


def test_sample_scores(spark):
    df = spark.createDataFrame([(0.95, 0.0, 3, 0, 0, 40.0), (0.70, 0.80, 3, 2, 0, 55.0), (0.8, 0.6, 2, 1, 1, 40.0)], "g double, r double, c int, a int, f int, ms double")
    got = [x[0] for x in df.select(so.sample_score(*(F.col(c) for c in df.columns))).collect()]
    assert got == [pytest.approx(0.3325), pytest.approx(1.591667, abs=1e-6), pytest.approx(-0.76)]


def test_setup_grades(spark):
    schema = "session int, scenario string, detected_count int, accepted_count int, snapshot_quality_score double, analysis_ms double, recognition_confidences array<double>, recognition_rejections int, candidate_validation_rejections int"
    data = [(1, "empty", 0, 0, 0.85, 100.0, [], 0, 0), (1, "empty", 0, 0, 0.90, 90.0, None, None, 0), (2, "empty", 2, 0, 0.80, 1.0, [], 0, 0), (2, "empty", 1, 0, 0.85, 1.0, [], 0, 0)]
    data += [(3, "one_card", 1, 1, 0.85, 150.0, [0.88], 0, 0), (3, "one_card", 1, 1, 0.80, 140.0, [0.92], 0, 0), (4, "one_card", 1, 1, 0.85, 150.0, [0.65], 0, 0), (4, "one_card", 1, 1, 0.80, 140.0, [0.68], 0, 0)]
    graded = ql.grade_scenarios(ql.scenario_metrics(spark.createDataFrame(data, schema), "session", "scenario"))
    by = {r.session: r for r in ql.grade_setup(graded, "session").collect()}
    assert by[1].grade == "excellent" and by[1].ready
    assert by[2].score < 1 and by[2].warning_count == 1
    assert by[3].grade in ("good", "excellent") and by[3].ready
    assert by[4].grade == "warning" and not by[4].ready


def test_scalars_and_boxes(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(sc.clock(F.lit(61_005))) == "01:01.005"
    assert value(sc.fold_angle(F.lit(100.0))) == 10.0 and value(sc.fold_angle(F.lit(-100.0))) == -10.0 and value(sc.fold_angle(F.lit(45.0))) == 45.0
    assert value(bx.snap(F.lit(-2.5), 5)) == 0.0
    assert value(sc.decibels(F.lit(0.0))) == -96.0
    assert value(bx.iou(bx.Box(*(F.lit(None).cast("long"),) * 4), bx.Box(*(F.lit(1),) * 4))) == 0.0


def test_tables(spark):
    given = spark.createDataFrame([("a" * 20, "p"), ("a" * 20, "p"), ("b" * 20, None), ("bad", "p"), ("c" * 20, "p")], "stable_id string, path string")
    seen = spark.createDataFrame([("c" * 20,)], "stable_id string")
    assert dict(rows(tb.append_new(given, seen), "stable_id", "status")) == {"a" * 20: "RECORDED", "b" * 20: "MISSING_FILE", "bad": "BAD_ID", "c" * 20: "ALREADY_RECORDED"}
    manifest = spark.createDataFrame([("x", 0, 3), ("x", 1, 5), ("y", 2, 0), ("z", 3, 4)], "id string, ordinal int, card_count int")
    active = spark.createDataFrame([("x",), ("y",)], "id string")
    assert rows(tb.lookup_active(active, manifest, "z")) == [("x", 1, 5)]
    assert rows(tb.lookup_active(active.limit(0), manifest, "z")) == [("z", 3, 4)]


def test_snapshot_diff_quirk(spark):
    side = lambda *r: spark.createDataFrame(list(r), "key string, value double")
    base = side(("a", 10.0), ("b", 10.0), ("c", 10.0), ("e", 10.0), ("f", 10.0), ("g", 10.0), ("h", 10.0))
    before = side(("a", 0.0), ("b", 10.0), ("c", 10.0), ("d", 3.0), ("e", 1.0), ("f", 5.0), ("g", 5.0), ("h", 5.0), ("i", 5.0), ("j", 5.0), ("k", 5.0))
    after = side(("a", 10.0), ("b", 0.0), ("c", 14.0), ("d", 9.0), ("e", 1.0), ("f", 5.0), ("g", 5.0), ("h", 5.0), ("i", 5.0), ("j", 5.0), ("k", 5.0))
    got = st.snapshot_diff(before, after, base, noise=2.0, threshold=0.5)
    assert rows(got) == [("a", "added", False), ("b", "removed", False), ("c", "moved_or_replaced", False), ("d", "moved_or_replaced", False)]


def test_smooth_over_chunks(spark):
    values = [float((i * 37) % 11) for i in range(50)]
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(values)], "entity_id int, ts_ms long, seq long, value double")
    want, current = [], values[0]
    for v in values:
        current += (v - current) * 0.08
        want.append(current)
    got = [r.smoothed for r in st.smooth(df, "value", 0.08, chunk=7).orderBy("seq").collect()]
    assert got == pytest.approx(want)


def test_boxes_of_all_sizes_meet(spark):
    import random

    from matchloom.operators import spatial as sp

    rng = random.Random(6)
    size = lambda: rng.choice([0, 1, 5, 16, 17, 40, 300, 5000, 100_000])
    made = [(rng.randint(0, 1), i, rng.randint(-400, 400), rng.randint(-400, 400), size(), size(), 0.5) for i in range(70)]
    df = spark.createDataFrame(made, "frame_id int, box_id int, x long, y long, w long, h long, score double")
    a, b = df.where("box_id % 2 = 0"), df.where("box_id % 2 = 1")
    touch = lambda p, q, g: p[2] - g <= q[2] + q[4] and q[2] - g <= p[2] + p[4] and p[3] - g <= q[3] + q[5] and q[3] - g <= p[3] + p[5]
    for grow in (0, 7):
        c = lambda s, n: F.col(f"{s}_{n}")
        holds = (c("a", "x") - grow <= c("b", "x") + c("b", "w")) & (c("b", "x") - grow <= c("a", "x") + c("a", "w")) & (c("a", "y") - grow <= c("b", "y") + c("b", "h")) & (c("b", "y") - grow <= c("a", "y") + c("a", "h"))
        got = rows(sp.overlaps(a, b, holds, grow).select("a_box_id", "b_box_id"))
        assert got == sorted((p[1], q[1]) for p in made for q in made if p[1] % 2 == 0 and q[1] % 2 == 1 and p[0] == q[0] and touch(p, q, grow))
    assert sp._celled(a, 0, 13, False).count() <= 9 * a.count()
    assert sp.overlaps(a.limit(0), b, F.lit(True)).collect() == []


def test_sums_of_a_scenario_go_in_order(spark):
    values = {1: 1e16, 2: 1.0, 3: -1e16, 4: 1.0}
    df = spark.createDataFrame([(n, v) for n, v in values.items()], "seq long, analysis_ms double").repartition(2, F.col("seq") % 2 == 0)
    df = df.selectExpr("seq", "analysis_ms", "1 AS k", "0 AS detected_count", "0 AS accepted_count", "0.5D AS snapshot_quality_score", "array(0.5D) AS recognition_confidences", "0 AS recognition_rejections", "0 AS candidate_validation_rejections")
    assert rows(ql.scenario_metrics(df, "k", order=("seq",)), "avg_analysis_ms", "avg_quality") == [(0.25, 0.5)]


def test_a_hash_that_begins_with_bad_follows_the_sql(spark, tmp_path):
    from matchloom.plans import spatial as ps

    spark.createDataFrame([(183, "click"), (183, "view"), (9, "view")], "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.stable_id: r.status for r in ps.y2(spark, str(tmp_path)).collect()}
    assert got["badcf018955c6a823723"] == "BAD_ID" and got["bad9"] == "BAD_ID" and sorted(got.values()) == ["BAD_ID", "BAD_ID", "RECORDED"]


@pytest.mark.parametrize("small", [0, 6, 64])
def test_small_and_crowded_frames_give_the_same(spark, monkeypatch, small):
    import random

    monkeypatch.setattr(sp, "SMALL", small)
    rng = random.Random(4)
    boxes = [(f, i, rng.randint(0, 90), rng.randint(0, 90), rng.randint(5, 40), rng.randint(5, 40), rng.randint(0, 5) / 5) for f in range(9) for i in range(1, 3 + 2 * f)]
    df = spark.createDataFrame([*boxes, (3, 90, None, None, None, None, 0.5)], BOX)
    share = lambda a, b: max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    iou = lambda a, b: share(a, b) / (a[4] * a[5] + b[4] * b[5] - share(a, b))
    even, odd = df.where("box_id % 2 = 0"), df.where("box_id % 2 = 1")
    free = {(a[0], a[1]) for a in boxes if a[1] % 2 == 0 and not any(b[0] == a[0] and b[1] % 2 == 1 and iou(a, b) > 0.1 for b in boxes)} | {(3, 90)}
    assert {*rows(sp.unoccupied(even, odd), "frame_id", "box_id")} == free
    assert rows(sp.merge(df.where("x is not null"), 3), "frame_id", "x", "y", "w", "h") == brute_merge(boxes, 3)
    assert {*rows(sp.merge(df, 3), "frame_id", "box_id")} >= {(3, 90)}
    assert rows(sp.suppress(df.where("x is not null"), 0.2, rank=-F.col("score")), "frame_id", "box_id") == brute_nms(boxes, 0.2)

    def tier(a, r, sole):
        x, y = a[2] + a[4] / 2, a[3] + a[5] / 2
        return 1 if r[2] <= x <= r[2] + r[4] and r[3] <= y <= r[3] + r[5] else 2 if share(a, r) else 3 if sole else None

    want = []
    for r in (b for b in boxes if b[1] <= 2):
        sole = sum(b[0] == r[0] and b[1] <= 2 for b in boxes) == 1
        found = [(tier(a, r, sole), -a[6], a[1]) for a in boxes if a[0] == r[0] and a[1] > 2 and tier(a, r, sole)]
        best = sorted(f for f in found if f[0] == min(found)[0])
        want += [(r[0], r[1], f[2], f[0], n + 1) for n, f in enumerate(best)]
    assert rows(sp.best_in_region(df.where("box_id > 2 and x is not null"), df.where("box_id <= 2")), "frame_id", "region_id", "box_id", "how", "rank") == sorted(want)


@pytest.mark.parametrize("ordered", [10**6, 3])
def test_components_in_frames(spark, monkeypatch, ordered):
    monkeypatch.setattr(sp, "ORDERED", ordered)
    pairs = spark.createDataFrame([(1, 1, 2), (1, 5, 2), (1, 7, 8), (1, 8, 9), (2, 3, 1), (2, 4, 6)], "frame_id long, a long, b long")
    assert rows(sp.components_in_frames(pairs), "frame_id", "box_id", "root") == [(1, 1, 1), (1, 2, 1), (1, 5, 1), (1, 7, 7), (1, 8, 7), (1, 9, 7), (2, 1, 1), (2, 3, 1), (2, 4, 4), (2, 6, 4)]


@pytest.mark.parametrize("metric", ["l2", "hamming"])
@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_pair_scores_are_those_of_the_search(spark, monkeypatch, metric, scale):
    import numpy as np

    rng = np.random.default_rng(5)
    made = [(i, k, [float(scale * x) for x in rng.normal(size=3)], int(rng.integers(-(2**63), 2**63 - 1))) for i in range(40) for k in range(1 + i % 5)]
    made += [(50 + i, k, v, c) for i, k, v, c in made if i in (3, 4)]  # copies, and a descriptor twice
    made += [(60, 0, *made[9][2:]), (60, 1, *made[9][2:])]
    d = spark.createDataFrame(made, "item_id long, desc_no int, vec array<double>, code long").repartition(3)
    q = d.where("item_id % 4 = 3 or item_id = 60")
    monkeypatch.setattr(mt, "REFERENCE_BLOCK", 20)
    want = rows(mt.good_matches(mt.knn_join(q, d, metric=metric, reduce=0.79)).where("query_id <> item_id"))
    all_ = mt.pair_scores(q, d, metric=metric, others=True)
    assert rows(all_, "query_id", "item_id", "good", "total") == want and len(want) > 300
    first = lambda df: rows(mt.rank_candidates(df).select("query_id", F.col("candidates").cast("string")))
    assert first(mt.pair_scores(q, d, metric=metric, best=3, others=True)) == first(all_)
    if metric == "l2":
        both = mt.fuse(all_, mt.mse_similarity(mt.whole_vectors(q), mt.whole_vectors(d), 0.5))
        assert rows(mt.pair_scores(q, d, fused=(0.68, 0.5), others=True), "query_id", "item_id", "score") == rows(both, "query_id", "item_id", "score")
    monkeypatch.setattr(mt, "PART", 2)
    assert rows(mt.pair_scores(q, d, metric=metric, others=True), "query_id", "item_id", "good", "total") == want


def test_smoothing_makes_no_group_a_chunk(spark):
    df = spark.createDataFrame([(1, n, n, float(n % 5)) for n in range(40)], "entity_id long, ts_ms long, seq long, value double")
    plan = st.smooth(df, "value", 0.08, chunk=4)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan


@pytest.mark.parametrize("scale", [1.0, 30.0, 1e9, 1e200])
def test_scores_are_rounded_where_blocks_meet(spark, scale):
    """Every pair, once, to the digit of a plain computation, near halves and of norms a product cannot tell apart too."""
    import numpy as np

    rng = np.random.default_rng(7)
    made = rng.normal(size=(90, 8)) * scale / 6
    made[40:60] = made[0] + rng.normal(size=(20, 8)) * scale * 1e-6
    step = np.sqrt((np.arange(20) + 0.5) * 1e-3 * 8 * 0.25)  # from all zeros the scores lie at halves of the third digit
    made[60:80] = 0
    made[60:80, 0] = np.where(np.arange(20) > 0, step, 0)
    d = spark.createDataFrame([(i, v) for i, v in enumerate(made.tolist())], "item_id long, vec array<double>").repartition(3)
    q = d.where("item_id % 4 = 0")
    for digits in (3, 9):
        with np.errstate(over="ignore"):
            plain = {(i, j): mt._mse_scores(made[i : i + 1], made[j : j + 1], 0.5)[0, 0] for i in range(0, 90, 4) for j in range(90) if i != j}
        up = lambda x: np.floor(x * 10.0**digits + 0.5) / 10.0**digits  # noqa: B023, E731
        got = rows(mt.mse_similarity(q, d, 0.5, digits=digits, others=True), "query_id", "item_id", "score")
        assert got == sorted((i, j, up(x)) for (i, j), x in plain.items())
        with np.errstate(over="ignore"):
            assert (mt._mse_rounded(made, made, 0.5, digits) == mt._rounded(mt._mse_scores(made, made, 0.5), digits)).all()


@pytest.mark.parametrize("name", ["a15", "a16", "j11"])
def test_no_row_by_row_step_stands_behind_all_pairs(spark, name):
    """What Spark did to each of the pairs (rounding, leaving out an item's own) cost more than the pairs."""
    from matchloom.plans import matching as plans

    plan = getattr(plans, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.split("MapInArrow")[0] and "round(" not in plan


def test_histogram_scores_are_rounded_where_blocks_meet(spark):
    """Against a plain computation: flat histograms, pairs without a shared cell, an item's own pair."""
    import numpy as np

    rng = np.random.default_rng(11)
    held = rng.integers(0, 3, size=(50, 4)) * (rng.random((50, 4)) < 0.6)
    held[7], held[8] = 2, 5  # flat
    d = spark.createDataFrame([(i, int(c) // 2, int(c) % 2, int(held[i, c])) for i in range(50) for c in np.flatnonzero(held[i])], "item_id long, bx long, by long, n long")
    want = []
    for i in range(0, 50, 5):
        for j in range(50):
            a, b = (held[k].astype(float) for k in (i, j))
            if i != j and a @ b > 0:
                root = np.sqrt((a @ a - a.sum() * a.sum() / 4) * (b @ b - b.sum() * b.sum() / 4))
                score = 1.0 if root == 0 else min(max(((a @ b - a.sum() * b.sum() / 4) / root + 1) / 2, 0.0), 1.0)
                want.append((i, j, float(np.floor(score * 1000 + 0.5) / 1000)))
    assert rows(mt.histogram_similarity(d.where("item_id % 5 = 0"), d, 2, digits=3, others=True), "query_id", "item_id", "score") == want and 1.0 in {w[2] for w in want}


def test_a_baseline_is_not_sent_out(spark):
    """However small it looks: each comparison would bring it to the driver, whole, again."""
    side = lambda n: spark.range(n).select(F.lit("a").alias("month"), F.col("id").alias("key"), (F.col("id") * 1.0).alias("value"))
    held, base = side(30), side(40).select("key", "value")
    for pair, sent in (((), 0), (("month",), 1)):  # a row a pair may be
        plan = st.snapshot_diff(held, held.withColumn("value", F.col("value") * 3), base, noise=2.0, threshold=0.5, pair=pair)
        assert sorted(plan.select("key", "kind", "shifted").collect()) == [(k, "moved_or_replaced", True) for k in range(2, 30)]
        assert plan._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") <= sent


def test_fused_scores_are_rounded_on_both_ways(spark, monkeypatch):
    d = spark.range(120).select((F.col("id") / 3).cast("long").alias("item_id"), (F.col("id") % 3).cast("int").alias("desc_no"), F.array(F.sin("id"), F.cos(F.col("id") * 7)).alias("vec"))
    q = d.where("item_id % 4 = 0")
    scores = lambda **only: rows(mt.pair_scores(q, d, fused=(0.68, 0.5), others=True, **only), "query_id", "item_id", "score")
    want = [(a, b, round(x, 4)) for a, b, x in scores()]
    assert scores(digits=4) == want and len(want) == 390
    monkeypatch.setattr(mt, "PART", 2)
    assert scores(digits=4) == want


@pytest.mark.parametrize("name", ["w8", "flagship", "j11", "j2"])
def test_every_vector_is_a_query(spark, name):
    """Not every twentieth alone, in the query and in its SQL."""
    from matchloom.plans import catalog
    from matchloom.plans import matching as plans

    sf = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    out = getattr(plans, name)(spark, sf)
    if name == "flagship":
        assert out.first()["n"] == len(ids)
    else:
        assert {r[0] for r in out.select("query_id").distinct().collect()} == ids
        assert name != "j11" or out.count() == len(ids) * (len(ids) - 1)
    sql = [text for key, text in catalog.oracle_sql().items() if catalog.ENTRIES[key].run is getattr(plans, name)]
    assert not any("% 20" in text for text in sql)


def test_codes_within_a_limit_are_those_of_the_tables(spark):
    """Blocks of keys that begin alike bring the same pairs together as rows of whole keys, with nothing broadcast."""
    import numpy as np

    rng = np.random.default_rng(5)
    made = rng.integers(-(2**63), 2**63 - 1, 1100).tolist()
    made[100:400] = [made[0] ^ (1 << int(b)) for b in rng.integers(0, 63, 300)]  # a lump
    c = spark.createDataFrame([(n, 0, x) for n, x in enumerate(made)] + [(5000, 0, None)], "item_id long, desc_no int, code long")
    q = c.where("item_id % 9 = 0").withColumns({"most": (F.col("item_id") % 31).cast("int"), "last": F.lit(600).cast("long")})
    out = mt.codes_within(q, c)
    want = mt.knn_codes_lsh(q, c).join(q.select(F.col("item_id").alias("query_id"), "most"), "query_id").where("d1 < most or d1 = most and item_id <= 600")
    got = rows(out, "query_id", "item_id", "distance")
    assert got == rows(want, "query_id", "item_id", "d1") and len(got) > 1000
    assert got == rows(mt.codes_within(q, c.limit(0).unionByName(c), radius=3), "query_id", "item_id", "distance")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert mt.codes_within(q, c.limit(0)).count() == 0 == mt.codes_within(q.limit(0), c).count()


def test_nearest_codes_go_by_exact_limits(spark):
    """One descriptor an item goes by whole numbers: the same rows as all pairs ranked, ties and own pairs too."""
    import numpy as np
    from pyspark.sql import Window

    rng = np.random.default_rng(8)
    made = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 300), rng.integers(0, 9, 300)]).tolist()
    c = spark.createDataFrame([(n, 0, x) for n, x in enumerate(made)], "item_id long, desc_no int, code long")
    at = Window.partitionBy("query_id").orderBy("d1", "item_id")
    five = lambda df: rows(df.withColumn("rank", F.row_number().over(at)).where("rank <= 5"), "query_id", "item_id", "d1", "d2")
    for few in (600, 7, 3):
        some = c.where(F.col("item_id") % 600 < few)
        pairs = mt.knn_join(c, some, metric="hamming", others=True)
        near = mt.knn_join(c, some, metric="hamming", best=5, others=True)
        assert five(near) == five(pairs) and near.count() <= 5 * 600 * 4  # of each block, however many tie
