"""Registered queries of window, snapshot and setup-grading operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality as ql
from ..operators import state as st
from .catalog import query
from .tables import READINGS, readings, table

W = "(PARTITION BY entity_id ORDER BY ts_ms, seq)"


def _motion(spark, sf):
    return st.reading_change(readings(spark, sf), "value", threshold=60)


MOTION = READINGS + f""", m AS (SELECT *, coalesce(abs(value - lag(value) OVER {W}) > 60, false) AS motion, (ts_ms - lag(ts_ms) OVER {W}) / 1000 AS gap FROM r)"""


@query("w1_rolling_mean", f"WITH {READINGS} SELECT seq, round(avg(value) OVER (PARTITION BY entity_id ORDER BY ts_ms, seq ROWS 59 PRECEDING), 11) AS rolling FROM r")
def w1(spark, sf):
    return st.rolling_mean(readings(spark, sf), "value", digits=12).select("seq", F.round("rolling", 11).alias("rolling"))


@query("w2_reading_change", f"WITH {MOTION} SELECT seq, motion, CASE WHEN gap > 0 THEN round(1 / gap, 12) ELSE 0.0 END AS rate FROM m")
def w2(spark, sf):
    return _motion(spark, sf).select("seq", "motion", F.round("rate", 12).alias("rate"))


@query("w3_settle_detection", f"""WITH {MOTION}, e AS (SELECT *, sum(motion::INT) OVER {W} AS episode FROM m), s AS (SELECT *, sum((NOT motion)::INT) OVER (PARTITION BY entity_id, episode ORDER BY ts_ms, seq) AS still FROM e)
SELECT seq, episode, episode > 0 AND NOT motion AND still = 2 AS settled FROM s""")
def w3(spark, sf):
    return st.settle_detection(_motion(spark, sf), 2).select("seq", "episode", "settled")


IDENTITY = READINGS + f""", b AS (SELECT *, confidence < 0.3 AS low, confidence < 0.3 OR coalesce(lag(confidence < 0.3) OVER {W}, true) OR item_id IS DISTINCT FROM lag(item_id) OVER {W} AS broke FROM r),
i AS (SELECT *, sum(broke::INT) OVER {W} AS island FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY entity_id, island ORDER BY ts_ms, seq) AS run FROM i)"""


@query("w4_identity_streak", f"WITH {IDENTITY} SELECT seq, CASE WHEN NOT low THEN item_id END AS state_id, CASE WHEN low THEN 'empty' WHEN run >= 3 THEN 'confirmed' ELSE 'candidate' END AS phase, CASE WHEN low THEN 0 ELSE run END AS frames FROM n")
def w4(spark, sf):
    return st.identity_streak(readings(spark, sf), confirm=3, least=0.3).select("seq", "state_id", "phase", "frames")


def _items(spark, sf):
    return readings(spark, sf).withColumn("item", F.when(F.col("confidence") >= 0.5, F.col("item_id")))


ITEMS = READINGS + f""", t AS (SELECT *, CASE WHEN confidence >= 0.5 THEN item_id END AS item FROM r), u AS (SELECT *, sum((item IS NOT NULL)::INT) OVER {W} AS run, last_value(item IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS last FROM t),
v AS (SELECT *, sum((item IS NULL)::INT) OVER (PARTITION BY entity_id, run ORDER BY ts_ms, seq) AS streak FROM u)"""


@query("w5_empty_streak", f"WITH {ITEMS} SELECT seq, CASE WHEN streak < 2 THEN last END AS held, sum((item IS NOT NULL OR (streak = 2 AND last IS NOT NULL))::INT) OVER {W} AS layout_id FROM v")
def w5(spark, sf):
    return st.empty_streak(_items(spark, sf)).select("seq", "held", "layout_id")


@query("w6_change_only", f"WITH {READINGS}, c AS (SELECT *, lag(item_id) OVER {W} AS before, row_number() OVER {W} AS n FROM r) SELECT seq, entity_id, item_id FROM c WHERE n = 1 OR item_id IS DISTINCT FROM before")
def w6(spark, sf):
    return st.change_only(readings(spark, sf), ["item_id"]).select("seq", "entity_id", "item_id")


@query("w7_last_n", f"WITH {READINGS}, c AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts_ms DESC, seq DESC) AS n FROM r) SELECT seq, entity_id FROM c WHERE n <= 8")
def w7(spark, sf):
    return st.last_n(readings(spark, sf), 8).select("seq", "entity_id")


@query("w10_motion_to_publish", f"""WITH {MOTION}, p AS (SELECT *, max(CASE WHEN motion THEN ts_ms END) OVER (PARTITION BY entity_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS moved FROM m) SELECT seq, ts_ms - moved AS ms FROM p WHERE item_id = 'purchase'""")
def w10(spark, sf):
    m = _motion(spark, sf)
    moved = st.carry_forward(m, "moved", F.when(F.col("motion"), F.col("ts_ms")))
    return moved.withColumn("ms", F.col("ts_ms") - F.col("moved")).where("item_id = 'purchase'").select("seq", "ms")


@query("w11_refresh_hold", f"""WITH {READINGS}, n AS (SELECT *, (row_number() OVER {W} - 1) % 30 = 0 AS due FROM r) SELECT seq, due, last_value(CASE WHEN due THEN value END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS calibration FROM n""")
def w11(spark, sf):
    return st.refresh_hold(readings(spark, sf), "value").select("seq", "due", "calibration")


@query("w12_smooth", f"""WITH RECURSIVE {READINGS}, n AS (SELECT *, row_number() OVER {W} AS i FROM r), s(entity_id, seq, i, cur) AS (SELECT entity_id, seq, i, value FROM n WHERE i = 1
 UNION ALL SELECT n.entity_id, n.seq, n.i, cur + (n.value - cur) * 0.08::DOUBLE FROM s JOIN n ON n.entity_id = s.entity_id AND n.i = s.i + 1) SELECT seq, round(cur, 6) AS smoothed FROM s""")
def w12(spark, sf):
    return st.smooth(readings(spark, sf), "value", 0.08, chunk=16).select("seq", F.round("smoothed", 6).alias("smoothed"))


def _markers(spark, sf):
    marker = F.when(F.col("item_id") == "signup", "start").when(F.col("seq") % 10 == 3, "stop").otherwise(F.col("item_id"))
    return readings(spark, sf).withColumn("marker", F.when(F.col("seq") % 9 == 0, "start").otherwise(marker))


MARKERS = READINGS + f""", k AS (SELECT *, CASE WHEN seq % 9 = 0 OR item_id = 'signup' THEN 'start' WHEN seq % 10 = 3 THEN 'stop' ELSE item_id END AS marker FROM r), x AS (SELECT *, sum((marker = 'start')::INT) OVER {W} AS session FROM k),
y AS (SELECT *, first(ts_ms) OVER (PARTITION BY entity_id, session ORDER BY ts_ms, seq) AS begin, coalesce(sum((marker = 'stop')::INT) OVER (PARTITION BY entity_id, session ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM x WHERE session > 0)"""


@query("w13_timeline", f"WITH {MARKERS} SELECT seq, session, marker, ts_ms - begin AS offset_ms, max(ts_ms - begin) OVER (PARTITION BY entity_id, session) AS duration_ms FROM y WHERE stopped = 0")
def w13(spark, sf):
    return st.timeline(_markers(spark, sf)).select("seq", "session", "marker", "offset_ms", "duration_ms")


@query("w15_best_of", f"WITH {READINGS}, c AS (SELECT *, row_number() OVER (PARTITION BY entity_id, item_id ORDER BY confidence DESC, seq) AS n FROM r) SELECT entity_id, item_id, seq FROM c WHERE n = 1")
def w15(spark, sf):
    return st.best_of(readings(spark, sf), "confidence", keys=("entity_id", "item_id"), order=("seq",)).select("entity_id", "item_id", "seq")


@query("w16_throttle", f"""WITH RECURSIVE {READINGS}, s(entity_id, ts_ms, seq) AS (SELECT entity_id, min(ts_ms), arg_min(seq, ts_ms) FROM r GROUP BY 1
 UNION ALL (SELECT s.entity_id, min(r.ts_ms), arg_min(r.seq, r.ts_ms) FROM s JOIN r ON r.entity_id = s.entity_id AND r.ts_ms - s.ts_ms >= 36000000 GROUP BY s.entity_id)) SELECT entity_id, seq FROM s""")
def w16(spark, sf):
    return st.throttle(readings(spark, sf), 36_000_000).select("entity_id", "seq")


@query("w17_evenly_spaced", f"""WITH {READINGS}, c AS (SELECT *, row_number() OVER {W} - 1 AS pos, count(*) OVER (PARTITION BY entity_id) AS size FROM r)
SELECT entity_id, seq FROM c WHERE size <= 24 OR pos IN (SELECT round_even(i * (size - 1) / 23.0, 0)::BIGINT FROM unnest(range(0, 24)) AS t(i))""")
def w17(spark, sf):
    return st.evenly_spaced(readings(spark, sf), 24, order=("ts_ms", "seq"), keys=("entity_id",)).select("entity_id", "seq")


@query("j12_as_of", f"""WITH {READINGS} SELECT seq, last_value(CASE WHEN item_id = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS last_click FROM r""")
def j12(spark, sf):
    r = readings(spark, sf)
    return st.carry_forward(r, "last_click", F.when(F.col("item_id") == "click", F.col("value"))).select("seq", "last_click")


@query("j12_as_of_join", f"""WITH {READINGS}, c AS (SELECT entity_id, ts_ms, arg_max(seq, seq) AS seq, arg_max(value, seq) AS value FROM r WHERE item_id = 'click' GROUP BY ALL), p AS (SELECT * FROM r WHERE item_id <> 'click')
SELECT p.seq, p.item_id, c.seq AS click_seq, c.value AS click_value FROM p ASOF LEFT JOIN c ON p.entity_id = c.entity_id AND p.ts_ms >= c.ts_ms""")
def j12_join(spark, sf):
    """Every reading that is no click with the user's last click."""
    r = readings(spark, sf)
    out = st.as_of_join(r.where("item_id <> 'click'"), r.where("item_id = 'click'"), order=("seq",))
    return out.select("seq", "item_id", F.col("match.seq").alias("click_seq"), F.col("match.value").alias("click_value"))


def snapshots(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").alias("key")).agg(F.sum("o_totalprice").alias("value"))


SNAP = """s AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey AS key, sum(o_totalprice) AS value FROM orders GROUP BY ALL), b AS (SELECT key, quantile_cont(value, 0.5) AS base FROM s GROUP BY 1)"""


@query("j8_snapshot_diff", f"""WITH {SNAP}, o AS (SELECT month, lead(month) OVER (ORDER BY month) AS next FROM (SELECT DISTINCT month FROM s)),
p AS (SELECT next AS month, key, value FROM s JOIN o USING (month) WHERE next IS NOT NULL), c AS (SELECT s.* FROM s WHERE month IN (SELECT next FROM o)),
f AS (SELECT month, key, p.value AS before, c.value AS after, abs(coalesce(p.value, 0) - coalesce(c.value, 0)) > 1000 AS changed FROM p FULL JOIN c USING (month, key)), d AS (SELECT f.*, base FROM f LEFT JOIN b USING (key)),
g AS (SELECT month, avg(changed::INT) >= 0.45 AS shifted FROM f GROUP BY 1),
k AS (SELECT *, CASE WHEN base IS NULL THEN 1.0 ELSE coalesce(before, 0) / base END >= 0.5 AS had, CASE WHEN base IS NULL THEN 1.0 ELSE coalesce(after, 0) / base END >= 0.5 AS has FROM d)
SELECT month, key, CASE WHEN NOT had AND has THEN 'added' WHEN had AND NOT has THEN 'removed' WHEN had THEN 'moved_or_replaced' ELSE 'noise_or_lighting' END AS kind, shifted FROM k JOIN g USING (month) WHERE changed""")
def j8(spark, sf):
    """Every month against the month before it."""
    s = snapshots(spark, sf)
    base = s.groupBy("key").agg(F.percentile("value", 0.5).alias("value"))
    months = s.select("month").distinct().withColumn("next", F.lead("month").over(Window.orderBy("month"))).where("next is not null")  # a row a month
    before = s.join(F.broadcast(months), "month").select(F.col("next").alias("month"), "key", "value")
    after = s.join(F.broadcast(months.select(F.col("next").alias("month"))), "month", "left_semi")
    return st.snapshot_diff(before, after, base, noise=1000, threshold=0.5, pair=("month",))


#: A month's customers as a grid of 64 by 64 cells, a cell's value the sum of its customers' orders.
CELLS = """c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey % 64 AS cx, o_custkey // 64 % 64 AS cy, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
g AS (SELECT month, cx, cy, abs(value - quantile_cont(value, 0.5) OVER (PARTITION BY cx, cy)) > 50000 AS foreground FROM c)"""


@query("a13_region_foreground", f"""WITH {CELLS}, m AS (SELECT DISTINCT month FROM g), r AS (SELECT month, r_regionkey AS region_id, r_regionkey * 14 - 4 AS x, r_regionkey * 11 - 2 AS y, 20 AS w, 25 AS h FROM m CROSS JOIN region),
k AS (SELECT *, greatest(0, x) AS l, greatest(0, y) AS t, least(64, x + w) AS e, least(64, y + h) AS b FROM r)
SELECT k.month, region_id, round(count(*) FILTER (g.foreground) / ((e - l) * (b - t))::DOUBLE, 9) AS ratio FROM k LEFT JOIN g ON g.month = k.month AND cx >= l AND cx < e AND cy >= t AND cy < b GROUP BY k.month, region_id, l, t, e, b""")
def a13_region(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_custkey")
    cells = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), (key % 64).alias("cx"), (F.floor(key / 64) % 64).alias("cy")).agg(F.sum("o_totalprice").alias("value"))
    seen = st.median_baseline(cells.withColumn("key", F.struct("cx", "cy")), threshold=50_000).select("month", "cx", "cy", "foreground")
    n = F.col("r_regionkey")
    regions = cells.select("month").distinct().crossJoin(F.broadcast(table(spark, sf, "region").select(n.alias("region_id"), (n * 14 - 4).alias("x"), (n * 11 - 2).alias("y"), F.lit(20).alias("w"), F.lit(25).alias("h"))))  # five rows
    return st.foreground_ratio(seen, regions, width=64, height=64, keys=("month",)).select("month", "region_id", F.round("ratio", 9).alias("ratio"))


@query("a13_median_baseline", f"WITH {SNAP}, m AS (SELECT key, quantile_cont(value, 0.5) AS baseline FROM s GROUP BY 1) SELECT month, count(*) AS n, count(*) FILTER (abs(value - baseline) > 50000) AS foreground FROM s JOIN m USING (key) GROUP BY 1")
def a13(spark, sf):
    out = st.median_baseline(snapshots(spark, sf), threshold=50000)
    return out.groupBy("month").agg(F.count("*").alias("n"), F.count_if("foreground").alias("foreground"))


@query("a17_peak_level", f"WITH {READINGS} SELECT entity_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, round(greatest(-96, least(0, CASE WHEN max(abs(value)) > 0 THEN 20 * log10(max(abs(value / 1000))) ELSE -96 END)), 1) AS db FROM r GROUP BY 1, 2")
def a17(spark, sf):
    return st.peak_levels(readings(spark, sf).withColumn("value", F.col("value") / 1000), width="1 day")


SAMPLES = READINGS + """, s AS (SELECT entity_id AS session, ['empty','one_card','three_cards'][seq % 3 + 1] AS scenario, CASE seq % 3 WHEN 0 THEN seq % 2 WHEN 1 THEN 1 ELSE 2 + seq % 2 END AS detected, CASE seq % 3 WHEN 0 THEN (entity_id % 4 = 0)::INT WHEN 1 THEN 1 ELSE 3 END AS accepted,
  0.5 + confidence / 2 AS q, value * 12 AS ms, confidence AS c, (seq % 4 = 0)::INT AS rec FROM r)"""


def samples(spark, sf):
    s, e = F.col("seq"), F.col("entity_id")
    kind = s % 3
    return readings(spark, sf).select(
        e.alias("session"), F.element_at(F.array(*map(F.lit, ("empty", "one_card", "three_cards"))), (kind + 1).cast("int")).alias("scenario"), F.when(kind == 0, s % 2).when(kind == 1, 1).otherwise(2 + s % 2).alias("detected_count"),
        F.when(kind == 0, (e % 4 == 0).cast("int")).when(kind == 1, 1).otherwise(3).alias("accepted_count"), (0.5 + F.col("confidence") / 2).alias("snapshot_quality_score"), (F.col("value") * 12).alias("analysis_ms"),
        "seq", F.array("confidence").alias("recognition_confidences"), (s % 4 == 0).cast("int").alias("recognition_rejections"), F.lit(0).alias("candidate_validation_rejections"),
    )


METRICS = SAMPLES + """, m AS (SELECT session, scenario, count(*) AS sample_count, round_even(sum(detected) / count(*), 2) AS avg_detected, round_even(sum(accepted) / count(*), 2) AS avg_accepted, round_even(sum(ms) / count(*), 2) AS avg_analysis_ms, round_even(sum(q) / count(*), 2) AS avg_quality,
  round_even(sum(c) / count(*), 3) AS avg_confidence, round_even(min(c), 3) AS min_confidence, sum(rec)::BIGINT AS recognition_rejections FROM s GROUP BY ALL)"""


@query("a7_scenario_metrics", f"WITH {METRICS} SELECT session, scenario, sample_count, avg_detected, avg_accepted, round(avg_analysis_ms, 0) AS avg_analysis_ms, avg_quality, avg_confidence, min_confidence, recognition_rejections FROM m")
def a7(spark, sf):
    m = ql.scenario_metrics(samples(spark, sf), "session", "scenario", order=("seq",))
    return m.select("session", "scenario", "sample_count", "avg_detected", "avg_accepted", F.round("avg_analysis_ms", 0).alias("avg_analysis_ms"), "avg_quality", "avg_confidence", "min_confidence", "recognition_rejections")


GRADED = METRICS + """, e AS (SELECT *, CASE scenario WHEN 'one_card' THEN 1 ELSE 3 END AS x, CASE scenario WHEN 'one_card' THEN 0.75 ELSE 0.70 END AS good, CASE scenario WHEN 'one_card' THEN 0.60 ELSE 0.55 END AS low FROM m),
g AS (SELECT *, CASE WHEN scenario = 'empty' THEN CASE WHEN avg_accepted > 0 THEN 0.0 ELSE 1 - CASE WHEN avg_detected > 0 THEN least(0.4, avg_detected * 0.15) ELSE 0 END - CASE WHEN avg_quality < 0.7 THEN (0.7 - avg_quality) * 0.5 ELSE 0 END END
  ELSE CASE WHEN avg_accepted = 0 THEN 0 WHEN avg_accepted < x THEN avg_accepted / x WHEN avg_accepted > x THEN 0.8 ELSE 1.0 END - CASE WHEN avg_accepted > 0 AND avg_confidence < good THEN (good - avg_confidence) * 0.8 ELSE 0 END
   - CASE WHEN recognition_rejections > 0 THEN least(0.3, recognition_rejections / sample_count * 0.05) ELSE 0 END - CASE WHEN avg_analysis_ms > 1500 THEN 0.15 WHEN avg_analysis_ms > 750 THEN 0.05 ELSE 0 END END AS raw,
  CASE WHEN scenario = 'empty' THEN CASE WHEN avg_accepted > 0 OR avg_quality < 0.55 THEN 'bad' WHEN avg_quality < 0.7 THEN 'warning' ELSE 'ok' END
   ELSE CASE WHEN avg_accepted = 0 OR avg_confidence < low THEN 'bad' WHEN avg_confidence < good OR avg_accepted <> x THEN 'warning' ELSE 'ok' END END AS status,
  CASE WHEN scenario = 'empty' THEN (avg_accepted > 0)::INT ELSE (avg_accepted = 0)::INT + (avg_accepted > 0 AND avg_confidence < low)::INT END AS blocking FROM e),
c AS (SELECT *, round_even(greatest(0, least(1, CASE status WHEN 'warning' THEN least(raw, 0.74) WHEN 'bad' THEN least(raw, 0.54) ELSE raw END)), 3) AS score FROM g)"""


@query("a8_setup_grade", f"""WITH {GRADED}
SELECT session, CASE WHEN avg(score) >= 0.9 THEN 'excellent' WHEN avg(score) >= 0.75 THEN 'good' WHEN avg(score) >= 0.55 THEN 'warning' ELSE 'bad' END AS grade, avg(score) >= 0.75 AND sum(blocking) = 0 AS ready, sum(sample_count)::BIGINT AS sample_count, sum(blocking)::BIGINT AS blocking_count FROM c GROUP BY 1""")
def a8(spark, sf):
    graded = ql.grade_scenarios(ql.scenario_metrics(samples(spark, sf), "session", "scenario", order=("seq",)))
    return ql.grade_setup(graded, "session").select("session", "grade", "ready", "sample_count", "blocking_count")


@query("a8_operator_messages", f"""WITH {GRADED}, t AS (SELECT *, CASE WHEN scenario = 'empty' THEN CASE WHEN avg_accepted > 0 THEN 'Pusta mata zawiera zaakceptowane karty.' WHEN avg_detected > 0 THEN 'Pusta mata generuje fałszywych kandydatów.' WHEN status = 'ok' THEN 'Pusta mata zweryfikowana poprawnie.' END
  WHEN avg_accepted = 0 THEN 'Brak wykrytych kart (oczekiwano ' || x || ').' WHEN avg_confidence < low THEN 'Pewność rozpoznania poniżej krytycznego progu.' WHEN avg_accepted < x THEN 'Wykryto za mało kart (' || round_even(avg_accepted, 1)::DECIMAL(10,1) || '/' || x || ').' WHEN avg_accepted > x THEN 'Wykryto za dużo kart.'
  WHEN avg_confidence < good THEN 'Pewność rozpoznania jest niska.' WHEN recognition_rejections > 0 THEN 'Wykryto wysoki wskaźnik odrzuceń kandydatów.' WHEN status = 'ok' THEN 'Scenariusz ' || x || ' kart zaliczony pomyslnie.' END AS text FROM c)
SELECT session, coalesce(string_agg('[' || scenario || '] ' || text, ' | ' ORDER BY scenario) || ' | ', '') || CASE WHEN avg(score) >= 0.75 AND sum(blocking) = 0 THEN 'Warunki sa wystarczajace do rozpoczecia sesji.' WHEN sum(blocking) > 0 THEN 'Wykryto problemy blokujace rozpoczęcie sesji.' ELSE 'Jakosć stanowiska jest zbyt niska na start sesji.' END AS messages FROM t GROUP BY 1""")
def a8_messages(spark, sf):
    graded = ql.grade_scenarios(ql.scenario_metrics(samples(spark, sf), "session", "scenario", order=("seq",)))
    return ql.operator_messages(graded, "session").select("session", F.array_join("messages", " | ").alias("messages"))


@query("a9_profile_scoring", f"""WITH {READINGS}, f(profile, ordinal) AS (VALUES ('click', 0), ('view', 1), ('purchase', 2), ('absent', 3)), o AS (SELECT item_id AS profile, confidence*0.35 + confidence*0.85 + CASE WHEN seq % 4 > 0 THEN (seq % 3) / (seq % 4) ELSE 0 END * 0.7 + (seq % 3) * 0.1 - (seq % 50 = 0)::INT * 2.0 - greatest(0, value - 120) / 120 * 0.35 AS s, seq % 3 AS a, (seq % 50 = 0)::INT AS fp FROM r),
a AS (SELECT profile, avg(s) AS avg, sum(a) AS acc, sum(fp) AS fp, count(*) AS n FROM o GROUP BY 1)
SELECT profile, round(coalesce(avg, -999.0), 9) AS score, CASE WHEN n IS NULL THEN 'LOW' WHEN avg >= 1.2 AND acc > 0 AND fp = 0 THEN 'HIGH' WHEN avg >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN n IS NULL THEN 'no_samples' ELSE concat_ws(';', CASE WHEN fp > 0 THEN 'false_positive_penalty' END, CASE WHEN acc > 0 THEN 'accepted_cards_reward' END, CASE WHEN fp <= 0 AND acc <= 0 THEN 'geometry_only' END) END AS reasons,
  coalesce(n, 0) AS sample_count, row_number() OVER (ORDER BY coalesce(avg, -999.0) DESC, ordinal) = 1 AS chosen FROM f LEFT JOIN a USING (profile)""")
def a9(spark, sf):
    s = F.col("seq")
    given = readings(spark, sf).select(F.col("item_id").alias("profile"), F.col("confidence").alias("geometry_score"), F.col("confidence").alias("recognition_score"), (s % 4).alias("candidate_count"), (s % 3).alias("accepted_count"), (s % 50 == 0).cast("int").alias("false_positive_count"), F.col("value").alias("matching_ms"))
    profiles = spark.createDataFrame([("click", 0), ("view", 1), ("purchase", 2), ("absent", 3)], "profile string, ordinal int").coalesce(1)
    return ql.score_profiles(profiles, given).select("profile", F.round("score", 9).alias("score"), "confidence", F.array_join("reasons", ";").alias("reasons"), "sample_count", "chosen")


@query("a10_nested_profiles", """SELECT event_type, sum(coalesce(k, 0))::BIGINT AS total, sum(coalesce(event_id % 3, 0))::BIGINT AS rejected FROM (SELECT event_type, event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events) GROUP BY 1""")
def a10(spark, sf):
    e = table(spark, sf, "events")
    profiles = F.array(F.struct(F.get_json_object("props", "$.k").cast("int").alias("found"), F.lit(0).cast("long").alias("rejected")), F.struct(F.lit(None).cast("int").alias("found"), (F.col("event_id") % 3).alias("rejected")))
    flat = e.select("event_type", F.explode_outer(profiles).alias("p"))
    return flat.groupBy("event_type").agg(F.sum(F.coalesce("p.found", F.lit(0))).alias("total"), F.sum(F.coalesce("p.rejected", F.lit(0))).alias("rejected"))


@query("a11_reason_sums", """SELECT reason, sum(n)::BIGINT AS n FROM (SELECT event_type AS reason, json_extract_string(props, '$.k')::INTEGER AS n FROM events UNION ALL SELECT 'any', 1 FROM events) GROUP BY 1""")
def a11(spark, sf):
    counts = F.create_map(F.col("event_type"), F.get_json_object("props", "$.k").cast("int"), F.lit("any"), F.lit(1))
    return table(spark, sf, "events").select(F.explode(counts).alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))
