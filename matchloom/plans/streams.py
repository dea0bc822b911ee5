"""Registered queries of the streaming operators. Each runs as a stream over
the events' files; batch twins are compared in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as st
from ..streaming import machines as mc
from ..session import folder, stored
from ..streaming import run
from . import state as _batch  # noqa: F401  (registers the twins)
from .catalog import ENTRIES, query
from .tables import READINGS, epoch_ms, table


def reading_stream(spark, sf):
    e = run.table_stream(spark, sf, "events")
    return as_readings(e)


def as_readings(e):
    return e.select(F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), epoch_ms("ts").alias("ts_ms"), F.col("event_id").alias("seq"), F.col("event_type").alias("item_id"), (F.get_json_object("props", "$.k").cast("int") / 99.0).alias("confidence"), "value")


def inputs(r, name):
    """The columns that a machine reads, out of readings."""
    s = F.col("seq")
    box = F.array(s % 60, s % 45, F.lit(30).cast("long"), F.lit(40).cast("long"))
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (s % len(names) + 1).cast("int"))
    add = {
        "gate": {"motion": F.col("value") > 60, "outcome": F.when(s % 17 == 0, "published").when(s % 19 == 0, "rejected")},
        "session": {"command": pick("start", "capture", "set", "commit", "set", "discard", "clear", "end", "set")},
        "table": {"op": pick("upsert", "upsert", "reverify", "upsert", "remove_box", "correct", "reverify_box", "remove"), "box": box, "to_id": F.lit("view")},
        "collector": {"scenario": pick("empty", "one_card", "three_cards", "other"), "passed": F.col("confidence") > 0.1},
        "presence": {"present": F.col("confidence") > 0.5},
        "params": {"op": F.when(s % 13 == 0, "commit").when(s % 11 == 0, "rollback").when(s % 7 == 0, "save").when(s % 17 == 0, "apply").otherwise("update"), "name": F.when((s % 13 > 0) & (s % 11 > 0) & ((s % 7 == 0) | (s % 17 == 0)), "kept").otherwise(F.col("item_id"))},
        "markers": {"marker": F.when(s % 9 == 0, "start").when(s % 10 == 3, "stop").otherwise(F.col("item_id"))},
        "calibration": {"valid": F.col("confidence") > 0.2, "params": F.floor(F.col("confidence") * 1.01)},
    }
    return r.withColumns(add[name]) if name in add else r


MACHINES = {
    "st1_settle_gate": ("gate", mc.settle_gate(40_000_000)),
    "st2_identity": ("", mc.identity(3, 0.3)),
    "st3_snapshot_session": ("session", mc.snapshot_session()),
    "st4_table_state": ("table", mc.table_state(("click", "view", "purchase", "signup"))),
    "st5_sample_collector": ("collector", mc.sample_collector(("empty", "one_card", "three_cards"))),
    "st6_change_only": ("", mc.changes_only()),
    "st7_hysteresis": ("presence", mc.hysteresis(20_000_000)),
    "st9_parameter_session": ("params", mc.parameter_session({"click": (0.0, 60.0, True), "view": (5.0, 80.0, False), "purchase": (0.0, 1.0, True)}, {"click": 10.0, "view": 12.0, "purchase": 0.5})),
    "st10_throttle": ("", mc.throttled(36_000_000)),
    "st11_recording": ("markers", mc.recording()),
    "st12_calibration_hold": ("calibration", mc.calibration_hold()),
}
_O = "OVER (PARTITION BY entity_id ORDER BY ts_ms, seq)"
_N = f"n AS (SELECT *, row_number() {_O} AS i FROM r)"
#: What machines without a batch twin give, said in SQL by windows or by recursion over each entity's rows.
SQL = {
    "st1_settle_gate": f"""WITH {READINGS}, n AS (SELECT *, value > 60 AS motion, seq % 17 = 0 OR seq % 19 = 0 AS result, row_number() {_O} AS i FROM r),
a AS (SELECT *, count(*) FILTER (result) {_O} AS g FROM n),
b AS (SELECT *, max(CASE WHEN motion AND NOT result THEN i END) OVER w AS m, min(CASE WHEN motion AND NOT result THEN i END) OVER w AS f FROM a WINDOW w AS (PARTITION BY entity_id, g ORDER BY i)),
c AS (SELECT *, max(CASE WHEN i > f AND NOT motion AND NOT result THEN i END) OVER (PARTITION BY entity_id, g ORDER BY i) AS still FROM b),
d AS (SELECT *, CASE WHEN first_value(still) OVER w IS NOT NULL THEN first_value(ts_ms) OVER w ELSE min(CASE WHEN i > m THEN ts_ms END) OVER (PARTITION BY entity_id, g, m) END AS since FROM c WINDOW w AS (PARTITION BY entity_id, g, m ORDER BY i)),
e AS (SELECT *, min(CASE WHEN i > m AND ts_ms - since >= 40000000 THEN i END) OVER (PARTITION BY entity_id, g, m) AS hit FROM d),
h AS (SELECT *, max(CASE WHEN i = hit THEN ts_ms - since END) OVER (PARTITION BY entity_id, g, m) AS long FROM e)
SELECT entity_id, seq, CASE WHEN m IS NULL THEN 'holding_last_good' WHEN i >= hit THEN 'sampling_snapshots' ELSE 'settling' END AS state, coalesce(i = hit, false) AS should_sample,
  CASE WHEN m IS NULL OR i = m THEN 0 WHEN i >= hit THEN long ELSE ts_ms - since END AS stable_for_ms FROM h""",
    "st5_sample_collector": f"""WITH {READINGS}, n AS (SELECT *, ['empty','one_card','three_cards','other'][seq % 4 + 1] AS scenario, confidence > 0.1 AS passed, row_number() {_O} AS i FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, scenario ORDER BY i) AS k FROM n),
c AS (SELECT *, bool_and(passed) FILTER (k <= 3) OVER (PARTITION BY entity_id, scenario ORDER BY i) AS good, count(*) FILTER (scenario = 'empty') {_O} AS n1, count(*) FILTER (scenario = 'one_card') {_O} AS n2, count(*) FILTER (scenario = 'three_cards') {_O} AS n3 FROM k)
SELECT entity_id, seq, scenario, scenario <> 'other' AND k <= 3 AS kept, CASE WHEN scenario <> 'other' THEN least(k, 3) || '/3' END AS progress, scenario <> 'other' AND least(n1, n2, n3) >= 3 AS ready,
  CASE WHEN scenario = 'other' THEN 'unknown_scenario' WHEN k < 3 THEN 'COLLECTING' WHEN good THEN 'PASS' ELSE 'FAIL' END AS stage FROM c""",
    "st11_recording": f"""WITH {READINGS}, n AS (SELECT *, CASE WHEN seq % 9 = 0 THEN 'start' WHEN seq % 10 = 3 THEN 'stop' ELSE item_id END AS marker, row_number() {_O} AS i FROM r),
b AS (SELECT *, max(CASE WHEN marker = 'start' THEN i END) {_O} AS s FROM n),
c AS (SELECT *, first_value(ts_ms) OVER (PARTITION BY entity_id, s ORDER BY i) AS begin_ms, min(CASE WHEN marker = 'stop' THEN i END) OVER (PARTITION BY entity_id, s) AS e, i - s + 1 AS k FROM b WHERE s IS NOT NULL)
SELECT entity_id, seq, begin_ms, ts_ms - begin_ms AS offset_ms, marker, CASE WHEN k > 500 THEN 'too_many_markers' END AS error, CASE WHEN marker = 'stop' THEN least(k, 500) END AS n FROM c WHERE e IS NULL OR i <= e""",
    "st12_calibration_hold": f"""WITH RECURSIVE {READINGS}, n AS (SELECT entity_id, seq, value, confidence > 0.2 AS valid, floor(confidence * 1.01) AS params, row_number() {_O} AS i FROM r),
c(entity_id, i, seq, age, params, detected, held) AS (SELECT entity_id, i, seq, 1, params, true, CASE WHEN valid THEN value END FROM n WHERE i = 1
  UNION ALL SELECT n.entity_id, n.i, n.seq, CASE WHEN d THEN 1 ELSE age + 1 END, n.params, d, CASE WHEN d AND valid THEN value ELSE held END
  FROM (SELECT n.*, c.age, c.held, c.age >= 30 OR n.params IS DISTINCT FROM c.params AS d FROM c JOIN n ON n.entity_id = c.entity_id AND n.i = c.i + 1) n)
SELECT entity_id, seq, detected, held FROM c""",
    "st3_snapshot_session": f"""WITH RECURSIVE {READINGS}, n AS (SELECT entity_id, seq, ['start','capture','set','commit','set','discard','clear','end','set'][seq % 9 + 1] AS x, row_number() {_O} AS i FROM r),
c(entity_id, i, seq, command, error, act, locked, ref, now, previous) AS (SELECT DISTINCT entity_id, 0::BIGINT, 0::BIGINT, '', NULL::VARCHAR, false, false, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM n
  UNION ALL SELECT entity_id, i, seq, x, CASE WHEN x = 'capture' AND NOT act OR x = 'set' AND NOT act THEN 'session_not_active' WHEN x = 'clear' AND act AND locked THEN 'reference_locked' WHEN x = 'set' AND ref IS NULL THEN 'reference_required' WHEN x = 'commit' AND now IS NULL THEN 'current_missing' END,
  CASE x WHEN 'start' THEN true WHEN 'end' THEN false ELSE act END, CASE WHEN x = 'end' OR wipe THEN false WHEN take THEN true ELSE locked END, CASE WHEN wipe THEN NULL WHEN take THEN seq ELSE ref END,
  CASE WHEN x IN ('start', 'end', 'discard', 'commit') OR wipe OR take THEN NULL WHEN x = 'set' AND act AND ref IS NOT NULL THEN seq ELSE now END, CASE WHEN wipe THEN NULL WHEN take THEN seq WHEN x = 'commit' AND now IS NOT NULL THEN now ELSE previous END
  FROM (SELECT n.*, act, locked, ref, now, previous, x = 'capture' AND act AS take, x = 'clear' AND NOT (act AND locked) AS wipe FROM c JOIN n ON n.entity_id = c.entity_id AND n.i = c.i + 1))
SELECT entity_id, seq, command, error, act AND ref IS NOT NULL AND previous IS NOT NULL AND now IS NOT NULL AS ready, previous FROM c WHERE i > 0""",
    "st4_table_state": f"""WITH RECURSIVE {READINGS}, n AS (SELECT entity_id, seq, ['upsert','upsert','reverify','upsert','remove_box','correct','reverify_box','remove'][seq % 8 + 1] AS op, list_position(['click','purchase','signup','view'], item_id) AS k, row_number() {_O} AS i FROM r),
c(entity_id, i, seq, error, t, b, v) AS (SELECT DISTINCT entity_id, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, []::INTEGER[], [NULL, NULL, NULL, NULL]::BIGINT[], [false, false, false, false] FROM n
  UNION ALL SELECT entity_id, i, seq, CASE WHEN op = 'upsert' AND k IS NULL THEN 'unknown_id' END, t,
    list_transform([1, 2, 3, 4], lambda j: CASE WHEN op = 'upsert' AND j = k THEN seq WHEN op = 'correct' AND b[k] IS NOT NULL AND j = 4 THEN b[k] WHEN op = 'correct' AND j = k THEN NULL WHEN op IN ('remove', 'remove_box') AND list_contains(t, j) THEN NULL ELSE b[j] END),
    list_transform([1, 2, 3, 4], lambda j: CASE WHEN op = 'upsert' AND j = k THEN false WHEN op = 'correct' AND b[k] IS NOT NULL AND j = 4 THEN v[k] WHEN op IN ('reverify', 'reverify_box') AND list_contains(t, j) THEN true ELSE v[j] END)
  FROM (SELECT *, CASE WHEN op = 'upsert' THEN CASE WHEN k IS NULL THEN [] ELSE [k] END WHEN op = 'correct' THEN CASE WHEN b[k] IS NULL THEN [] ELSE [4] END ELSE list_filter([1, 2, 3, 4], lambda j: b[j] IS NOT NULL AND CASE WHEN op IN ('reverify', 'remove') THEN j = k ELSE
      11 * greatest(0, 30 - abs(b[j] % 60 - seq % 60)) * greatest(0, 40 - abs(b[j] % 45 - seq % 45)) >= 2400 END) END AS t
    FROM (SELECT n.*, c.b, c.v FROM c JOIN n ON n.entity_id = c.entity_id AND n.i = c.i + 1)))
SELECT entity_id, seq, error, coalesce(array_to_string(list_transform(t, lambda j: ['click','purchase','signup','view'][j]), ','), '') AS touched, len(list_filter(b, lambda x: x IS NOT NULL))::INTEGER AS tracked,
  len(list_filter([1, 2, 3, 4], lambda j: b[j] IS NOT NULL AND v[j]))::INTEGER AS to_reverify FROM c WHERE i > 0""",
    "st9_parameter_session": f"""WITH RECURSIVE {READINGS}, n AS (SELECT entity_id, seq, value AS x, item_id, CASE WHEN seq % 13 = 0 THEN 'commit' WHEN seq % 11 = 0 THEN 'rollback' WHEN seq % 7 = 0 THEN 'save' WHEN seq % 17 = 0 THEN 'apply' ELSE 'update' END AS op, row_number() {_O} AS i FROM r),
m AS (SELECT *, op = 'update' AND CASE item_id WHEN 'click' THEN x BETWEEN 0 AND 60 WHEN 'view' THEN x BETWEEN 5 AND 80 WHEN 'purchase' THEN x BETWEEN 0 AND 1 ELSE false END AS ok FROM n),
c(entity_id, i, seq, error, a, b, d, sa, sb, sd, p, ka, kb, kd, f) AS (SELECT DISTINCT entity_id, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, 10::DOUBLE, 0.5::DOUBLE, 12::DOUBLE, 10::DOUBLE, 0.5::DOUBLE, 12::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR FROM m
  UNION ALL SELECT m.entity_id, m.i, m.seq, CASE WHEN op = 'update' AND NOT ok THEN CASE WHEN item_id IN ('click', 'view', 'purchase') THEN 'out_of_range' ELSE 'unknown_parameter' END WHEN op = 'apply' AND ka IS NULL THEN 'unknown_profile' END,
    CASE WHEN ok AND item_id = 'click' THEN x WHEN op = 'rollback' THEN sa WHEN op = 'apply' THEN coalesce(ka, a) ELSE a END, CASE WHEN ok AND item_id = 'purchase' THEN x WHEN op = 'rollback' THEN sb WHEN op = 'apply' THEN coalesce(kb, b) ELSE b END, CASE WHEN ok AND item_id = 'view' THEN x WHEN op = 'rollback' THEN sd WHEN op = 'apply' THEN coalesce(kd, d) ELSE d END,
    CASE WHEN op = 'commit' THEN a WHEN op = 'apply' THEN coalesce(ka, sa) ELSE sa END, CASE WHEN op = 'commit' THEN b WHEN op = 'apply' THEN coalesce(kb, sb) ELSE sb END, CASE WHEN op = 'commit' THEN d WHEN op = 'apply' THEN coalesce(kd, sd) ELSE sd END,
    CASE WHEN ok AND item_id = 'view' THEN x WHEN op IN ('update', 'save') OR op = 'apply' AND ka IS NULL THEN p END,
    CASE WHEN op = 'save' THEN a ELSE ka END, CASE WHEN op = 'save' THEN b ELSE kb END, CASE WHEN op = 'save' THEN d ELSE kd END, CASE WHEN op = 'save' OR op = 'apply' AND ka IS NOT NULL THEN 'kept' ELSE f END
  FROM c JOIN m ON m.entity_id = c.entity_id AND m.i = c.i + 1)
SELECT entity_id, seq, error, '{{"click": ' || a || ', "purchase": ' || b || ', "view": ' || d || '}}' AS current, CASE WHEN p IS NULL THEN '{{}}' ELSE '{{"view": ' || p || '}}' END AS pending, f AS profile FROM c WHERE i > 0""",
    "st7_hysteresis": f"""WITH {READINGS}, p AS (SELECT entity_id, ts_ms, seq, confidence > 0.5 AS present FROM r), b AS (SELECT *, lag(present) OVER w AS was, max(ts_ms) OVER () AS ends FROM p WINDOW w AS (PARTITION BY entity_id ORDER BY ts_ms, seq)),
f AS (SELECT *, lead(ts_ms) OVER (PARTITION BY entity_id ORDER BY ts_ms, seq) AS upto FROM b WHERE present IS DISTINCT FROM was AND (present OR was IS NOT NULL)),
x AS (SELECT *, NOT present AND (upto IS NULL OR upto >= ts_ms + 20000000) AS off FROM f),
o AS (SELECT *, lag(off) OVER (PARTITION BY entity_id ORDER BY ts_ms, seq) AS before FROM x)
SELECT entity_id, ts_ms AS at_ms, 'on' AS switched FROM o WHERE present AND coalesce(before, true)
UNION ALL SELECT entity_id, ts_ms + 20000000, 'off' FROM o WHERE off AND (upto IS NOT NULL OR ts_ms + 20000000 <= ends)""",
}
#: The SQL of batch twins that have one.
TWINS = {"st2_identity": ("w4_identity_streak", ("seq", "state_id", "phase", "frames")), "st6_change_only": ("w6_change_only", ("seq", "entity_id", "item_id")), "st10_throttle": ("w16_throttle", ("entity_id", "seq"))}


def _stream_query(name, kind, machine, columns):
    def run_it(spark, sf):
        out = run.drain(mc.run_stream(inputs(reading_stream(spark, sf), kind), machine))
        return out.select(*columns) if columns else out

    return run_it


for _name, (_kind, _machine) in MACHINES.items():
    _twin, _columns = TWINS.get(_name, (None, None))
    query(_name, ENTRIES[_twin].sql if _twin else SQL.get(_name))(_stream_query(_name, _kind, _machine, _columns))


@query("st8_peak_level", ENTRIES["a17_peak_level"].sql)
def st8(spark, sf):
    """Peaks as the stream closes their windows, and those that its end leaves open."""
    level = {"value": F.col("value") / 1000, "ts": F.col("ts").cast("timestamp")}
    closed = run.drain(run.peak_levels(reading_stream(spark, sf).withColumns(level), width="1 day", late="1 hour"))
    rows = as_readings(table(spark, sf, "events")).withColumns(level)
    ends = rows.agg((F.max("ts") - F.expr("interval 1 hour")).alias("ends"))  # one row
    left = rows.crossJoin(F.broadcast(ends)).where(F.window("ts", "1 day")["end"] > F.col("ends"))
    return closed.unionByName(st.peak_levels(left, width="1 day")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st13_diff_loop", """WITH RECURSIVE y AS (SELECT year(o_orderdate) AS y, o_custkey AS key, sum(o_totalprice) AS value FROM orders GROUP BY ALL), b AS (SELECT key, quantile_cont(value, 0.5) AS base FROM y GROUP BY 1),
o AS (SELECT y, n, y || '.' || n AS id, NOT (y % 3 = 0 AND n = 1) AS stable, row_number() OVER (ORDER BY y, n) AS i FROM (SELECT DISTINCT y FROM y), (VALUES (1), (2)) AS t(n)), v AS (SELECT i, key, value FROM y JOIN o USING (y)), pc AS (SELECT a.i AS p, c.i AS c FROM o a JOIN o c ON a.i < c.i),
f AS (SELECT p, c, key, sum(value) FILTER (i = p) AS before, sum(value) FILTER (i = c) AS after FROM pc JOIN v ON i = p OR i = c GROUP BY ALL),
k AS (SELECT f.*, abs(coalesce(before, 0) - coalesce(after, 0)) > 300000 AS changed, CASE WHEN base IS NULL THEN 1.0 ELSE coalesce(before, 0) / base END >= 0.5 AS had, CASE WHEN base IS NULL THEN 1.0 ELSE coalesce(after, 0) / base END >= 0.5 AS has FROM f LEFT JOIN b USING (key)),
g AS (SELECT p, c, avg(changed::INT) >= 0.6 AS shifted, count(*) FILTER (changed) AS n, coalesce(list(key) FILTER (changed AND NOT had AND has), []) AS added, coalesce(list(key) FILTER (changed AND had AND NOT has), []) AS removed, coalesce(list(key) FILTER (changed AND had AND has), []) AS moved FROM k GROUP BY ALL),
z(i, committed, outcome, a, r, m, t, v) AS (SELECT 0::BIGINT, NULL::BIGINT, '', 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL SELECT i, CASE WHEN wait LIKE '%pair' THEN i WHEN wait IS NOT NULL OR shifted AND n > 0 THEN committed ELSE i END,
    CASE WHEN wait IS NOT NULL THEN wait WHEN shifted AND n > 0 THEN 'resync_required' WHEN len(added) + len(removed) + len(moved) > 0 THEN 'state_updated' WHEN n > 0 THEN 'noise_or_lighting' ELSE 'no_state_change' END,
    CASE WHEN skip THEN 0 ELSE len(added) END, CASE WHEN skip THEN 0 ELSE len(removed) END, CASE WHEN skip OR len(added) > 0 THEN 0 ELSE len(moved) END,
    CASE WHEN skip THEN t ELSE list_distinct(list_concat(list_filter(t, lambda x: NOT list_contains(removed, x)), added)) END,
    CASE WHEN skip THEN v ELSE list_distinct(list_concat(list_filter(v, lambda x: NOT list_contains(removed, x) AND NOT list_contains(added, x)), CASE WHEN len(added) > 0 THEN [] ELSE list_filter(moved, lambda x: list_contains(t, x)) END)) END
  FROM (SELECT x.*, g.*, wait IS NOT NULL OR shifted AS skip FROM (SELECT o.i, z.committed, z.t, z.v, CASE WHEN o.id < '1993.1' THEN 'waiting_for_empty_reference' WHEN NOT o.stable THEN 'waiting_for_stable_frame' WHEN z.committed IS NULL THEN 'waiting_for_diff_pair' END AS wait FROM z JOIN o ON o.i = z.i + 1) x
    LEFT JOIN g ON g.p = x.committed AND g.c = x.i))
SELECT id AS snapshot_id, outcome, a AS added, r AS removed, m AS moved, len(t)::BIGINT AS tracked, len(v)::BIGINT AS to_reverify FROM z JOIN o USING (i)""")
def st13(spark, sf):
    """Each year's orders by customer, sampled twice; in every third year the first sample is not stable."""
    o = table(spark, sf, "orders")
    yearly = o.groupBy(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("key")).agg(F.sum("o_totalprice").alias("value"))
    twice = yearly.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).select(F.concat_ws(".", "year", "n").alias("snapshot_id"), "key", "value", (~((F.col("year") % 3 == 0) & (F.col("n") == 1))).alias("stable"))
    arrived = folder(spark, "snapshots")
    twice.write.parquet(arrived)
    base = stored(yearly.groupBy("key").agg(F.percentile("value", 0.5).alias("value")))
    loop = run.SnapshotLoop(spark, folder(spark, "snapshot-loop"), base, noise=300_000, threshold=0.5, shift_share=0.6, reference_at="1993.1")
    return run.diff_stream(spark.readStream.schema(twice.schema).parquet(arrived), loop)


@query("s14_change_feed")
def s14(spark, sf):
    """The changes that a consumer got, micro-batch by micro-batch."""
    to = folder(spark, "consumer")
    changes = mc.run_stream(reading_stream(spark, sf), mc.changes_only())
    run.change_feed(changes, lambda df, n: df.write.mode("overwrite").parquet(f"{to}/batch={n}"))  # a repeated batch replaces itself
    return spark.read.parquet(to).select("entity_id", "seq", "item_id")


ENTRIES["s14_change_feed"] = ENTRIES["s14_change_feed"]._replace(sql=ENTRIES["w6_change_only"].sql)
