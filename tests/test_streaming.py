"""Every stream against its batch twin, over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from matchloom.plans import streams
from matchloom.streaming import machines as mc
from matchloom.streaming import run


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files in the order of time, shuffled inside."""
    to = tmp_path_factory.mktemp("events")
    rows = [(i, f"2024-01-01 00:00:00", (i * 7) % 3, ("click", "view", "purchase", "signup")[(i // 2) % 4], float((i * 53) % 130), f'{{"k": {(i * 29) % 100}}}') for i in range(180)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    df = df.withColumn("ts", (F.to_timestamp("t") + F.make_dt_interval(hours=(F.col("event_id") * 3).cast("int"))).cast("timestamp_ntz")).drop("t")
    for part in range(3):
        df.where(F.col("event_id").between(part * 60, part * 60 + 59)).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(f"{to}/events.parquet")
    return str(to)


@pytest.mark.parametrize("name", sorted(streams.MACHINES))
def test_stream_is_batch(spark, folder, name):
    kind, machine = streams.MACHINES[name]
    batch = mc.run_batch(streams.inputs(streams.as_readings(spark.read.parquet(f"{folder}/events.parquet")), kind), machine).collect()
    stream = run.table_stream(spark, folder, "events", files_at_once=1)
    got = run.drain(mc.run_stream(streams.inputs(streams.as_readings(stream), kind), machine)).collect()
    assert batch
    if machine.deadline:  # timers also fire for keys that have no later row
        assert set(batch) <= set(got) and len(got) - len(batch) <= 3
    else:
        assert sorted(map(str, got)) == sorted(map(str, batch))


def feed(machine, rows, names):
    from types import SimpleNamespace

    state, out = {}, []
    for i, values in enumerate(rows):
        out += machine.feed(state, SimpleNamespace(seq=i, **dict(zip(names, values, strict=True))))
    return out


def test_settle_gate_cases():
    gate = mc.settle_gate(3000)
    run_ = lambda rows: feed(gate, [(*r, None) if len(r) == 2 else r for r in rows], ("ts_ms", "motion", "outcome"))[-1][1:]
    assert run_([(1000, True)]) == ("settling", False, 0)
    assert run_([(1000, True), (2000, False), (3500, False), (5000, False)]) == ("sampling_snapshots", True, 3000)
    assert run_([(1000, True), (2500, False), (3000, True), (5000, False)]) == ("settling", False, 2000)
    again = mc.settle_gate(1000)
    rows = [(1000, True, None), (2000, False, None), (3000, False, None), (3100, False, "published"), (4000, True, None), (5000, False, None), (6000, False, None)]
    assert feed(again, rows, ("ts_ms", "motion", "outcome"))[-1][2] is True


def test_table_and_session_cases():
    table = mc.table_state(("fool", "magician"))
    ops = [("upsert", "fool", [100, 100, 80, 120], None), ("upsert", "magician", [260, 100, 80, 120], None), ("upsert", "sun", None, None), ("reverify_box", None, [110, 110, 60, 90], None), ("remove_box", None, [110, 110, 60, 90], None)]
    out = feed(table, [(0, *o) for o in ops], ("ts_ms", "op", "item_id", "box", "to_id"))
    assert [o[1:] for o in out] == [(None, "fool", 1, 0), (None, "magician", 2, 0), ("unknown_id", "", 2, 0), (None, "fool", 2, 1), (None, "fool", 1, 0)]
    session = feed(mc.snapshot_session(), [(0, c) for c in ("set", "start", "set", "capture", "clear", "set", "commit", "commit")], ("ts_ms", "command"))
    assert [s[2] for s in session] == ["session_not_active", None, "reference_required", None, "reference_locked", None, None, "current_missing"]
    assert [s[3] for s in session] == [False] * 5 + [True, False, False]


def test_hysteresis_switches_off_once():
    out = feed(mc.hysteresis(1500), [(0, True), (1000, False), (2000, True), (2500, False), (3000, False), (9000, False), (9500, True)], ("ts_ms", "present"))
    assert out == [(0, "on"), (4000, "off"), (9500, "on")]


def test_peaks_leave_open_windows_out(spark, folder):
    stream = run.table_stream(spark, folder, "events", files_at_once=1)
    got = run.drain(run.peak_levels(streams.as_readings(stream), width="1 day", late="1 hour"))
    whole = streams._batch.st.peak_levels(streams.as_readings(spark.read.parquet(f"{folder}/events.parquet")), width="1 day")
    seen, every = {tuple(r) for r in got.collect()}, {tuple(r) for r in whole.collect()}
    assert seen <= every and len(every) - len(seen) <= 6


def test_profiles_are_saved_and_applied():
    session = mc.parameter_session({"a": (0, 10, True), "b": (0, 10, False)}, {"a": 1.0, "b": 2.0}, {"given": {"a": 5, "b": 6}, "bad": {"a": 7, "b": 99}})
    ops = [("update", "b", 3), ("save", "mine", 0), ("update", "a", 9), ("apply", "mine", 0), ("apply", "given", 0), ("apply", "bad", 0), ("rollback", "", 0), ("apply", "none", 0), ("update", "c", 1)]
    out = [o[1:] for o in feed(session, [(0, *o) for o in ops], ("ts_ms", "op", "name", "value"))]
    values = lambda a, b: f'{{"a": {a}, "b": {b}}}'
    assert out == [
        (None, values(1.0, 3.0), '{"b": 3.0}', None), (None, values(1.0, 3.0), '{"b": 3.0}', "mine"), (None, values(9.0, 3.0), '{"b": 3.0}', "mine"), (None, values(1.0, 3.0), "{}", "mine"), (None, values(5.0, 6.0), "{}", "given"),
        ("out_of_range", values(7.0, 6.0), "{}", "given"), (None, values(5.0, 6.0), "{}", "given"), ("unknown_profile", values(5.0, 6.0), "{}", "given"), ("unknown_parameter", values(5.0, 6.0), "{}", "given"),
    ]


def test_a_million_rows_of_one_key_in_a_micro_batch(spark, tmp_path):
    """Rows come out in order, and the worker that merges them stays under 400 MB (they take over 1 GB as one frame's rows)."""
    n = 1_000_000
    ts = F.timestamp_seconds(F.lit(1.7e9) + (F.col("id") * 7919) % n).cast("timestamp_ntz").alias("ts")
    spark.range(0, n, 1, 1).select(F.col("id").alias("event_id"), ts, F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.rand(1).alias("value"), F.lit('{"k": 5}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")

    def step(s, r):
        import resource

        s["n"], s["wrong"], s["last"] = s.get("n", 0) + 1, s.get("wrong", 0) + (s.get("last", 0) > r.ts_ms), int(r.ts_ms)
        if s["n"] % 250_000 == 0:
            yield s["n"], s["wrong"], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024

    got = run.drain(mc.run_stream(streams.as_readings(run.table_stream(spark, str(tmp_path), "events")), mc.Machine("n long, wrong long, mb long", step))).collect()
    assert sorted((r.n, r.wrong) for r in got) == [(k * 250_000, 0) for k in range(1, 5)]
    assert max(r.mb for r in got) < 400


def test_runs_are_merged_in_order(spark, folder, monkeypatch):
    monkeypatch.setattr(mc, "CHUNK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch", 7)
    try:
        kind, machine = streams.MACHINES["st1_settle_gate"]
        batch = mc.run_batch(streams.inputs(streams.as_readings(spark.read.parquet(f"{folder}/events.parquet")), kind), machine).collect()
        got = run.drain(mc.run_stream(streams.inputs(streams.as_readings(run.table_stream(spark, folder, "events")), kind), machine)).collect()
        assert sorted(map(str, got)) == sorted(map(str, batch))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch")


def test_snapshot_loop_over_restarts(spark):
    """Every outcome, three runs of one stream, a micro-batch repeated and one run again after it was lost."""
    from matchloom import session

    values = [(10, 10, 0, 0), (10, 10, 0, 0), (10, 10, 0, 0), (10, 10, 0, 0), (10, 10, 10, 0), (10, 10, 10, 4), (0, 0, 0, 10), (10, 10, 0, 4), (15, 10, 0, 4)]
    rows = [(f"s{n}", key, float(v), n != 1) for n, snapshot in enumerate(values) for key, v in enumerate(snapshot)]
    want = [
        ("s0", "waiting_for_empty_reference", 0, 0, 0, 0, 0), ("s1", "waiting_for_stable_frame", 0, 0, 0, 0, 0), ("s2", "waiting_for_diff_pair", 0, 0, 0, 0, 0), ("s3", "no_state_change", 0, 0, 0, 0, 0), ("s4", "state_updated", 1, 0, 0, 1, 0),
        ("s5", "noise_or_lighting", 0, 0, 0, 1, 0), ("s6", "resync_required", 0, 0, 0, 1, 0), ("s7", "state_updated", 0, 1, 0, 0, 0), ("s8", "state_updated", 0, 0, 1, 0, 0),
    ]
    ddl = "snapshot_id string, key int, value double, stable boolean"
    with session.scratch():
        arrived, path = session.folder(spark, "arrived"), session.folder(spark, "loop")
        base = spark.createDataFrame([(k, 10.0) for k in range(4)], "key int, value double")
        made = lambda: run.SnapshotLoop(spark, path, base, noise=2, threshold=0.5, shift_share=0.8, reference_at="s1")
        for part in range(3):
            mine = spark.createDataFrame([r for r in rows if int(r[0][1:]) // 3 == part], ddl)
            mine.coalesce(1).write.mode("append").parquet(arrived)
            got = run.diff_stream(spark.readStream.schema(ddl).parquet(arrived), made())
        assert sorted(tuple(r) for r in got.collect()) == want
        loop = made()
        loop(mine, 1)  # has its manifest: nothing happens, whatever comes
        loop._files.delete(loop._fs_path(f"{path}/manifest/2"), True)
        loop(mine, 2)
        assert sorted(tuple(r) for r in loop.outcomes().collect()) == want
        with pytest.raises(RuntimeError):
            loop(mine, 9)
