"""Keyed state machines over ordered readings.

A machine is a small step function. :func:`run_batch` replays it over each
key's ordered rows; :func:`run_stream` keeps its state between micro-batches in
the state store. On input in order both give the same rows.
"""

from __future__ import annotations

import heapq
import json
import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Row = Any
State = dict[str, Any]


class Machine(NamedTuple):
    """``step(state, row)`` changes the state and gives output rows (tuples of
    ``columns``); ``deadline(state)`` is the event time in ms at which
    ``expire(state, ms)`` is due, if any."""

    columns: str
    step: Callable[[State, Row], Iterable[tuple]]
    deadline: Callable[[State], int | None] | None = None
    expire: Callable[[State, int], Iterable[tuple]] | None = None

    def feed(self, state: State, row: Row) -> list[tuple]:
        out: list[tuple] = []
        if self.deadline and (due := self.deadline(state)) is not None and due <= row.ts_ms:
            out += self.expire(state, due)
        return out + list(self.step(state, row))

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.columns.split(", ")]


def run_batch(df: DataFrame, machine: Machine, *, key: str = "entity_id", order: tuple[str, ...] = ("ts_ms", "seq")) -> DataFrame:
    """Every key's rows in order past the machine. Sorted rows are streamed: of a
    key only its state is held, however many rows it has."""
    schema = f"{key} {dict(df.dtypes)[key]}, {machine.columns}"

    def replay(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        here: Any = None
        state: State | None = None
        for pdf in batches:
            rows: list[tuple] = []
            for row in pdf.itertuples(index=False):
                now = getattr(row, key)
                if state is None or (now != here and not (pd.isna(now) and pd.isna(here))):
                    here, state = now, {}
                rows += [(now, *out) for out in machine.feed(state, row)]
            yield pd.DataFrame(rows, columns=[key, *machine.names])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(replay, schema)


#: Rows of a chunk of the buffer: of each run one chunk is in memory while runs are merged.
CHUNK = 500


class Keyed(StatefulProcessor):
    """A machine over a stream: its state in a value state, its deadline as an event
    time timer. A micro-batch brings a key's rows frame by frame. One frame is put in
    order as it is; where more come, each becomes a sorted run of chunks in a map
    state, and the runs are merged, so that however many rows a key has there, one
    frame and a chunk of each run are in memory."""

    def __init__(self, machine: Machine, key: str, order: tuple[str, ...]):
        self.machine, self.key, self.order = machine, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.runs = handle.getMapState("runs", "run int, chunk int", "rows binary")
        if self.machine.deadline:
            self.timers = handle.getListState("timers", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out: list[tuple] = []
        for row in self._in_order(rows):
            out += [(key[0], *made) for made in self.machine.feed(state, row)]
            if len(out) >= 10_000:
                yield self._frame(out)
                out = []
        self._keep(state, timerValues)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state, out = json.loads(self.state.get()[0]) if self.state.exists() else {}, []
        self.timers.clear()
        if (due := self.machine.deadline(state)) is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
            out = [(key[0], *made) for made in self.machine.expire(state, due)]
        self._keep(state, timerValues)
        yield self._frame(out)

    def close(self) -> None:
        pass

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, *self.machine.names])

    def _keep(self, state: State, timer_values: Any) -> None:
        self.state.update((json.dumps(state),))
        if not self.machine.deadline:
            return
        for (ms,) in list(self.timers.get()):
            self.handle.deleteTimer(ms)
        self.timers.clear()
        if (due := self.machine.deadline(state)) is not None:
            due = max(due, timer_values.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
            self.timers.put([(due,)])

    def _in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[Row]:
        first = next(frames, None)
        if first is None:
            return
        second = next(frames, None)
        if second is None:
            yield from first.sort_values(list(self.order)).itertuples(index=False)
            return
        chunks = []
        for run, frame in enumerate(chain([first, second], frames)):
            frame = frame.sort_values(list(self.order))
            for chunk, lo in enumerate(range(0, len(frame), CHUNK)):
                self.runs.updateValue((run, chunk), (pickle.dumps(frame.iloc[lo : lo + CHUNK]),))
            chunks.append(-(-len(frame) // CHUNK))
        del first, second
        yield from heapq.merge(*(self._run(run, n) for run, n in enumerate(chunks)), key=lambda row: [(pd.isna(v), v) for v in (getattr(row, c) for c in self.order)])
        self.runs.clear()

    def _run(self, run: int, chunks: int) -> Iterator[Row]:
        for chunk in range(chunks):
            yield from pickle.loads(self.runs.getValue((run, chunk))[0]).itertuples(index=False)


def run_stream(df: DataFrame, machine: Machine, *, key: str = "entity_id", order: tuple[str, ...] = ("ts_ms", "seq"), watermark: tuple[str, str] = ("ts", "0 seconds")) -> DataFrame:
    """Rows behind the watermark are dropped by it; within a micro-batch a key's rows
    are put in order, however many there are (see ``Keyed``). The state store is
    RocksDB, which is set for the session's queries from here on."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(df.dtypes)[key]
    return df.withWatermark(*watermark).groupBy(key).transformWithStateInPandas(Keyed(machine, key, order), f"{key} {kind}, {machine.columns}", "Append", "EventTime")


#: Phases of the settle gate and the state each shows as; ``restless`` is motion after quiet had begun.
SHOWN = {"idle": "holding_last_good", "moving": "settling", "quiet": "settling", "restless": "settling", "sampled": "sampling_snapshots"}
#: Phase after an event; where none is given the phase stays.
AFTER = {
    "result": dict.fromkeys(SHOWN, "idle"),
    "motion": {"idle": "moving", "quiet": "restless", "sampled": "restless"},
    "still": {"moving": "quiet", "restless": "quiet"},
}


def settle_gate(settle_ms: int) -> Machine:
    """Samples are asked for once it has been quiet for ``settle_ms``. Quiet time
    counts from the first still reading after motion, or from the motion itself
    where it broke a quiet time; a published or rejected result re-arms the gate."""

    def step(s: State, r: Row) -> Iterable[tuple]:
        event = "result" if getattr(r, "outcome", None) in ("published", "rejected") else "motion" if r.motion else "still"
        was, now = s.get("phase", "idle"), int(r.ts_ms)
        phase = AFTER[event].get(was, was)
        if phase == "restless" or (was, phase) == ("moving", "quiet"):
            s["since"] = now
        if event != "still":
            s["stable"] = 0
        elif phase == "quiet":
            s["stable"] = now - s["since"]
        ask = phase == "quiet" and s["stable"] >= settle_ms
        s["phase"] = "sampled" if ask else phase
        yield int(r.seq), SHOWN[s["phase"]], ask, s.get("stable", 0)

    return Machine("seq long, state string, should_sample boolean, stable_for_ms long", step)


def identity(confirm: int = 5, least: float = 0.8) -> Machine:
    def step(s: State, r: Row) -> Iterable[tuple]:
        if not r.confidence >= least:
            s.update(id=None, frames=0)
            yield int(r.seq), None, "empty", 0
            return
        s["frames"] = s.get("frames", 0) + 1 if s.get("id") == r.item_id else 1
        s["id"] = r.item_id
        yield int(r.seq), r.item_id, "confirmed" if s["frames"] >= confirm else "candidate", s["frames"]

    return Machine("seq long, state_id string, phase string, frames int", step)


def snapshot_session() -> Machine:
    """Commands start, capture, set, commit, discard, clear, end; an illegal one gives an error row."""

    def step(s: State, r: Row) -> Iterable[tuple]:
        on, ref, now, c, error = s.get("on", False), s.get("ref"), s.get("now"), r.command, None
        if c == "start":
            s.update(on=True, now=None)
        elif c == "end":
            s.update(on=False, locked=False, now=None)
        elif c == "capture":
            if not on:
                error = "session_not_active"
            else:
                s.update(ref=int(r.seq), previous=int(r.seq), now=None, locked=True)
        elif c == "clear":
            if on and s.get("locked"):
                error = "reference_locked"
            else:
                s.update(ref=None, previous=None, now=None, locked=False)
        elif c == "set":
            error = "session_not_active" if not on else "reference_required" if ref is None else None
            if not error:
                s["now"] = int(r.seq)
        elif c == "commit":
            if now is None:
                error = "current_missing"
            else:
                s.update(previous=now, now=None)
        elif c == "discard":
            s["now"] = None
        else:
            error = "unknown_command"
        ready = bool(s.get("on") and s.get("ref") is not None and s.get("previous") is not None and s.get("now") is not None)
        yield int(r.seq), c, error, ready, s.get("previous")

    return Machine("seq long, command string, error string, ready boolean, previous long", step)


def box_iou(a: list[int], b: list[int]) -> float:
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def table_state(known: tuple[str, ...], least: float = 0.10) -> Machine:
    """Tracked items of a table: upsert, reverify, remove, correct, and removal
    or marking by overlap with a box. Unknown ids are rejected."""

    def step(s: State, r: Row) -> Iterable[tuple]:
        items, error, touched = s.setdefault("items", {}), None, []
        box = [int(v) for v in r.box] if r.box is not None else None
        if r.op == "upsert":
            if r.item_id not in known:
                error = "unknown_id"
            else:
                items[r.item_id] = {"phase": "locked", "box": box}
                touched = [r.item_id]
        elif r.op == "correct":
            if r.to_id not in known:
                error = "unknown_id"
            elif r.item_id in items:
                items[r.to_id] = items.pop(r.item_id)
                touched = [r.to_id]
        elif r.op in ("reverify", "remove"):
            if r.item_id in items:
                touched = [r.item_id]
        elif r.op in ("reverify_box", "remove_box"):
            touched = [k for k, v in items.items() if v["box"] and box and box_iou(v["box"], box) >= least]
        else:
            error = "unknown_op"
        for k in touched:
            if r.op.startswith("reverify"):
                items[k]["phase"] = "needs_reverify"
            elif r.op.startswith("remove"):
                del items[k]
        yield int(r.seq), error, ",".join(sorted(touched)), len(items), sum(v["phase"] == "needs_reverify" for v in items.values())

    return Machine("seq long, error string, touched string, tracked int, to_reverify int", step)


def sample_collector(scenarios: tuple[str, ...], wanted: int = 3) -> Machine:
    """The first ``wanted`` samples of each scenario; more are ignored."""

    def step(s: State, r: Row) -> Iterable[tuple]:
        if r.scenario not in scenarios:
            yield int(r.seq), r.scenario, False, None, False, "unknown_scenario"
            return
        have = s.setdefault(r.scenario, [])
        kept = len(have) < wanted
        if kept:
            have.append(bool(r.passed))
        full = all(len(s.get(k, [])) >= wanted for k in scenarios)
        stage = "COLLECTING" if len(have) < wanted else "PASS" if all(have) else "FAIL"
        yield int(r.seq), r.scenario, kept, f"{len(have)}/{wanted}", full, stage

    return Machine("seq long, scenario string, kept boolean, progress string, ready boolean, stage string", step)


def changes_only(column: str = "item_id") -> Machine:
    def step(s: State, r: Row) -> Iterable[tuple]:
        value = getattr(r, column)
        if "last" not in s or s["last"] != value:
            s["last"] = value
            yield int(r.seq), value

    return Machine(f"seq long, {column} string", step)


def hysteresis(off_ms: int) -> Machine:
    """On at once; off when ``off_ms`` pass without presence."""

    def step(s: State, r: Row) -> Iterable[tuple]:
        if r.present:
            s["absent_since"] = None
            if not s.get("on"):
                s["on"] = True
                yield int(r.ts_ms), "on"
        elif s.get("on") and s.get("absent_since") is None:
            s["absent_since"] = int(r.ts_ms)

    def deadline(s: State) -> int | None:
        return s["absent_since"] + off_ms if s.get("on") and s.get("absent_since") is not None else None

    def expire(s: State, ms: int) -> Iterable[tuple]:
        s.update(on=False, absent_since=None)
        return [(ms, "off")]

    return Machine("at_ms long, switched string", step, deadline, expire)


def parameter_session(ranges: dict[str, tuple[float, float, bool]], defaults: dict[str, float], profiles: dict[str, dict[str, float]] | None = None) -> Machine:
    """update, commit, rollback, save, apply: current, stable and pending values.

    ``save`` keeps the current values as the profile ``name``; ``apply`` takes over a
    saved or given profile value by value and then commits. A value that its range
    forbids ends it with an error: those before it are current, nothing is
    committed. ``profile`` is the one last saved or applied."""

    def change(s: State, name: str, value: float) -> str | None:
        low, high, live = ranges.get(name, (1, 0, True))
        if not low <= value <= high:
            return "out_of_range" if name in ranges else "unknown_parameter"
        s["current"][name] = float(value)
        s["pending"].pop(name, None)
        if not live:
            s["pending"][name] = float(value)
        return None

    def commit(s: State) -> None:
        s.update(stable=dict(s["current"]), pending={})

    def step(s: State, r: Row) -> Iterable[tuple]:
        if not s:
            s.update(current=dict(defaults), stable=dict(defaults), pending={}, saved={}, profile=None)
        error = None
        if r.op == "update":
            error = change(s, r.name, r.value)
        elif r.op == "commit":
            commit(s)
        elif r.op == "rollback":
            s.update(current=dict(s["stable"]), pending={})
        elif r.op == "save":
            s["saved"][r.name] = dict(s["current"])
            s["profile"] = r.name
        elif r.op == "apply":
            values = s["saved"].get(r.name, (profiles or {}).get(r.name))
            if values is None:
                error = "unknown_profile"
            else:
                error = next((e for e in (change(s, k, v) for k, v in values.items()) if e), None)
                if not error:
                    commit(s)
                    s["profile"] = r.name
        yield int(r.seq), error, json.dumps(s["current"], sort_keys=True), json.dumps(s["pending"], sort_keys=True), s["profile"]

    return Machine("seq long, error string, current string, pending string, profile string", step)


def throttled(least_ms: int) -> Machine:
    def step(s: State, r: Row) -> Iterable[tuple]:
        if s.get("last") is None or int(r.ts_ms) - s["last"] >= least_ms:
            s["last"] = int(r.ts_ms)
            yield (int(r.seq),)

    return Machine("seq long", step)


def recording(most: int = 500) -> Machine:
    """Markers between start and stop: each is a row with its offset, the stop also
    with their number. Those beyond ``most`` are rows with an error."""

    def step(s: State, r: Row) -> Iterable[tuple]:
        if r.marker == "start":
            s.update(begin=int(r.ts_ms), n=0)
        if s.get("begin") is None:
            return
        s["n"] += 1
        done = r.marker == "stop"
        yield int(r.seq), s["begin"], int(r.ts_ms) - s["begin"], r.marker, "too_many_markers" if s["n"] > most else None, min(s["n"], most) if done else None
        if done:
            s["begin"] = None

    return Machine("seq long, begin_ms long, offset_ms long, marker string, error string, n long", step)


def calibration_hold(every: int = 30) -> Machine:
    """The last valid reading, taken anew on every ``every``-th row or when the parameters change."""

    def step(s: State, r: Row) -> Iterable[tuple]:
        due = s.get("age") is None or s["age"] >= every or s.get("params") != r.params
        s["age"] = 1 if due else s["age"] + 1
        s["params"] = r.params
        if due and r.valid:
            s["held"] = float(r.value)
        yield int(r.seq), due, s.get("held")

    return Machine("seq long, detected boolean, held double", step)
