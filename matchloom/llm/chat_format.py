"""Chat formatting in budgeted windows with a loss mask.

Prefix sums of turn tokens choose turn-aligned windows. Each window repeats the
conversation's system turn and a limited history before its own turns; the loss
mask covers assistant texts among a window's own turns only, so a repeated
target is never trained on twice.

Template: ``### Role:\\n`` + text + ``</turn>\\n``. Inside roles and texts the
characters ``\\``, ``#``, ``<`` and (in roles) ``:`` get a ``\\`` before them, so no
text can hold a control string and :func:`read_back` restores every turn.

A conversation of more tokens than ``segment_windows`` budgets is cut, by the
prefix sums, into segments of so many, which are spread over tasks; each takes
the turns before it along as history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable

SCHEMA = "conv_id long, segment long, window int, text string, n_tokens long, turns array<struct<role:string,start:int,stop:int,fresh:boolean>>, loss array<struct<start:int,stop:int>>"
#: Long conversations, and segment starts of them, up to which they are sent to all tasks instead of joined by a shuffle.
SENT = 200_000

_ESCAPE = re.compile(r"[\\#<]")
_ESCAPE_ROLE = re.compile(r"[\\#<:]")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_ESCAPE_ROLE if role else _ESCAPE).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its text begins and ends."""
    head = f"### {escape(role, role=True)}:\n"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n((?:[^\\<]|\\.)*)</turn>\n", re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


_TURN_FIELDS = "conv_id long, turn long, role string, text string, tokens long, at long, before long"


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of long conversations with ``at`` (place in the conversation, from
    0) and ``before`` (tokens of the turns before it). Turns are sorted over all
    tasks; a task counts on from what the ranges before its own have of the
    conversation that it begins in."""
    order = ["conv_id", "turn", "role", "text", "__tie"]
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = reliable(ranged.select("conv_id", "turn", "role", "text", "tokens"))
    held = ranged.groupBy("conv_id", F.spark_partition_id().alias("range")).agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = held.select("range", F.sum("n").over(earlier).alias("n"), F.sum("t").over(earlier).alias("t")).where("n is not null")
    carry = {r.range: (r.n, r.t) for r in carried.collect()}  # one conversation at most goes on into a range
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("tokens", pa.int64()), ("at", pa.int64()), ("before", pa.int64())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t = carry.get(TaskContext.get().partitionId(), (0, 0))
        last, begun = None, False
        for batch in batches:
            at, before = [], []
            for conv, tokens in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if begun and conv != last:
                    n, t = 0, 0
                last, begun = conv, True
                at.append(n)
                before.append(t)
                n, t = n + 1, t + tokens
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(before, pa.int64())], schema=schema)

    return ranged.mapInArrow(number, _TURN_FIELDS)


def _beside(df: DataFrame) -> tuple[DataFrame, Column]:
    """A small table to join with, its conversation under another name, and the condition; null ids meet."""
    df = df.withColumnRenamed("conv_id", "__conv")
    return F.broadcast(df) if df.count() <= SENT else df, F.col("conv_id").eqNullSafe(F.col("__conv"))


def spans(costs: list[int], first: int, budget: int, repeated) -> Iterator[tuple[int, int]]:
    """The windows' own turns, as ranges of a segment's turns: from prefix sums of
    their costs the furthest end that ``budget`` allows beside what is repeated."""
    sums, lo = np.concatenate([[0], np.cumsum(np.asarray(costs, np.int64))]), first
    while lo < len(costs):
        hi = int(np.searchsorted(sums, sums[lo] + budget - repeated(lo), "right")) - 1
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def format_conversations(conversations: DataFrame, *, budget: int = 1024, history: int = 2, segment_windows: int = 64, target: str = "assistant", system: str = "system") -> DataFrame:
    """Windows of every conversation (``SCHEMA``); ``turns`` gives each turn's
    role and span in ``text`` and whether it is the window's own (``fresh``).

    A turn has its words and one more token. A window takes its own turns while
    system turn, history and own turns stay within ``budget`` tokens; a turn larger
    than what is left opens a window of its own and may exceed the budget: turns
    are never cut or dropped. History is up to ``history`` preceding turns,
    nearest first, within a quarter of the budget. The system turn is the
    conversation's first of role ``system``; where it is among a window's own
    turns or its history, or comes later, it is not repeated. Turns are ordered
    by turn, then role and text; a null turn comes first; null roles and texts are
    empty; repeated rows are repeated turns. A null conv_id is one conversation.
    Other columns are not carried; an empty table gives no rows.
    """
    words = F.regexp_count(F.col("text"), F.lit(r"[^ \t\n\x0B\f\r]+"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", (words + 1).cast("long"))
    reach = segment_windows * budget
    long = reliable(rows.groupBy("conv_id").agg(F.sum("tokens").alias("all")).where(F.col("all") > reach).select("conv_id"))
    sent, same = _beside(long)
    short = rows.join(sent, same, "left_anti").select("conv_id", "turn", "role", "text", "tokens", F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("segment"), F.lit(2).alias("kind"))
    numbered = _numbered(rows.join(sent, same, "left_semi")).withColumns({"segment": F.floor(F.col("before") / reach), "kind": F.lit(2)}).drop("before")
    first = numbered.where(F.col("role") == system).groupBy("conv_id").agg(F.min("at").alias("lead"))
    starts = reliable(numbered.groupBy("conv_id", "segment").agg(F.min("at").alias("start")).where("segment > 0"))
    # Turns that a segment repeats: those just before it, and the system turn.
    wanted = starts.select("conv_id", F.col("segment").alias("into"), F.lit(1).alias("as"), F.explode(F.array(*(F.col("start") - k for k in range(1, history + 1)), F.lit(-1))).alias("place"))
    led, same = _beside(reliable(first))
    led = starts.join(led, same).where("lead < start").select("conv_id", F.col("segment").alias("into"), F.lit(0).alias("as"), F.col("lead").alias("place"))
    wanted = reliable(wanted.where("place >= 0").unionByName(led))
    near, same = _beside(wanted)
    repeats = numbered.drop("segment", "kind").join(near, same & (F.col("at") == F.col("place"))).select("conv_id", "turn", "role", "text", "tokens", "at", F.col("into").alias("segment"), F.col("as").alias("kind"))
    stream = short.unionByName(numbered).unionByName(repeats)
    order = ["conv_id", "segment", "kind", "at", "turn", "role", "text"]
    stream = stream.repartition("conv_id", "segment").sortWithinPartitions(*order).select(*order, "tokens")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        here, lead, turns, first_own = None, None, [], 0  # turns: history and own turns of one segment

        def flush() -> Iterator[dict]:
            if not turns:
                return
            conv, segment = here
            own_lead = next((i for i in range(first_own, len(turns)) if turns[i][0] == system), None) if lead is None else None

            def back(lo: int) -> int:
                """Where the history of a window from ``lo`` begins."""
                left, at = budget // 4, lo
                while at > 0 and lo - at < history and turns[at - 1][2] <= left:
                    at -= 1
                    left -= turns[at][2]
                return at

            def leads(lo: int) -> tuple | None:
                """The system turn, where the window from ``lo`` repeats it beside its history."""
                if lead is not None:
                    return lead if all(t[3] is None or t[3] != lead[3] for t in turns[back(lo) : lo]) else None
                return turns[own_lead] if own_lead is not None and own_lead < back(lo) else None

            cost = lambda lo: sum(t[2] for t in turns[back(lo) : lo]) + (leads(lo)[2] if leads(lo) else 0)
            for number, (lo, hi) in enumerate(spans([t[2] for t in turns], first_own, budget, cost)):
                parts = [(leads(lo), False)] * bool(leads(lo)) + [(t, False) for t in turns[back(lo) : lo]] + [(t, True) for t in turns[lo:hi]]
                text, marks, loss, at = [], [], [], 0
                for (role, body, _, _), fresh in parts:
                    piece, start, stop = render(role, body)
                    marks.append({"role": role, "start": at + start, "stop": at + stop, "fresh": fresh})
                    if fresh and role == target:
                        loss.append({"start": at + start, "stop": at + stop})
                    text.append(piece)
                    at += len(piece)
                yield {"conv_id": conv, "segment": segment, "window": number, "text": "".join(text), "n_tokens": sum(t[2] for t, _ in parts), "turns": marks, "loss": loss}

        for batch in batches:
            for conv, segment, kind, at, _, role, body, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (conv, segment):
                    out.extend(flush())
                    here, lead, turns, first_own = (conv, segment), None, [], 0
                if kind == 0:
                    lead = (role, body, tokens, at)
                else:
                    turns.append((role, body, tokens, at))
                    first_own += kind == 1
                if len(out) >= 64:
                    yield pa.RecordBatch.from_pylist(out, schema=ARROW)
                    out = []
        out.extend(flush())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return stream.mapInArrow(windows, SCHEMA)


_SPAN = [("start", pa.int32()), ("stop", pa.int32())]
ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), *_SPAN, ("fresh", pa.bool_())]))), ("loss", pa.list_(pa.struct(_SPAN)))])


def digest(windows: DataFrame) -> DataFrame:
    """What a reader of the windows recovers, per conversation: turns in order
    without the repeated ones, and the text under the loss mask. Windows are
    streamed in order; nothing of a conversation but running hashes is held."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, started, rows = None, False, []

        def done() -> None:
            rows.append({"conv_id": here, "n_turns": n, "turns_sha256": turns_hash.hexdigest(), "loss_chars": chars, "loss_sha256": loss_hash.hexdigest(), "formatted_chars": formatted})

        for batch in batches:
            for conv, text, turns, loss in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "turns", "loss")), strict=True):
                if not started or conv != here:
                    if started:
                        done()
                    here, started, n, chars, formatted, turns_hash, loss_hash = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                said = read_back(text)
                if len(said) != len(turns):
                    raise ValueError(f"conversation {conv}: {len(said)} turns read back, {len(turns)} written")
                for (role, body), span in zip(said, turns, strict=True):
                    if span["fresh"]:
                        n += 1
                        turns_hash.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    body = unescape(text[span["start"] : span["stop"]])
                    chars += len(body)
                    loss_hash.update(body.encode("utf-8", "surrogatepass"))
                formatted += len(text)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=DIGEST_ARROW)
                rows = []
        if started:
            done()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=DIGEST_ARROW)

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    return digest(format_conversations(given.unionByName(more)))


ORACLE_SQL = r"""
WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  1 + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS c,
  14 + length(role) + len(regexp_extract_all(role, '[\\#<:]')) + length(text) + len(regexp_extract_all(text, '[\\#<]')) AS f FROM g),
p AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY i) - c AS before FROM n),
l AS (SELECT conv_id, count(*) AS n, list(c ORDER BY i) AS c, list(f ORDER BY i) AS f, list(before ORDER BY i) AS b,
  list(before // 65536 ORDER BY i) AS seg, min(i) FILTER (role = 'system') AS y, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256
  FROM p GROUP BY conv_id),
w(conv_id, s, e) AS (SELECT conv_id, 0::BIGINT, 0::BIGINT FROM l
  UNION ALL SELECT conv_id, lo, greatest(lo, coalesce(list_max(list_filter(range(lo, n + 1), lambda k: b[k] + c[k] - b[lo] + rep <= 1024 AND seg[k] = seg[lo])), lo))
  FROM (SELECT *, (SELECT coalesce(sum(x), 0) FROM (SELECT unnest(c[lo - h:lo - 1]) AS x)) + CASE WHEN y < lo - h THEN c[y] ELSE 0 END AS rep
    FROM (SELECT l.*, e + 1 AS lo, CASE WHEN e < 1 OR c[e] > 256 THEN 0 WHEN e < 2 OR c[e] + c[e - 1] > 256 THEN 1 ELSE 2 END AS h FROM w JOIN l ON w.conv_id IS NOT DISTINCT FROM l.conv_id WHERE e < n))),
v AS (SELECT l.conv_id, list_sum(f[s - h:e]) + CASE WHEN y < s - h THEN f[y] ELSE 0 END AS chars
  FROM (SELECT w.*, CASE WHEN s < 2 OR l.c[s - 1] > 256 THEN 0 WHEN s < 3 OR l.c[s - 1] + l.c[s - 2] > 256 THEN 1 ELSE 2 END AS h, l.c, l.f, l.y FROM w JOIN l ON w.conv_id IS NOT DISTINCT FROM l.conv_id WHERE s > 0) l)
SELECT l.conv_id, n::BIGINT AS n_turns, turns_sha256, loss_chars::BIGINT AS loss_chars, loss_sha256,
  (SELECT sum(chars) FROM v WHERE v.conv_id IS NOT DISTINCT FROM l.conv_id)::BIGINT AS formatted_chars FROM l
"""
