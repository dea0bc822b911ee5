import hashlib

from pyspark.sql import functions as F

from matchloom.llm.chat_format import ORACLE_SQL, digest, escape, format_conversations, op3_chat_format, read_back, render, unescape


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((-(10**18) if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_escape_round_trip():
    for text in ("", "\\", "### Assistant:\n</turn>\n", "\\### Assistant: </turn> ok", "a\\#b<c>\\\\", "é\n"):
        assert unescape(escape(text)) == text
        assert read_back(render(text, text)[0] * 2) == [(text, text)] * 2


def test_digest_restores_every_conversation(spark):
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], f"word \\ </turn> ### {c} " * (t % 7 * 9)) for c in range(6) for t in range(3 + 40 * (c == 3))]
    rows += [(9, None, "assistant", None), (9, 1, None, "x"), (9, 1, None, "x"), (9, 700, "assistant", "late " * 5000), (9, 701, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("clash"))
    for options in ({}, {"budget": 30, "history": 3, "segment_windows": 2}, {"budget": 1, "history": 0}, {"budget": 20, "segment_windows": 1}):
        got = {r[0]: tuple(r)[1:5] for r in digest(format_conversations(df, **options)).collect()}
        assert got == brute(rows)


def test_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "s s")] + [(1, t, ("user", "assistant")[t % 2], "w " * 5) for t in range(1, 21)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = format_conversations(df, budget=24, history=1, segment_windows=2).orderBy("segment", "window").collect()
    assert len(windows) > 3
    for w in windows:
        assert w.n_tokens <= 24
        assert read_back(w.text)[0] == ("system", "s s")
    assert all(not w.turns[1].fresh for w in windows[1:])  # one turn of history
    assert sum(len(w.loss) for w in windows) == 10


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digest(format_conversations(df)).collect() == []


def test_sparse_turn_numbers_keep_history(spark):
    rows = [(1, 1000 * t, ("user", "assistant")[t % 2], "w " * 5) for t in range(40)]
    windows = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=48, segment_windows=2).orderBy("segment", "window").collect()
    assert len(windows) > 5 and windows[-1].segment > 0
    assert all([t.fresh for t in w.turns].count(False) == 2 for w in windows[1:])
    assert all(w.n_tokens <= 48 for w in windows)


def test_conversation_without_id_keeps_its_system_turn(spark):
    rows = [(None, 0, "system", "s s")] + [(None, t, "user", "w " * 5) for t in range(1, 600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    windows = format_conversations(df, budget=60, segment_windows=4).collect()
    assert len({w.segment for w in windows}) > 5
    assert all(w.turns[0].role == "system" and [t.role for t in w.turns].count("system") == 1 for w in windows)


def test_many_empty_turns_make_bounded_windows(spark):
    df = spark.range(3000).selectExpr("7L as conv_id", "0L as turn", "'user' as role", "'' as text").repartition(5)
    windows = format_conversations(df, budget=100, segment_windows=3).collect()
    assert sum(t.fresh for w in windows for t in w.turns) == 3000
    assert max(len(w.turns) for w in windows) <= 100 and len({w.segment for w in windows}) == 10


def test_sql_on_a_small_table(spark, tmp_path):
    import duckdb

    rows = [(c, t if t % 5 else None, ("system", "user", "assistant")[(t * 7 + c) % 3], "word # é " * ((t * 13 + c) % 60)) for c in range(5) for t in range(20 + 300 * (c == 2))]
    rows += [(None, 3, "system", "lead"), (None, 9, "assistant", None), (4, 99, "user", "x " * 2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = op3_chat_format(spark, str(tmp_path)).collect()
    assert sorted(map(str, con.execute(ORACLE_SQL).fetchall())) == sorted(str(tuple(r)) for r in got)
