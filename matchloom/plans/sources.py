"""Registered queries of sources and sinks: each writes what the given tables
hold to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import tables as tb
from ..session import reliable, shared_dir
from ..sources import files as fs
from .catalog import query
from .tables import PREDICTIONS, READINGS, predictions, readings, table


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4()}"


@query("s1_telemetry", f"WITH {READINGS} SELECT item_id, count(*) AS n, count(*) FILTER (confidence > 0.5) AS detected, round(sum(value), 4) AS value FROM r GROUP BY 1")
def s1(spark, sf):
    to = _folder(spark)
    card = F.struct(F.col("item_id").alias("name"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("angle"), F.col("confidence").alias("confidence"))
    lines = readings(spark, sf).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), (F.col("confidence") > 0.5).alias("detected"), F.lit(1).alias("card_count"), F.array(card).alias("cards"), F.create_map(F.lit("value"), F.col("value")).alias("metrics"), F.create_map(F.lit("item"), F.col("item_id")).alias("runtime"))
    fs.write_telemetry(lines.where("detected"), to, reset=True)
    fs.write_telemetry(lines.where("not detected"), to)
    back = fs.read_telemetry(spark, to)
    return back.groupBy(F.col("runtime")["item"].alias("item_id")).agg(F.count("*").alias("n"), F.count_if("detected").alias("detected"), F.round(F.sum(F.col("metrics")["value"]), 4).alias("value"))


@query("s3_catalogue", """WITH n AS (SELECT n_name AS deck_id, lower(substr(n_name, 1, 3)) AS prefix, n_regionkey + 2 AS k FROM nation WHERE n_regionkey IN (1, 3)) SELECT deck_id, prefix, unnest(range(0, k))::INTEGER AS item_no, prefix || '_' || lpad(unnest(range(0, k))::VARCHAR, 2, '0') AS item_id FROM n""")
def s3(spark, sf):
    to = _folder(spark)
    deck = F.struct(F.col("n_name").alias("id"), F.lower(F.substring("n_name", 1, 3)).alias("prefix"), (F.col("n_regionkey") + 2).alias("card_count"))
    table(spark, sf, "nation").select(F.array(deck).alias("decks")).write.json(to)
    active = table(spark, sf, "nation").where("n_regionkey in (1, 3)").select(F.col("n_name").alias("deck_id"))
    return fs.read_catalogue(spark, to, active, lines=True)


@query("s4_matrix_csv", f"WITH {PREDICTIONS} SELECT method, category, count(*) AS n, count(*) FILTER (is_known) AS known, count(*) FILTER (top1_correct) AS correct, round(sum(runtime_ms), 4) AS runtime_ms FROM p GROUP BY ALL")
def s4(spark, sf):
    to = _folder(spark)
    fs.write_matrix(predictions(spark, sf), to)
    return fs.read_matrix(spark, to).groupBy("method", "category").agg(F.count("*").alias("n"), F.count_if("is_known").alias("known"), F.count_if("top1_correct").alias("correct"), F.round(F.sum("runtime_ms"), 4).alias("runtime_ms"))


@query("s5_report", "SELECT event_type, count(*) OVER (PARTITION BY event_type) AS n, event_id, value FROM events")
def s5(spark, sf):
    to = _folder(spark)
    e = table(spark, sf, "events")
    fs.write_report(e.groupBy("event_type").agg(F.count("*").alias("n")), e.select("event_type", "event_id", "value"), to, "event_type")
    back = spark.read.schema("event_type string, n long, rows array<struct<event_id:long,value:double>>").json(to)
    return back.select("event_type", "n", F.explode("rows").alias("r")).select("event_type", "n", "r.event_id", "r.value")


@query("s6_file_tree", "SELECT DISTINCT 'priority=' || o_orderpriority AS deck, 'status=' || o_orderstatus AS mat FROM orders")
def s6(spark, sf):
    to = _folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    o.write.partitionBy("priority", "status").json(to)
    tree = fs.file_tree(spark, to, ("deck", "mat")).where("file like 'part-%' and length > 0")
    return tree.select(F.url_decode("deck").alias("deck"), F.url_decode("mat").alias("mat")).distinct()


@query("s7_timings_csv", f"WITH {READINGS} SELECT count(*) AS n, count(*) FILTER (confidence > 0.5) AS found, round(sum(value), 4) AS match_ms, max(seq) AS last FROM r")
def s7(spark, sf):
    to = _folder(spark)
    r = readings(spark, sf)
    given = r.select(F.col("seq").alias("frame"), (F.col("ts_ms") / 1000).alias("timestamp_sec"), F.lit(1.0).alias("decode_ms"), F.col("value").alias("match_ms"), (F.col("value") + 1).alias("total_ms"), F.lit(2).alias("candidates"), (F.col("confidence") > 0.5).alias("found"))
    given.write.option("header", True).csv(to)
    return fs.read_timings(spark, to).agg(F.count("*").alias("n"), F.count_if("found").alias("found"), F.round(F.sum("match_ms"), 4).alias("match_ms"), F.max("frame").alias("last"))


@query("s8_fixture", "SELECT s_suppkey::VARCHAR AS sample_id, 'n' || s_nationkey AS category, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS expected_id, CASE WHEN s_suppkey % 3 > 0 THEN 'upright' END AS orientation FROM supplier")
def s8(spark, sf):
    to = _folder(spark)
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    label = F.struct(key.alias("k"), F.struct(F.col("s_name").alias("expected_id"), F.lit("upright").alias("orientation")).alias("v"))
    sample = F.struct(key.alias("sample_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("category"))
    s = s.withColumn("document", F.floor(F.col("s_suppkey") / 100))
    docs = s.groupBy("document").agg(F.collect_list(sample).alias("samples"), F.map_from_entries(F.collect_list(F.when(F.col("s_suppkey") % 3 > 0, label))).alias("labels"))
    docs.drop("document").write.json(to)
    return fs.read_fixture(spark, to, lines=True).select("sample_id", "category", "expected_id", "orientation")


@query("s10_session_log", "SELECT 'u' || user_id % 5 AS scenario, event_type AS event, event_id, value FROM events")
def s10(spark, sf):
    to = _folder(spark)
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("scenario"), F.col("event_type").alias("event"), "event_id", "value")
    fs.append_session_log(e.where("event_id % 2 = 0"), to)
    fs.append_session_log(e.where("event_id % 2 = 1"), to)
    return spark.read.schema("event_id long, value double, scenario string, event string").json(to)


@query("s12_tree_fingerprint", "SELECT 'status=' || o_orderstatus AS folder, o_orderstatus <> 'P' AS unchanged FROM orders GROUP BY o_orderstatus")
def s12(spark, sf):
    """A folder tree, of which one folder gets more files, and whose fingerprints stay."""
    to = _folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    o.write.partitionBy("status").json(to)
    clean = lambda df: reliable(df.where("folder like 'status=%'"))
    before = clean(fs.tree_fingerprint(spark, to))
    o.where("status = 'P'").write.partitionBy("status").mode("append").json(to)
    after = clean(fs.tree_fingerprint(spark, to))
    return before.join(after.withColumnsRenamed({"digest": "again", "files": "f"}), "folder").select("folder", (F.col("digest") == F.col("again")).alias("unchanged"))


RAW = """CASE event_id % 8 WHEN 0 THEN '{"type":"tuning_update","param":"p","value":' || event_id || '}' WHEN 1 THEN '{"type":"studio_set_audio_volume","channel":"mic","volume":' || (event_id % 30) / 20.0 || '}' WHEN 2 THEN 'not json' WHEN 3 THEN '{"type":"unheard_of"}'
 WHEN 4 THEN '{"type":"autotune_save","name":"' || CASE WHEN event_id % 3 = 0 THEN 'bad name' ELSE 'ok_1' END || '"}' WHEN 5 THEN '{"type":"studio_set_active_decks","active_decks":' || CASE WHEN event_id % 3 = 0 THEN '[]' ELSE '["a","b"]' END || '}'
 WHEN 6 THEN '{"type":"profile_save"}' ELSE '{"type":"studio_save_timeline","recording_id":"r","markers":[{"timestamp_ms":' || (event_id % 50 - 10) || ',"type":"operator_marker"}]}' END"""


@query("s13_control_messages", """SELECT event_id, coalesce(code, 'VALID') AS outcome FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN event_id % 30 / 20.0 > 1 THEN 'OUT_OF_RANGE' END WHEN 2 THEN 'INVALID_JSON' WHEN 3 THEN 'UNSUPPORTED_TYPE' WHEN 4 THEN CASE WHEN event_id % 3 = 0 THEN 'INVALID_NAME' END
 WHEN 5 THEN CASE WHEN event_id % 3 = 0 THEN 'INVALID_LIST' END WHEN 6 THEN 'MISSING_FIELD' ELSE CASE WHEN event_id % 50 < 10 THEN 'INVALID_MARKER' END END AS code FROM events)""")
def s13(spark, sf):
    valid, rejected = fs.parse_messages(table(spark, sf, "events").select("event_id", F.expr(RAW).alias("raw")))
    return rejected.select("event_id", F.col("error_code").alias("outcome")).unionByName(valid.select("event_id", F.lit("VALID").alias("outcome")))


@query("s15_review_index", f"""WITH {PREDICTIONS}, e AS (SELECT DISTINCT sample_id, unnest([{{'d': 'category', 'v': category}}, {{'d': 'orientation', 'v': orientation}}]) AS x FROM p WHERE NOT accepted AND confidence_gap > 0.07)
SELECT DISTINCT x.d AS dimension, x.v AS value, sample_id FROM e""")
def s15(spark, sf):
    rows = predictions(spark, sf).where(~F.col("accepted") & (F.col("confidence_gap") > 0.07))
    broken = tb.violations(("UNKNOWN_METHOD", rows.where("method is null"), "sample_id"))
    return fs.review_index(rows, broken, ("category", "orientation"))
