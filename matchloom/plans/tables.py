"""Inputs of the registered queries: views of the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame_id, box_id, x, y, w, h, score``: line items as boxes in their order's frame."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    long = lambda c: c.cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), long(F.row_number().over(at)).alias("box_id"), long(F.col("l_partkey") % 40).alias("x"), long(F.col("l_suppkey") * 7 % 40).alias("y"),
        long(5 + F.floor("l_quantity")).alias("w"), long(10 + F.floor("l_extendedprice") % 30).alias("h"), F.col("l_discount").alias("score"),
    )


BOXES = """b AS (SELECT l_orderkey AS frame_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS box_id,
  (l_partkey % 40)::BIGINT AS x, (l_suppkey * 7 % 40)::BIGINT AS y, (5 + floor(l_quantity))::BIGINT AS w, (10 + floor(l_extendedprice)::BIGINT % 30)::BIGINT AS h, l_discount AS score FROM lineitem)"""

IOU_MACRO = """CASE WHEN {a}.w * {a}.h + {b}.w * {b}.h - {i} > 0 THEN ({i})::DOUBLE / ({a}.w * {a}.h + {b}.w * {b}.h - {i}) ELSE 0.0 END"""


def sql_intersection(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"


def sql_iou(a: str, b: str) -> str:
    return IOU_MACRO.format(a=a, b=b, i=sql_intersection(a, b))


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity_id, ts, ts_ms, seq, item_id, confidence, value``: events as keyed readings."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity_id"), "ts", epoch_ms("ts").alias("ts_ms"), F.col("event_id").alias("seq"), F.col("event_type").alias("item_id"),
        (F.get_json_object("props", "$.k").cast("int") / 99.0).alias("confidence"), "value",
    )


READINGS = """r AS (SELECT user_id AS entity_id, ts, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, event_type AS item_id,
  json_extract_string(props, '$.k')::INTEGER / 99.0::DOUBLE AS confidence, value FROM events)"""

METHODS = ("blocks", "codes", "fusion")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method x sample matrix: every line item judged by each method."""
    lines = table(spark, sf_dir, "lineitem")
    methods = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(i).alias("m")) for i, m in enumerate(METHODS)))
    per = lines.select("*", F.explode(methods).alias("by")).select("*", "by.method", "by.m")
    k = F.col("l_partkey") + F.col("l_suppkey") + F.col("m")
    right = k % 5 > 1
    return per.select(
        "method", F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("category"), F.when(F.col("l_linenumber") % 2 == 0, "upright").otherwise("reversed").alias("orientation"),
        (F.col("l_suppkey") % 4 > 0).alias("is_known"), F.col("l_linestatus").alias("expected_id"), F.when(right, F.col("l_linestatus")).otherwise("X").alias("predicted_id"),
        right.alias("top1_correct"), (k % 5 > 0).alias("top3_contains_expected"), F.col("l_discount").alias("confidence_score"), F.col("l_tax").alias("confidence_gap"),
        (F.col("l_discount") >= 0.05).alias("accepted"), ((F.col("l_discount") >= 0.05) & (F.col("l_suppkey") % 4 == 0)).alias("false_accept"), (F.col("l_quantity") * (F.col("m") + 1)).alias("runtime_ms"),
    )


PREDICTIONS = """p AS (SELECT method, l_orderkey AS sample_id, l_returnflag AS category, CASE WHEN l_linenumber % 2 = 0 THEN 'upright' ELSE 'reversed' END AS orientation,
  l_suppkey % 4 > 0 AS is_known, l_linestatus AS expected_id, CASE WHEN (l_partkey + l_suppkey + m) % 5 > 1 THEN l_linestatus ELSE 'X' END AS predicted_id,
  (l_partkey + l_suppkey + m) % 5 > 1 AS top1_correct, (l_partkey + l_suppkey + m) % 5 > 0 AS top3_contains_expected, l_discount AS confidence_score, l_tax AS confidence_gap,
  l_discount >= 0.05 AS accepted, l_discount >= 0.05 AND l_suppkey % 4 = 0 AS false_accept, l_quantity * (m + 1) AS runtime_ms
  FROM lineitem CROSS JOIN (VALUES ('blocks', 0), ('codes', 1), ('fusion', 2)) AS v(method, m))"""
