"""Sources and sinks: telemetry lines, catalogues, matrices, reports, file trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TELEMETRY = "timestamp string, detected boolean, card_count int, cards array<struct<name:string,x:double,y:double,angle:double,confidence:double>>, metrics map<string,double>, runtime map<string,string>"
MATRIX = ("method", "sample_id", "category", "is_known", "top1_correct", "confidence_score", "runtime_ms")
MATRIX_SCHEMA = "method string, sample_id long, category string, is_known boolean, top1_correct boolean, confidence_score double, runtime_ms double"
TIMINGS = "frame long, timestamp_sec double, decode_ms double, match_ms double, total_ms double, candidates int, found boolean"


def write_telemetry(df: DataFrame, path: str, *, reset: bool = False) -> None:
    """One JSON document per reading, appended; ``reset`` starts anew."""
    df.write.mode("overwrite" if reset else "append").json(path)


def read_telemetry(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(TELEMETRY).json(path)


def read_catalogue(spark: SparkSession, manifest: str, active: DataFrame, *, lines: bool = False) -> DataFrame:
    """``deck_id, prefix, item_no, item_id`` of the active decks of manifest
    documents: one a file, or with ``lines`` one a line."""
    schema = "decks array<struct<id:string,prefix:string,card_count:int>>"
    decks = spark.read.schema(schema).option("multiLine", not lines).json(manifest).select(F.explode("decks").alias("d"))
    decks = decks.select(F.col("d.id").alias("deck_id"), F.col("d.prefix").alias("prefix"), F.col("d.card_count").alias("n")).join(active.select("deck_id").distinct(), "deck_id", "left_semi")
    numbered = decks.where("n > 0").select("deck_id", "prefix", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("item_no"))
    return numbered.withColumn("item_id", F.concat("prefix", F.lit("_"), F.lpad(F.col("item_no").cast("string"), 2, "0")))


def write_matrix(df: DataFrame, path: str) -> None:
    """CSV with a header and the columns in their fixed order."""
    df.select(*MATRIX).write.mode("overwrite").option("header", True).csv(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATRIX_SCHEMA).option("header", True).csv(path)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMINGS).option("header", True).csv(path)


def write_report(summary: DataFrame, rows: DataFrame, path: str, key: str, *, per_document: int = 1000) -> None:
    """Documents of each summary row with its rows nested, about ``per_document``
    of them in each: ``key, part``, the summary's columns and ``rows``."""
    parts = rows.groupBy(key).agg(F.ceil(F.count("*") / per_document).alias("__parts"))
    inner = [c for c in rows.columns if c != key]
    dealt = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64(*inner), F.col("__parts")))
    nested = dealt.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct(*inner))).alias("rows"))
    summary.join(nested, key, "left").write.mode("overwrite").json(path)


def file_tree(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """Files under ``root`` with the last folders of their path as dimensions
    ``names``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    parts = F.split("path", "/")
    return files.select(*(F.element_at(parts, -2 - i).alias(n) for i, n in enumerate(reversed(names))), F.element_at(parts, -1).alias("file"), "length")


def tree_fingerprint(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """``folder, files, digest``: equal where every file's content is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    one = files.select(F.element_at(F.split("path", "/"), -1 - depth).alias("folder"), F.sha2("content", 256).alias("sha"))
    return one.groupBy("folder").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.sort_array(F.collect_list("sha")), ","), 256).alias("digest"))


def read_fixture(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Samples of fixture documents (one a file, or with ``lines`` one a line)
    joined with their maps of labels."""
    schema = "samples array<struct<sample_id:string,category:string>>, labels map<string,struct<expected_id:string,orientation:string>>"
    doc = spark.read.schema(schema).option("multiLine", not lines).json(path)
    samples = doc.select(F.explode("samples").alias("s")).select("s.*")
    labels = doc.select(F.explode("labels").alias("sample_id", "l")).select("sample_id", "l.*")
    return samples.join(labels, "sample_id", "left")


def append_session_log(events: DataFrame, path: str) -> None:
    """One immutable document per event, in folders by scenario and event."""
    events.write.mode("append").partitionBy("scenario", "event").json(path)


def review_index(decisions: DataFrame, found_violations: DataFrame, by: Sequence[str]) -> DataFrame:
    """``dimension, value, sample_id`` for review, each once; empty unless validation passed."""
    clean = found_violations.agg((F.count("*") == 0).alias("ok"))
    entries = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by))).alias("e")
    out = decisions.select("sample_id", entries).select("e.dimension", "e.value", "sample_id").distinct()
    return out.crossJoin(F.broadcast(clean)).where("ok").drop("ok")  # one row


#: Message types; those without further rules are listed last.
TYPES = ("tuning_update", "camera_set", "profile_save", "profile_apply", "autotune_start", "autotune_save", "studio_set_recording_dir", "studio_start_recording", "studio_update_recording_status", "studio_set_director_scene", "studio_set_audio_volume", "studio_set_audio_mute", "studio_update_audio_peak", "studio_set_director_mode", "studio_save_timeline", "studio_set_active_decks", "tuning_rollback", "camera_probe", "calibration_start", "calibration_cancel", "autotune_calibrate", "autotune_apply", "autotune_cancel", "background_capture", "background_clear", "session_start", "session_capture_empty_reference", "session_end", "session_resync_table", "studio_stop_recording")
#: Fields that a type must have.
REQUIRED = {
    "tuning_update": ("param", "value"), "camera_set": ("param", "value"), "profile_save": ("name",), "profile_apply": ("name",), "autotune_save": ("name",), "studio_set_recording_dir": ("path",), "studio_start_recording": ("recording_id",),
    "studio_update_recording_status": ("recording_id", "recording_state", "elapsed_ms", "dropped_frames"), "studio_set_director_scene": ("scene",), "studio_set_audio_volume": ("channel", "volume"), "studio_set_audio_mute": ("channel", "muted"),
    "studio_update_audio_peak": ("peak_db",), "studio_set_director_mode": ("mode",), "studio_save_timeline": ("recording_id", "markers"), "studio_set_active_decks": ("active_decks",),
}
#: Values that a field of a type may have.
ALLOWED = {("autotune_start", "scenario"): ("empty", "one_card", "three_cards"), ("studio_set_director_scene", "scene"): ("table", "wow", "portrait_pip", "title_card"), ("studio_set_audio_volume", "channel"): ("mic", "bgm", "sfx", "master"), ("studio_set_audio_mute", "channel"): ("mic", "bgm", "sfx", "master"), ("studio_set_director_mode", "mode"): ("manual", "auto")}
MARKER_TYPES = ("recording_started", "scene_changed", "card_revealed", "operator_marker", "recording_stopped")


def parse_messages(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Control messages as ``(valid, rejected)``: both with ``type`` and the
    fields as a map of JSON texts (``doc``), the rejected with ``error_code``,
    the first rule that fails."""
    parsed = df.withColumn("doc", F.from_json(raw, "map<string,string>"))
    field = lambda name: F.col("doc")[name]
    has = lambda name: F.coalesce(F.map_contains_key("doc", F.lit(name)), F.lit(False))
    kind = field("type")
    rules: list[tuple[str, Column]] = [("INVALID_JSON", F.col("doc").isNull() | (F.size("doc") <= 0)), ("UNSUPPORTED_TYPE", ~F.coalesce(kind.isin(*TYPES), F.lit(False)))]
    for name, fields in REQUIRED.items():
        rules.append(("MISSING_FIELD", (kind == name) & ~_all(has(f) for f in fields)))
    for (name, f), values in ALLOWED.items():
        rules.append(("INVALID_VALUE", (kind == name) & has(f) & ~F.coalesce(field(f).isin(*values), F.lit(False))))
    number = field("volume").try_cast("double")
    rules += [
        ("INVALID_NAME", (kind == "autotune_save") & ~F.coalesce(field("name").rlike("^[a-zA-Z0-9_-]+$"), F.lit(False))),
        ("INVALID_NUMBER", (kind == "studio_set_audio_volume") & number.isNull()),
        ("OUT_OF_RANGE", (kind == "studio_set_audio_volume") & ~number.between(0.0, 1.0)),
        ("INVALID_BOOLEAN", (kind == "studio_set_audio_mute") & ~F.coalesce(F.get_json_object(raw, "$.muted").isin("true", "false") & F.col(raw).rlike(r'"muted"\s*:\s*(true|false)'), F.lit(False))),
        ("INVALID_NUMBER", (kind == "studio_update_audio_peak") & field("peak_db").isNotNull() & field("peak_db").try_cast("double").isNull()),
        ("INVALID_LIST", (kind == "studio_set_active_decks") & ~F.coalesce(F.size(F.from_json(field("active_decks"), "array<string>")).between(1, 3), F.lit(False))),
        ("INVALID_LIST", (kind == "studio_save_timeline") & F.from_json(field("markers"), "array<string>").isNull()),
        ("TOO_MANY_MARKERS", (kind == "studio_save_timeline") & (F.size(F.from_json(field("markers"), "array<string>")) > 500)),
        ("INVALID_MARKER", (kind == "studio_save_timeline") & ~F.coalesce(F.forall(F.from_json(field("markers"), "array<map<string,string>>"), _good_marker), F.lit(False))),
    ]
    code = F.lit(None).cast(T.StringType())
    for name, fails in reversed(rules):
        code = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(code)
    judged = parsed.withColumns({"type": kind, "error_code": code})
    return judged.where("error_code is null").drop("error_code"), judged.where("error_code is not null")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _good_marker(m: Column) -> Column:
    offset = m["timestamp_ms"]
    scalar = F.forall(F.map_values(m), lambda v: v.isNull() | ~v.rlike(r"^\s*[\[{]"))
    return F.coalesce(offset.rlike(r"^\d+$") & m["type"].isin(*MARKER_TYPES) & scalar, F.lit(False))
