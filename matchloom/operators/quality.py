"""Setup grading, profile scoring and parameter checks over sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as so

EXPECTED = {"empty": 0, "one_card": 1, "three_cards": 3}


def expected_count(scenario: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in EXPECTED.items():
        out = F.when(scenario == name, n).otherwise(out)
    return out


def check_parameters(given: DataFrame, params: DataFrame) -> DataFrame:
    """``given(name, value)`` with ``error``, ``applied`` and ``pending``. A value
    that is not live-safe is applied and marked pending as well."""
    joined = given.join(F.broadcast(params.select("name", "minimum", "maximum", "live_safe", F.lit(True).alias("known"))), "name", "left")
    ok = F.coalesce(F.col("known") & F.col("value").between(F.col("minimum"), F.col("maximum")), F.lit(False))
    error = so.first_rule([("unknown_parameter", F.col("known").isNull()), ("out_of_range", ~ok)])
    return joined.select(*given.columns, error.alias("error"), ok.alias("applied"), (ok & ~F.coalesce("live_safe", F.lit(False))).alias("pending"))


def usable_samples(samples: DataFrame) -> DataFrame:
    """Why a scenario's sample is no use, its false positives and mean confidence."""
    expected = expected_count(F.col("scenario"))
    reason = so.first_rule([("accepted_on_empty", (F.col("scenario") == "empty") & (F.col("accepted_count") != 0)), ("wrong_count", (F.col("scenario") != "empty") & (F.col("detected_count") != expected))])
    conf = F.coalesce("recognition_confidences", F.array().cast("array<double>"))
    mean = F.when(F.size(conf) > 0, F.aggregate(conf, F.lit(0.0), lambda s, v: s + v) / F.size(conf)).otherwise(0.0)
    return samples.withColumns({"reject_reason": reason, "false_positive_count": F.greatest(F.lit(0), F.col("detected_count") - expected), "recognition_score": mean})


def scenario_metrics(samples: DataFrame, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Means and totals per scenario, rounded as later thresholds expect.

    With ``order`` sums are taken in that order, so that a mean next to a tie rounds the
    same way however the rows are spread over tasks."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    conf = F.coalesce("recognition_confidences", F.array().cast("array<double>"))
    n = F.count("*")
    count = F.sum(F.size(conf))
    added = {"analysis_ms": zero("analysis_ms"), "snapshot_quality_score": zero("snapshot_quality_score"), "confidence": F.aggregate(conf, F.lit(0.0), lambda s, v: s + v)}
    if order:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        samples = samples.withColumns({"__nth": F.row_number().over(w), **{f"__{c}": F.sum(v).over(w) for c, v in added.items()}})
    total = {c: F.max_by(f"__{c}", "__nth") if order else F.sum(v) for c, v in added.items()}
    return samples.groupBy(*keys).agg(
        n.alias("sample_count"), F.bround(F.sum(zero("detected_count")) / n, 2).alias("avg_detected"), F.bround(F.sum(zero("accepted_count")) / n, 2).alias("avg_accepted"),
        F.bround(total["analysis_ms"] / n, 2).alias("avg_analysis_ms"), F.bround(total["snapshot_quality_score"] / n, 2).alias("avg_quality"),
        F.bround(F.when(count > 0, total["confidence"] / count).otherwise(0.0), 3).alias("avg_confidence"), F.bround(F.coalesce(F.min(F.array_min(conf)), F.lit(0.0)), 3).alias("min_confidence"),
        F.sum(zero("recognition_rejections")).alias("recognition_rejections"), F.sum(zero("candidate_validation_rejections")).alias("validation_rejections"),
    )


def grade_scenarios(metrics: DataFrame) -> DataFrame:
    """``metrics`` with ``score``, ``status``, ``warnings`` and ``blocking`` codes."""
    m = F.col
    empty, one = m("scenario") == "empty", m("scenario") == "one_card"
    clean = m("avg_accepted") <= 0
    dark = m("avg_quality") < 0.55
    dim = m("avg_quality") < 0.70
    empty_score = F.when(~clean, 0.0).otherwise(1.0 - F.when(m("avg_detected") > 0, F.least(F.lit(0.4), m("avg_detected") * 0.15)).otherwise(0.0) - F.when(dim, (0.70 - m("avg_quality")) * 0.5).otherwise(0.0))
    empty_status = so.first_rule([("bad", ~clean), ("bad", dark), ("warning", dim)], "ok")
    expected = F.when(one, 1).otherwise(3)
    good, low = F.when(one, 0.75).otherwise(0.70), F.when(one, 0.60).otherwise(0.55)
    found = m("avg_accepted") > 0
    few, many = found & (m("avg_accepted") < expected), m("avg_accepted") > expected
    unsure, doubtful = found & (m("avg_confidence") < low), found & (m("avg_confidence") < good)
    rejected = m("recognition_rejections") + m("validation_rejections")
    slow, very_slow = m("avg_analysis_ms") > 750, m("avg_analysis_ms") > 1500
    card_score = (
        F.when(~found, 0.0).when(few, m("avg_accepted") / expected).when(many, 0.8).otherwise(1.0)
        - F.when(doubtful, (good - m("avg_confidence")) * 0.8).otherwise(0.0)
        - F.when(rejected > 0, F.least(F.lit(0.3), rejected / m("sample_count") * 0.05)).otherwise(0.0)
        - F.when(very_slow, 0.15).when(slow, 0.05).otherwise(0.0)
    )
    card_status = so.first_rule([("bad", ~found | unsure), ("warning", doubtful | few | many)], "ok")
    status = F.when(empty, empty_status).otherwise(card_status)
    capped = F.when(status == "warning", F.least(F.col("raw"), F.lit(0.74))).when(status == "bad", F.least(F.col("raw"), F.lit(0.54))).otherwise(F.col("raw"))
    warnings = F.when(empty, so.all_rules([("candidates_on_empty", clean & (m("avg_detected") > 0)), ("low_quality", clean & dark), ("fair_quality", clean & dim & ~dark)])).otherwise(
        so.all_rules([("too_few", few), ("too_many", many), ("fair_confidence", doubtful & ~unsure), ("many_rejections", rejected > 0), ("very_slow", very_slow), ("slow", slow & ~very_slow)])
    )
    blocking = so.all_rules([("accepted_on_empty", empty & ~clean), ("nothing_found", ~empty & ~found), ("low_confidence", ~empty & unsure)])
    return metrics.withColumn("raw", F.when(empty, empty_score).otherwise(card_score)).withColumns({"status": status, "score": F.bround(so.clamp01(capped), 3), "warnings": warnings, "blocking": blocking}).drop("raw")


def grade_setup(scenarios: DataFrame, *keys: str) -> DataFrame:
    """Overall score, grade and readiness of each setup from its graded scenarios."""
    mean = F.avg("score")
    out = scenarios.groupBy(*keys).agg(mean.alias("mean"), F.sum("sample_count").alias("sample_count"), F.sum(F.size("blocking")).alias("blocking_count"), F.sum(F.size("warnings")).alias("warning_count"))
    grade = so.first_rule([("excellent", F.col("mean") >= 0.90), ("good", F.col("mean") >= 0.75), ("warning", F.col("mean") >= 0.55)], "bad")
    return out.select(*keys, F.bround("mean", 3).alias("score"), grade.alias("grade"), ((F.col("mean") >= 0.75) & (F.col("blocking_count") == 0)).alias("ready"), "sample_count", "blocking_count", "warning_count")


def operator_messages(scenarios: DataFrame, *keys: str) -> DataFrame:
    """``keys, messages``: what each graded scenario says, in order of their names, and
    whether the session can start. The texts are fixed values; a mean count in them has
    one decimal, ties to even."""
    has = lambda codes, code: F.array_contains(codes, code)
    m, warned, blocked = F.col, F.col("warnings"), F.col("blocking")
    expected = F.when(m("scenario") == "one_card", "1").otherwise("3")
    mean = F.bround(m("avg_accepted").cast("decimal(10,2)"), 1).cast("decimal(10,1)").cast("string")
    of_empty = so.first_rule([("Pusta mata zawiera zaakceptowane karty.", has(blocked, "accepted_on_empty")), ("Pusta mata generuje fałszywych kandydatów.", has(warned, "candidates_on_empty")), ("Pusta mata zweryfikowana poprawnie.", m("status") == "ok")])
    of_cards = (
        F.when(has(blocked, "nothing_found"), F.concat(F.lit("Brak wykrytych kart (oczekiwano "), expected, F.lit(").")))
        .when(has(blocked, "low_confidence"), "Pewność rozpoznania poniżej krytycznego progu.")
        .when(has(warned, "too_few"), F.concat(F.lit("Wykryto za mało kart ("), mean, F.lit("/"), expected, F.lit(").")))
        .when(has(warned, "too_many"), "Wykryto za dużo kart.")
        .when(has(warned, "fair_confidence"), "Pewność rozpoznania jest niska.")
        .when(has(warned, "many_rejections"), "Wykryto wysoki wskaźnik odrzuceń kandydatów.")
        .when(m("status") == "ok", F.concat(F.lit("Scenariusz "), expected, F.lit(" kart zaliczony pomyslnie.")))
    )
    text = F.when(m("scenario") == "empty", of_empty).otherwise(of_cards)
    said = scenarios.select(*keys, "scenario", F.concat(F.lit("["), "scenario", F.lit("] "), text).alias("text"))
    said = said.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("scenario", "text")))).alias("said"))  # a row a scenario
    setup = grade_setup(scenarios, *keys)
    end = F.when(F.col("ready"), "Warunki sa wystarczajace do rozpoczecia sesji.").when(F.col("blocking_count") > 0, "Wykryto problemy blokujace rozpoczęcie sesji.").otherwise("Jakosć stanowiska jest zbyt niska na start sesji.")
    return setup.join(said, list(keys)).select(*keys, F.concat(F.transform("said", lambda x: x["text"]), F.array(end)).alias("messages"))


def score_profiles(profiles: DataFrame, samples: DataFrame) -> DataFrame:
    """``profiles(profile, ordinal)`` scored over their samples; -999 without any.
    ``chosen`` marks the best, the first of equals."""
    one = so.sample_score(*(F.col(c) for c in ("geometry_score", "recognition_score", "candidate_count", "accepted_count", "false_positive_count", "matching_ms")))
    per = samples.groupBy("profile").agg(F.avg(one).alias("avg"), F.sum("false_positive_count").alias("false_positives"), F.sum("accepted_count").alias("accepted"), F.count("*").alias("sample_count"))
    out = profiles.join(per, "profile", "left")
    none = F.col("sample_count").isNull()
    reasons = F.when(none, F.array(F.lit("no_samples"))).otherwise(so.all_rules([("false_positive_penalty", F.col("false_positives") > 0), ("accepted_cards_reward", F.col("accepted") > 0), ("geometry_only", (F.col("false_positives") <= 0) & (F.col("accepted") <= 0))]))
    tier = so.first_rule([("LOW", none), ("HIGH", (F.col("avg") >= 1.2) & (F.col("accepted") > 0) & (F.col("false_positives") == 0)), ("MEDIUM", F.col("avg") >= 0.5)], "LOW")
    out = out.select("profile", "ordinal", F.coalesce("avg", F.lit(-999.0)).alias("score"), tier.alias("confidence"), reasons.alias("reasons"), F.coalesce("sample_count", F.lit(0)).alias("sample_count"))
    return out.withColumn("chosen", F.row_number().over(Window.orderBy(F.desc("score"), "ordinal")) == 1)  # one row per profile
