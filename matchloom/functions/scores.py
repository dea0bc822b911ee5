"""Scores, gates and rule cascades as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Column]]


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double")))


def target_range(v: Column, low: float, high: float, yellow_low: float, yellow_high: float) -> Column:
    """1 inside [low, high], falling to 0.5 at the yellow limits, 0 beyond them."""
    rising = clamp01((v - yellow_low) / max(1e-6, low - yellow_low) * 0.5 + 0.5)
    falling = clamp01((yellow_high - v) / max(1e-6, yellow_high - high) * 0.5 + 0.5)
    return F.when(v.between(low, high), 1.0).when(~v.between(yellow_low, yellow_high), 0.0).when(v < low, rising).when(v > high, falling).otherwise(0.0)


def weighted(items: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean of values clamped to 0..1."""
    total = sum(w for _, w in items)
    if total <= 0:
        return F.lit(0.0)
    out = clamp01(items[0][0]) * items[0][1]
    for v, w in items[1:]:
        out = out + clamp01(v) * w
    return clamp01(out / total)


def first_rule(rules: Rules, otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def all_rules(rules: Rules) -> Column:
    """Names of the rules that hold, in rule order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(holds, name) for name, holds in rules))))


def shape_reject(area: Column, aspect: Column, least: float, most: float, *, target: float = 1.72, tolerance: float = 0.45) -> Column:
    return first_rule([("area_too_small", area < least), ("area_too_large", area > most), ("aspect_mismatch", F.abs(aspect - target) > tolerance)])


def change_kind(before: Column, after: Column, threshold: float) -> Column:
    """added, removed, moved_or_replaced or noise_or_lighting, from two ratios."""
    had, has = before >= threshold, after >= threshold
    return first_rule([("added", ~had & has), ("removed", had & ~has), ("moved_or_replaced", had & has)], "noise_or_lighting")


def change_kinds(before: Column, after: Column, baseline: Column, threshold: float) -> Column:
    """``change_kind`` where a missing baseline counts as full presence on both sides."""
    share = lambda v: F.when(baseline.isNull(), 1.0).otherwise(v)
    return change_kind(share(before), share(after), threshold)


def signal_screen(values: Column, *, least_mean: float, least_std: float, least_blur: float) -> dict[str, Column]:
    """Mean, population deviation and variance of second differences of a vector,
    the first failing reason, and a score where none fails."""
    def moments(a: Column) -> Column:  # one pass: count, mean, sum of squared deviations
        start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

        def take(s: Column, v: Column) -> Column:
            step = (v - s["mean"]) / (s["n"] + 1)
            return F.struct((s["n"] + 1).alias("n"), (s["mean"] + step).alias("mean"), (s["m2"] + (v - s["mean"]) * (v - s["mean"] - step)).alias("m2"))

        return F.aggregate(a, start, take, lambda s: F.struct(s["mean"].alias("mean"), (s["m2"] / s["n"]).alias("var")))

    inner = F.slice(values, 2, F.greatest(F.size(values) - 2, F.lit(0)))
    bends = F.transform(inner, lambda v, i: F.get(values, i + 2) - v - (v - F.get(values, i)))
    whole, bent = moments(values), moments(bends)
    mean_, std, blur = whole["mean"], F.sqrt(whole["var"]), bent["var"]
    reason = first_rule([("too_short", F.size(values) < 4), ("too_dark", mean_ < least_mean), ("low_contrast", std < least_std), ("too_blurry", blur < least_blur)])
    score = F.least(F.lit(1.0), 0.5 * blur / 200 + 0.5 * std / 80)
    return {"mean": mean_, "std": std, "blur": blur, "reason": reason, "score": F.when(reason.isNull(), score).otherwise(0.0)}


def geometry_confidence(rectangularity: Column, border: Column, support: Column, corner: Column, aspect_error: Column, points: Column) -> Column:
    """Confidence of a four-sided outline from its parts."""
    bonus = F.when(points == 4, 0.15).otherwise(0.0)
    fit = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), aspect_error))
    near = lambda v: F.least(F.lit(1.0), v * 8.0)
    return clamp01(0.30 * fit + 0.25 * rectangularity + 0.20 * near(border) + 0.15 * near(support) + 0.10 * corner + bonus)


def region_confidence(aspect: Column, fill: Column, area: Column, rectangularity: Column, support: Column) -> dict[str, Column]:
    """Confidence of an outline cut from a region (``aspect`` longer over shorter side,
    the others shares), the reason that rejects it whatever its confidence, and a status."""
    off = F.abs(aspect - 1.65) / 1.65
    confidence = weighted([(1 - off * 2.0, 0.35), (fill, 0.25), (target_range(area, 0.08, 0.75, 0.03, 0.90), 0.20), (rectangularity, 0.10), (support * 8.0, 0.10)])
    reject = first_rule([("card_area_too_small", area < 0.03), ("bad_aspect_ratio", (aspect < 1.05) | (aspect > 2.40)), ("low_foreground_fill", fill < 0.12)])
    return {"confidence": confidence, "reject_reason": reject, "status": F.when(reject.isNotNull(), "FAIL").otherwise(grade(confidence))}


def grade(v: Column, passing: float = 0.68, yellow: float = 0.35) -> Column:
    return first_rule([("PASS", v >= passing), ("YELLOW", v >= yellow)], "FAIL")


#: Measures that :func:`quality_suite` takes, all columns of doubles.
MEASURES = ("border_visible", "border_continuity", "corner_visibility", "proximity", "card_fill_ratio", "max_margin", "top_margin", "top_reflection", "overexposed_ratio", "laplacian_var", "tenengrad", "brightness_mean", "brightness_std", "histogram_spread", "edge_density", "texture_density", "internal_detail", "aspect_ratio", "size_ratio")


def quality_suite(m: Mapping[str, Column], *, expected_aspect: float = 1.72) -> dict[str, Column]:
    """Ordered flags, three composite scores and a status from crop measures."""
    fill = target_range(m["card_fill_ratio"], 0.70, 0.98, 0.55, 1.0)
    background = clamp01(1 - m["max_margin"] * 3.0)
    aspect = clamp01(1 - F.abs(m["aspect_ratio"] - expected_aspect) / expected_aspect * 3.0)
    size, blur, sharp = clamp01(m["size_ratio"]), clamp01(m["laplacian_var"] / 500.0), clamp01(m["tenengrad"] / 80.0)
    light = target_range(m["brightness_mean"], 45.0, 220.0, 25.0, 240.0)
    contrast, spread = clamp01(m["brightness_std"] / 55.0), clamp01(m["histogram_spread"] / 190.0)
    risk = weighted([(m["border_visible"], 0.35), (m["border_continuity"], 0.35), (m["corner_visibility"], 0.20), (clamp01(m["proximity"] * 20.0), 0.10)])
    complete = weighted([(risk, 0.25), (m["border_visible"], 0.20), (m["border_continuity"], 0.15), (m["corner_visibility"], 0.10), (fill, 0.15), (aspect, 0.15)])
    quality = weighted([(complete, 0.35), (background, 0.15), (light, 0.10), (contrast, 0.10), (blur, 0.10), (m["edge_density"], 0.10), (size, 0.10)])
    ready = weighted([(blur, 0.20), (sharp, 0.20), (contrast, 0.18), (light, 0.12), (spread, 0.10), (m["texture_density"], 0.10), (m["internal_detail"], 0.10)])
    flags = all_rules(
        [
            ("EDGE_CUT_RISK", risk < 0.28),
            ("TOO_MUCH_BACKGROUND", background < 0.45),
            ("TOP_MARGIN_RISK", m["top_margin"] > 0.16),
            ("TOP_REFLECTION_RISK", m["top_reflection"] > 0.20),
            ("LOW_CONTRAST", contrast < 0.22),
            ("TOO_DARK", m["brightness_mean"] < 25),
            ("TOO_BRIGHT", (m["brightness_mean"] > 240) | (m["overexposed_ratio"] > 0.35)),
            ("BLURRY", (blur < 0.12) & (sharp < 0.12)),
            ("LOW_DETAIL", (m["edge_density"] < 0.006) & (m["texture_density"] < 0.05)),
            ("BAD_ASPECT", aspect < 0.75),
            ("UNEXPECTED_SIZE", size < 0.75),
            ("LOW_QUALITY_SCORE", quality < 0.68),
            ("LOW_READINESS", ready < 0.50),
            ("LOW_SHARPNESS", (blur < 0.18) | (sharp < 0.18)),
            ("LOW_CONTRAST", contrast < 0.35),
            ("LOW_DETAIL", (m["texture_density"] < 0.12) | (m["internal_detail"] < 0.12)),
            ("LOW_BRIGHTNESS_SCORE", light < 0.50),
            ("LOW_HISTOGRAM_SPREAD", spread < 0.35),
        ]
    )
    return {"completeness": complete, "quality": quality, "readiness": ready, "flags": flags}


def quality_status(flags: Column, quality: Column, readiness: Column) -> Column:
    hard = F.arrays_overlap(flags, F.array(*map(F.lit, ("EDGE_CUT_RISK", "BAD_ASPECT", "UNEXPECTED_SIZE"))))
    fail = (hard & (quality < 0.35)) | (quality < 0.40) | (readiness < 0.30)
    return first_rule([("FAIL", fail), ("YELLOW", (F.size(flags) > 0) | (quality < 0.68) | (readiness < 0.50))], "PASS")


def quality_gate(component: Column, occlusion: Column, detail: Column, confidence: Column, gap: Column) -> dict[str, Column]:
    """ACCEPT, MANUAL or RETRY with reasons; a weak match escalates by one step."""
    covered = (component >= 0.065) | ((component >= 0.015) & (occlusion >= 0.08))
    glare = (component >= 0.035) | ((component >= 0.012) & (occlusion >= 0.055))
    base = first_rule([("RETRY", covered), ("MANUAL", glare | (detail < 0.035))], "ACCEPT")
    reason = first_rule([("SPECULAR_OCCLUSION", covered), ("SPECULAR_HIGHLIGHT_WARNING", glare), ("LOW_USABLE_DETAIL", detail < 0.035)])
    known = confidence.isNotNull() & gap.isNotNull()
    to_manual = known & (base == "ACCEPT") & (confidence < 0.03) & (gap < 0.01)
    to_retry = known & (base == "MANUAL") & (confidence < 0.015) & (gap < 0.005)
    weak = F.coalesce(to_manual | to_retry, F.lit(False))
    return {
        "decision": F.when(F.coalesce(to_manual, F.lit(False)), "MANUAL").when(F.coalesce(to_retry, F.lit(False)), "RETRY").otherwise(base),
        "reasons": F.array_compact(F.array(reason, F.when(weak, "LOW_MATCH_SIGNAL"))),
    }


def count_verdict(actual: Column, expected: Column, extra: Column | None = None) -> Column:
    """PASS at the expected count, YELLOW one off or where ``extra`` does not hold, else FAIL."""
    exact = actual == expected if extra is None else (actual == expected) & extra
    return first_rule([("PASS", exact), ("YELLOW", F.abs(actual - expected) <= 1)], "FAIL")


def probable_cause(category: Column, score: Column, gap: Column, in_top3: Column) -> Column:
    """Why an identification went wrong: the first rule that fits."""
    alike = category == "gilded_visually_similar"
    rules = [
        ("ground_truth_mismatch_suspected", alike & (score >= 0.20) & (gap >= 0.20)),
        ("image_quality_or_crop", category == "gilded_yellow"),
        ("visual_similarity_or_matcher", alike),
        ("image_quality_or_crop", score < 0.03),
        ("matcher_ranking", in_top3),
    ]
    return first_rule(rules, "crop_or_matcher")


def orientation(upright: Column, reversed_: Column, margin: float = 1.10) -> Column:
    """``reversed`` only if it beats upright by a tenth."""
    return F.when(reversed_ > upright * margin, "reversed").otherwise("upright")


def flipped(angle: Column) -> Column:
    return F.abs(angle) > 90


def reverify_due(suspicious: Column, age: Column, interval: float) -> Column:
    return suspicious | (age >= interval)


def sample_score(geometry: Column, recognition: Column, candidates: Column, accepted: Column, false_positives: Column, matching_ms: Column) -> Column:
    """Score of one tuning sample; nulls count as 0."""
    g, r, c, a, f, ms = (F.coalesce(v, F.lit(0)) for v in (geometry, recognition, candidates, accepted, false_positives, matching_ms))
    ratio = F.when(c > 0, a / c).otherwise(0.0)
    late = F.greatest(F.lit(0.0), ms - 120.0) / 120.0
    return g * 0.35 + r * 0.85 + ratio * 0.70 + a * 0.10 - f * 2.0 - late * 0.35


def session_score(identified: Column, good_matches: Column, false_outlines: Column, jitter: Column, matching_ms: Column) -> Column:
    """Score of a calibration session's sample: identification outweighs all else."""
    return F.when(identified, 1000.0).otherwise(0.0) + F.least(good_matches, F.lit(80.0)) * 2.0 - false_outlines * 20.0 - jitter * 120.0 - F.greatest(F.lit(0.0), matching_ms - 120.0) * 0.5


def candidate_score(geometry: Column, matches: Column, inlier_ratio: Column) -> Column:
    """Score of a snapshot's candidate; without recognition (null ``matches``) its geometry counts little."""
    recognised = F.least(matches / 30.0, F.lit(1.0)) * clamp01(F.coalesce(inlier_ratio, F.lit(0.0)))
    return F.when(matches.isNull(), geometry * 0.4).otherwise(geometry * 0.45 + recognised * 1.10)


def quad_score(area: Column, x: Column, y: Column, w: Column, h: Column, frame_w: float, frame_h: float) -> Column:
    """Score of an outline of some ``area`` with its upright box: its box's aspect against
    1.72, less for outlines of over 0.15 of the frame, a little less off the centre; 0 out of bounds."""
    share, off = area / (frame_w * frame_h), F.abs(F.greatest(w, h) / F.nullif(F.least(w, h), F.lit(0)) - 1.72)
    size = F.when(share <= 0.15, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (share - 0.15) / (0.6 - 0.15)))
    dx, dy = x + w / 2 - frame_w / 2, y + h / 2 - frame_h / 2
    central = 1.0 - F.sqrt(dx * dx + dy * dy) / ((frame_w**2 + frame_h**2) ** 0.5 / 2)
    out = (share < 0.0001) | (share > 0.6) | (w <= 0) | (h <= 0) | (off > 0.45)
    return F.when(out, 0.0).otherwise((1.0 - off / 0.45) * size * (0.8 + 0.2 * central))


#: Each step's label, and what is said where it is in order and where it is not.
STEP_TEXTS = {
    "decks": ("Aktywne talie", None, "Brak aktywnej talii"),
    "markers": ("ArUco", "Stol skalibrowany", "Pokaz markery ArUco w kadrze"),
    "snapshot": ("Snapshot", "Snapshot gotowy", "Czeka na stabilny snapshot"),
    "candidates": ("Kandydaci kart", "Wykryto kandydatow kart", "Brak kandydatow kart"),
    "recognition": ("Rozpoznanie", "Karty zaakceptowane", "Czeka na rozpoznanie"),
}
#: What an operator is told to do; without a rule the last warning, else ``check_diagnostics``.
ACTION_TEXTS = {
    "choose_decks": "Wybierz 1-3 talie w Studio.",
    "check_camera": "Sprawdz kamere i launcher CV.",
    "show_markers": "Pokaz wszystkie markery ArUco w kadrze.",
    "keep_still": "Zostaw mate nieruchomo przez kilka sekund.",
    "improve_light": "Popraw swiatlo, kontrast albo polozenie kart.",
    "run_session": "Mozna prowadzic sesje.",
    "check_diagnostics": "Sprawdz diagnostyke CV.",
}


def step_messages(steps: Column, deck_names: Column) -> Column:
    """``label, message`` of each step of ``explain_status``; decks in order are named."""

    def told(step: Column) -> Column:
        label, message = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, (text, good, bad) in STEP_TEXTS.items():
            said = F.when(step["state"] == "ok", F.array_join(deck_names, ", ") if good is None else F.lit(good)).otherwise(bad)
            label, message = F.when(step["step"] == name, text).otherwise(label), F.when(step["step"] == name, said).otherwise(message)
        return F.struct(label.alias("label"), message.alias("message"))

    return F.transform(steps, told)


def action_text(action: Column, warnings: Column | None = None) -> Column:
    """What an action says; where no rule fits, the last of ``warnings`` if there is one."""
    out = F.lit(None).cast("string")
    for name, text in ACTION_TEXTS.items():
        out = F.when(action == name, text).otherwise(out)
    if warnings is None:
        return out
    last = F.get(warnings, F.size(warnings) - 1)
    return F.when((action == "check_diagnostics") & last.isNotNull(), last).otherwise(out)


def explain_status(decks: Column, calibrated: Column, markers: Column, layout: Column, candidates: Column, cards: Column) -> dict[str, Column]:
    """Five steps with state and value, and a severity ladder."""
    waiting = layout.isin("settling", "sampling_snapshots", "analyzing_snapshot")
    step = lambda name, state, value: F.struct(F.lit(name).alias("step"), state.alias("state"), value.alias("value"))
    steps = F.array(
        step("decks", F.when(decks > 0, "ok").otherwise("error"), decks.cast("string")),
        step("markers", F.when(calibrated, "ok").otherwise("warn"), F.concat(markers.cast("string"), F.lit("/4"))),
        step("snapshot", F.when(waiting, "wait").otherwise("ok"), layout),
        step("candidates", F.when(candidates > 0, "ok").otherwise("warn"), candidates.cast("string")),
        step("recognition", F.when(cards > 0, "ok").otherwise("wait"), cards.cast("string")),
    )
    ladder = [("choose_decks", decks <= 0), ("check_camera", layout == "no_camera"), ("show_markers", ~calibrated), ("keep_still", waiting), ("improve_light", (candidates < 1) & (cards <= 0)), ("run_session", cards > 0)]
    action = first_rule(ladder, "check_diagnostics")
    return {"severity": F.when(action.isin("choose_decks", "check_camera"), "error").when(action == "run_session", "ok").otherwise("warn"), "next_action": action, "steps": steps}
