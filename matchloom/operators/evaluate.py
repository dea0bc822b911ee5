"""Evaluation of method x sample prediction matrices."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .selection import percentiles


def rate(flag: Column, among: Column | None = None) -> Column:
    """Share of rows with ``flag``; null over no rows."""
    one = flag.cast("double")
    return F.avg(one if among is None else F.when(among, one))


#: Percentiles of the latency, by name.
LATENCY = {"p50_ms": 0.5, "p95_ms": 0.95}


def measures() -> list[Column]:
    known = F.col("is_known")
    return [
        F.count("*").alias("n"), F.count_if(known).alias("known"), F.count_if(~known).alias("wrong"),
        rate(F.col("top1_correct"), known).alias("top1"), rate(F.col("top3_contains_expected"), known).alias("top3"), rate(F.col("false_accept"), ~known).alias("false_accept_rate"),
        F.avg("confidence_gap").alias("mean_gap"), F.avg("runtime_ms").alias("mean_ms"),
    ]


def evaluate(predictions: DataFrame, *by: str) -> DataFrame:
    """Accuracy, false accepts, gap and latency per group."""
    summary = predictions.groupBy(*by).agg(*measures())
    return _with(summary, percentiles(predictions, by, "runtime_ms", LATENCY), by)


def evaluate_levels(predictions: DataFrame, levels: list[tuple[str, ...]]) -> DataFrame:
    """``evaluate`` at several levels in one pass of grouping sets; ``level`` is
    the bit vector of the columns that a row sums over."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    summary = predictions.groupingSets([list(map(F.col, level)) for level in levels], *columns).agg(F.grouping_id().alias("level"), *measures())
    latency, times = None, stored(predictions.groupBy(*columns, "runtime_ms").agg(F.count("*").alias("times")))
    for level in levels:
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in level)
        one = percentiles(times, level, "runtime_ms", LATENCY, weight="times")
        one = one.select(*(F.col(c) if c in level else F.lit(None).cast(predictions.schema[c].dataType).alias(c) for c in columns), F.lit(bits).cast("long").alias("level"), *LATENCY)
        latency = one if latency is None else latency.unionByName(one)
    return _with(summary, latency, [*columns, "level"])


def _with(summary: DataFrame, other: DataFrame, on) -> DataFrame:
    """``summary`` with the other columns of ``other``, both a row a group; groups may be null."""
    if not on:
        return summary.crossJoin(other)  # one row each
    other = other.withColumnsRenamed({c: f"__of_{c}" for c in on})
    same = functools.reduce(lambda a, b: a & b, (summary[c].eqNullSafe(other[f"__of_{c}"]) for c in on))
    return summary.join(other, same, "left").drop(*(f"__of_{c}" for c in on))


def method_summary(predictions: DataFrame, ambiguous: float = 0.04) -> DataFrame:
    n = F.greatest(F.lit(1), F.count("*"))
    return predictions.groupBy("method").agg(F.count("*").alias("n"), (F.count_if("top1_correct") / n).alias("top1"), (F.count_if("top3_contains_expected") / n).alias("top3"), (F.count_if(F.col("confidence_gap") < ambiguous) / n).alias("ambiguous_rate"))


def overlapping_summary(rows: DataFrame, memberships: dict[str, Column]) -> DataFrame:
    """All, extracted-only and accepted-only accuracies over groups that may
    overlap. A row that was not extracted counts as wrong and as MANUAL."""
    groups = F.explode(F.array_compact(F.array(*(F.when(holds, name) for name, holds in memberships.items()))))
    extracted = F.col("extracted")
    accepted = extracted & (F.col("decision") == "ACCEPT")
    right = F.coalesce(extracted & F.col("top1_correct"), F.lit(False))
    near = F.coalesce(extracted & F.col("top3_contains_expected"), F.lit(False))
    decision = F.when(extracted, F.col("decision")).otherwise("MANUAL")
    return rows.withColumn("group", groups).groupBy("group").agg(
        F.count("*").alias("n"), F.count_if(extracted).alias("processed"), rate(right).alias("top1_all"), rate(near).alias("top3_all"), rate(right, extracted).alias("top1_extracted"), rate(near, extracted).alias("top3_extracted"),
        rate(right, accepted).alias("top1_accepted"), *(F.count_if(decision == d).alias(d.lower()) for d in ("ACCEPT", "MANUAL", "RETRY")),
    )


def gate_rates(rows: DataFrame) -> DataFrame:
    """How a quality gate treats good, bad and foreign samples (``quality``, ``decision``, ``top1_correct``)."""
    is_ = lambda q: F.col("quality") == q
    says = lambda d: F.col("decision") == d
    return rows.agg(rate(~says("ACCEPT"), is_("bad")).alias("bad_recall"), rate(says("RETRY"), is_("good")).alias("good_false_retry"), rate(~says("ACCEPT"), is_("good")).alias("good_non_accept"), rate(says("RETRY"), is_("wrong")).alias("wrong_false_retry"), rate(F.col("top1_correct"), says("ACCEPT") & ~is_("wrong")).alias("accepted_top1"))


def count_maps(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """``outer, counts``: a map of inner value to count, in key order."""
    counted = rows.groupBy(outer, inner).agg(F.count("*").alias("n"))
    return counted.groupBy(outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(inner, "n")))).alias("counts"))


def stage_matrix(grid: DataFrame, found: DataFrame, keys: tuple[str, ...], features: tuple[str, ...]) -> DataFrame:
    """Count, difference to ``expected`` and feature means of each cell of the
    whole ``grid``, empty ones with 0."""
    per = found.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(f).alias(f"mean_{f}") for f in features), F.concat_ws(";", F.sort_array(F.collect_set("flag"))).alias("flags"))
    out = grid.join(per, list(keys), "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(*keys, n.alias("n"), (n - F.col("expected")).alias("delta"), *(F.coalesce(f"mean_{f}", F.lit(0.0)).alias(f"mean_{f}") for f in features), F.coalesce("flags", F.lit("")).alias("flags"))


def choose_best(summary: DataFrame, *order: Column) -> DataFrame:
    """The first row by a lexicographic order; summaries have one row per method."""
    return summary.orderBy(*order).limit(1)


def mark_best(summary: DataFrame, by: tuple[str, ...], *order: Column) -> DataFrame:
    """``best``: whether a row is its group's first by the order."""
    return summary.withColumn("best", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)


def label_join(predictions: DataFrame, labels: DataFrame, on: str = "sample_id") -> DataFrame:
    """Predictions (``predicted_id, top_ids``) with their labels and correctness; unlabelled ones are kept."""
    out = predictions.join(labels.select(on, "expected_id"), on, "left")
    return out.withColumns({"top1_correct": F.coalesce(F.col("predicted_id") == F.col("expected_id"), F.lit(False)), "top3_contains_expected": F.coalesce(F.array_contains("top_ids", F.col("expected_id")), F.lit(False))})
