"""Catalogue lookups, reconciliation, set operations and declarative validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_id
from ..functions.scores import first_rule
from ..session import stored
from .state import evenly_spaced


def prefix_join(ids: DataFrame, owners: DataFrame, default: str) -> DataFrame:
    """``id`` with its owner by the first listed prefix (``owners``: ``owner,
    prefix, ordinal``, of any number), else the text before ``_`` in lower case,
    else ``default``.

    An id meets prefixes by equality: it has a row for each length that prefixes
    have, with as much of its beginning."""
    lengths = owners.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # one row, as long as prefixes have lengths
    fit = F.filter("lengths", lambda n: n <= F.length("id"))
    begun = ids.select("id").crossJoin(F.broadcast(lengths)).select("id", F.explode_outer(fit).alias("n"))
    firsts = owners.groupBy(F.col("prefix").alias("begin")).agg(F.min(F.struct("ordinal", "owner")).alias("hit"))
    hits = begun.withColumn("begin", F.left("id", F.col("n"))).join(firsts, "begin", "left")
    first = hits.groupBy("id").agg(F.min("hit").alias("o"))
    lead = F.lower(F.substring_index("id", "_", 1))
    return first.select("id", F.coalesce("o.owner", F.when(F.contains(F.col("id"), F.lit("_")) & (lead != ""), lead), F.lit(default)).alias("owner"))


def lookup_active(active: DataFrame, manifest: DataFrame, fallback: str) -> DataFrame:
    """Manifest rows (``id, ordinal, card_count``) of the active ids; of repeated
    ids the last holds; without any hit the ``fallback`` id's; empty ones are skipped."""
    last = manifest.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ordinal")))).where("r = 1 and card_count > 0").drop("r")
    found = last.join(active.select("id").distinct(), "id", "left_semi")
    none = found.agg((F.count("*") == 0).alias("none"))
    spare = last.where(F.col("id") == fallback).crossJoin(F.broadcast(none)).where("none").drop("none")  # one row
    return found.unionByName(spare)


def scenario_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of each pair's ``previous`` and ``current`` scenario in one session, with ``expected``."""
    before, after = (rows.select("session", F.col("scenario").alias(s), F.col("count").alias(f"{s}_count")) for s in ("previous", "current"))
    return F.broadcast(pairs).join(before, "previous").join(after, ["session", "current"])


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, code, field``: keys that one side lacks and fields that differ (null-safe)."""
    both = left.select(key, *(F.col(f).cast("string").alias(f"l_{f}") for f in fields), F.lit(1).alias("l")).join(right.select(key, *(F.col(f).cast("string").alias(f"r_{f}") for f in fields), F.lit(1).alias("r")), key, "full_outer")
    found = [F.when(F.col("r").isNull(), F.struct(F.lit("ONLY_LEFT").alias("code"), F.lit(None).cast("string").alias("field"))), F.when(F.col("l").isNull(), F.struct(F.lit("ONLY_RIGHT").alias("code"), F.lit(None).cast("string").alias("field")))]
    present = F.col("l").isNotNull() & F.col("r").isNotNull()
    found += [F.when(present & ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.struct(F.lit("MISMATCH").alias("code"), F.lit(f).alias("field"))) for f in fields]
    return both.select(key, F.explode(F.array_compact(F.array(*found))).alias("v")).select(key, "v.code", "v.field")


def grid(spark, axes: dict[str, Sequence], holds: Column | None = None, limit: int | None = None) -> DataFrame:
    """A parameter grid in the order of its axes, with ``ordinal``; ``limit`` bounds it."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    out = out if holds is None else out.where(holds)
    ordered = out.withColumn("ordinal", F.row_number().over(Window.orderBy(*axes)) - 1)  # a grid is small by nature
    return ordered if limit is None else ordered.where(F.col("ordinal") < limit)


def ordered_union(*parts: DataFrame, key: str) -> DataFrame:
    """Distinct keys in the order of their first appearance: by part, then ``ordinal``."""
    out = None
    for i, part in enumerate(parts):
        one = part.select(key, F.struct(F.lit(i).alias("part"), "ordinal").alias("at"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min("at").alias("at")).select(key, "at.part", "at.ordinal")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    tag = lambda df, s: df.withColumn("side", F.lit(s))
    return tag(a.distinct().exceptAll(b.distinct()), "left").unionByName(tag(b.distinct().exceptAll(a.distinct()), "right"))


def violations(*rules: tuple[str, DataFrame, str]) -> DataFrame:
    """``code, key`` of every rule's rows: (code, rows that break it, key column)."""
    out = None
    for code, rows, key in rules:
        one = rows.select(F.lit(code).alias("code"), F.col(key).cast("string").alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


def verdict(found: DataFrame, warnings: Sequence[str]) -> DataFrame:
    """One row: PASS, WARNING or BLOCKED with counts."""
    soft = F.col("code").isin(*warnings)
    out = found.agg(F.count_if(~soft).alias("blocking"), F.count_if(soft).alias("warnings"))
    return out.select(first_rule([("BLOCKED", F.col("blocking") > 0), ("WARNING", F.col("warnings") > 0)], "PASS").alias("status"), "blocking", "warnings")


def dataset_rules(rows: DataFrame, minimums: DataFrame, *, total: int, key: str = "sample_id") -> DataFrame:
    """Repeated keys, categories under their minimum, too few rows, and fewer
    than two similarity groups of two members.

    All rules share one scan and one aggregation, by key, category, similarity group
    and whole table at once; of its rows only those that a rule can need are kept."""
    levels = {"key": 0b011, "category": 0b101, "group": 0b110, "whole": 0b111}
    plain = rows.select(F.col(key).alias("key"), "category", F.col("similarity_group").alias("group"))
    counted = plain.groupingSets([[F.col("key")], [F.col("category")], [F.col("group")], []], "key", "category", "group").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    counted = stored(counted.where((F.col("level") != levels["key"]) | (F.col("n") > 1)))
    at = lambda name: F.col("level") == levels[name]
    per = counted.where(at("category")).select("category", "n")
    short = F.broadcast(minimums).join(per, "category", "left").where(F.coalesce("n", F.lit(0)) < F.col("least"))
    few = counted.agg(F.coalesce(F.max(F.when(at("whole"), F.col("n"))), F.lit(0)).alias("n")).where(F.col("n") < total)
    groups = counted.agg(F.count_if(at("group") & (F.col("n") >= 2)).alias("n")).where("n < 2")
    return violations(("DUPLICATE_ID", counted.where(at("key")), "key"), ("MINIMUM_CATEGORY", short, "category"), ("MINIMUM_TOTAL", few, "n"), ("SIMILARITY_GROUPS", groups, "n"))


def append_new(given: DataFrame, recorded: DataFrame, key: str = "stable_id", *, bad: Column | None = None) -> DataFrame:
    """``given`` with ``status``: RECORDED, ALREADY_RECORDED, or why it is no sample. Repeats in ``given`` count once.
    ``bad`` tells which ids are none; by default those that are not 20 hex digits."""
    bad = ~F.col(key).rlike("^[0-9a-f]{20}$") if bad is None else bad
    seen = recorded.select(key, F.lit(True).alias("seen")).distinct()
    once = given.dropDuplicates([key])
    status = first_rule([("BAD_ID", bad), ("MISSING_FILE", F.col("path").isNull()), ("ALREADY_RECORDED", F.col("seen").isNotNull())], "RECORDED")
    return once.join(seen, key, "left").select(*given.columns, status.alias("status"))


def search_parameters(samples: DataFrame, candidates: DataFrame, scorer, schema: str) -> DataFrame:
    """Mean score of each candidate of a grid over all samples by a user's
    ``scorer`` (pandas batch of candidate x sample rows -> ``ordinal, score,
    error``); failed trials score 0 and keep their error. Tiers at .4 and .7;
    ``best`` is the first maximum."""
    trials = samples.crossJoin(F.broadcast(candidates)).mapInPandas(scorer, schema)  # the grid is bounded
    out = trials.groupBy("ordinal").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.count("error").alias("failed"))
    tier = first_rule([("HIGH", F.col("score") >= 0.7), ("MEDIUM", F.col("score") >= 0.4)], "LOW")
    return out.withColumns({"tier": tier, "best": F.row_number().over(Window.orderBy(F.desc("score"), "ordinal")) == 1})


#: How known items are altered.
KNOWN_CATEGORIES = ("upright_clean", "reversed_clean", "perspective", "blur", "exposure", "extra_margin", "yellow_combined")


def validation_plan(items: DataFrame, known: str, *, seed: int, per_known: int = 24, per_foreign: int = 12) -> DataFrame:
    """Samples to make of ``items`` (``deck, item``): ``per_known`` evenly spaced items of
    the ``known`` deck in every category, and ``per_foreign`` of each other deck as
    ``wrong_deck``: ``sample_id, deck, item, expected, is_known, category, orientation``.
    Decks of no more items are taken whole."""
    ours = evenly_spaced(items.where(F.col("deck") == known), per_known, order=("item",), keys=("deck",)).withColumn("category", F.explode(F.array(*map(F.lit, KNOWN_CATEGORIES))))
    others = evenly_spaced(items.where(F.col("deck") != known), per_foreign, order=("item",), keys=("deck",)).withColumn("category", F.lit("wrong_deck"))
    turned = F.when(F.col("category") == "reversed_clean", "reversed").otherwise("upright")
    rows = ours.unionByName(others).withColumns({"is_known": F.col("deck") == known, "orientation": turned})
    sample = stable_id(F.lit(str(seed)), F.col("deck"), F.col("item").cast("string"), F.col("category"), F.col("orientation"))
    return rows.select(sample.alias("sample_id"), "deck", "item", F.when(F.col("is_known"), F.col("item")).alias("expected"), "is_known", "category", "orientation")
