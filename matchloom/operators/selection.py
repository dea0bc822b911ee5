"""Exact percentiles by distributed selection: no task holds a group's values."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, reliable, stored

#: Distinct values that a group may have to be ranked in one ordered pass.
FEW = 100_000
#: Spans up to this number of rows are sent to every task.
SENT_SPANS = 100_000


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], *, weight: str | None = None, bins: int = 1024) -> DataFrame:
    """``by`` and a column a share: the interpolated percentile of ``value`` in each group.

    Equal values of a group are one row with their number (or the sum of ``weight``,
    whole numbers) from the start. Groups of up to ``FEW`` such rows are ranked in one
    pass; the others by rounds: for each wanted rank the span of values that it lies in is known, at first from
    the least to the largest. A round counts the values of all open spans in ``bins``
    equal parts, in one scan whose partial counts are small, and takes the part in
    which the rank falls, from the least to the largest value that is really there;
    a span of one value is done. A span is cut at least in two each round and usually
    in a thousand. Nulls do not count, NaN counts as infinite; groups without a value
    are left out; null groups are groups."""
    groups = list(by) or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    v = F.nanvl(F.col(value).cast("double"), F.lit(float("inf")))
    one = F.count("*") if weight is None else F.sum(weight)
    rows = stored(rows.select("*", v.alias("__v")).where(F.col("__v").isNotNull()).groupBy(*groups, "__v").agg(one.alias("__w")))
    large = rows.groupBy(*groups).count().where(F.col("count") > FEW).drop("count")
    if large.isEmpty():
        out = _ranked(rows, groups, shares)
    else:
        sent, on = large.withColumnsRenamed({c: f"__of_{c}" for c in groups}), [f"__of_{c}" for c in groups]
        same = _same(rows, sent, groups)
        out = _ranked(rows.join(sent, same, "left_anti"), groups, shares).unionByName(_narrowed(rows.join(sent, same, "inner").drop(*on), groups, shares, bins))
    return out if by else out.drop("__all")


def _same(a: DataFrame, b: DataFrame, on: Sequence[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"__of_{c}"]) for c in on))


def _ranked(rows: DataFrame, groups: Sequence[str], shares: dict[str, float]) -> DataFrame:
    whole = Window.partitionBy(*groups)
    rows = rows.withColumns({"n": F.sum("__w").over(whole), "upto": F.sum("__w").over(whole.orderBy("__v"))})
    holds = lambda k: (k >= F.col("upto") - F.col("__w")) & (k < F.col("upto"))
    found = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("n") - 1)
        low, high, rest = F.max(F.when(holds(F.floor(at)), F.col("__v"))), F.max(F.when(holds(F.ceil(at)), F.col("__v"))), F.max(at - F.floor(at))
        found.append(F.when(rest == 0, low).otherwise((1 - rest) * low + rest * high).alias(name))
    return rows.groupBy(*groups).agg(*found)


def _narrowed(rows: DataFrame, groups: Sequence[str], shares: dict[str, float], bins: int) -> DataFrame:
    at = lambda share: F.lit(share) * (F.col("n") - 1)
    ranks = F.array(*(F.struct(F.lit(name).alias("share"), F.lit(up).alias("up"), (F.ceil(at(s)) if up else F.floor(at(s))).alias("k")) for name, s in shares.items() for up in (False, True)))
    stats = rows.groupBy(*groups).agg(F.sum("__w").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    targets = reliable(stats.select(*groups, "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.explode(ranks).alias("r")).select(*groups, "n", "lo", "hi", "below", "r.*"))
    span = [*groups, "lo", "hi"]
    while many := targets.where("lo < hi").count():
        open_ = targets.where("lo < hi").select(*span).distinct().withColumnsRenamed({c: f"__of_{c}" for c in groups})
        met = rows.join(F.broadcast(open_) if many <= SENT_SPANS else open_, _same(rows, open_, groups) & F.col("__v").between(F.col("lo"), F.col("hi")))
        # Halves, so that no difference overflows; the ends have parts of their own.
        part = F.nanvl((F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2), F.lit(0.5)) * bins
        part = F.when(F.col("__v") == F.col("lo"), 0).when(F.col("__v") == F.col("hi"), bins - 1).otherwise(F.least(F.lit(bins - 1), F.floor(part)))
        counted = met.groupBy(*span, part.alias("part")).agg(F.sum("__w").alias("here"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        upto = F.sum("here").over(Window.partitionBy(*span).orderBy("part"))  # ``bins`` rows a span at most
        counted = counted.withColumn("upto", upto).withColumnsRenamed({c: f"__of_{c}" for c in span})
        first = F.col("below") + F.col("upto") - F.col("here")
        inside = (F.col("k") >= first) & (F.col("k") < F.col("below") + F.col("upto"))
        found = targets.where("lo < hi").join(counted, _same(targets, counted, span) & inside)
        narrowed = found.select(*groups, "n", F.col("least").alias("lo"), F.col("most").alias("hi"), first.alias("below"), "share", "up", "k")
        done, targets = targets, reliable(targets.where("lo = hi").unionByName(narrowed))
        release(done)
    low, high = F.max(F.when(~F.col("up"), F.col("lo"))), F.max(F.when(F.col("up"), F.col("lo")))
    held = targets.groupBy(*groups, "share").agg(F.first("n").alias("n"), low.alias("low"), high.alias("high"))
    weight = lambda s: at(s) - F.floor(at(s))
    value_of = lambda s: F.when(weight(s) == 0, F.col("low")).otherwise((1 - weight(s)) * F.col("low") + weight(s) * F.col("high"))
    return held.groupBy(*groups).agg(*(F.max(F.when(F.col("share") == name, value_of(s))).alias(name) for name, s in shares.items()))
