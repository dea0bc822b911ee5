"""Running functions along each key's ordered rows, by windows or, for a key of very
many rows, by a parallel prefix scan.

A long key's rows are cut into ranges of the order. Every range is run by itself and
summed up in one row, those rows are chained, and what came before a range is added
to its rows. So no task holds more of a key than a range, and both forms give the
same columns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable, stored

#: Rows from which on a key is cut into ranges, and rows of a range.
LONG, RANGE = 2_000_000, 500_000


class Running(NamedTuple):
    kind: str
    value: Column | None = None
    n: int = 0


def total(value: Column) -> Running:
    """Sum of a whole number up to and with the row."""
    return Running("total", value)


def latest(value: Column) -> Running:
    """The last value that is not null up to and with the row."""
    return Running("latest", value)


def before(value: Column) -> Running:
    """The value of the row before; null on the first row."""
    return Running("before", value)


def number() -> Running:
    """1 on the key's first row, and so on."""
    return Running("number")


def mean(value: Column, n: int) -> Running:
    """Mean over the row and the ``n`` - 1 before it."""
    return Running("mean", value, n)


class Series:
    """``df`` along ``order`` within ``keys``. ``add`` gives a new series with running columns."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.df, self.keys, self.order = df, tuple(keys), tuple(order)

    def _local(self, r: Running, groups: Sequence[str]) -> Column:
        w = Window.partitionBy(*groups).orderBy(*self.order)
        if r.kind == "total":
            return F.sum(r.value).over(w.rowsBetween(Window.unboundedPreceding, 0))
        if r.kind == "latest":
            return F.last(r.value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        if r.kind == "before":
            return F.lag(r.value).over(w)
        if r.kind == "number":
            return F.row_number().over(w)
        return F.avg(r.value).over(w.rowsBetween(1 - r.n, 0))

    def add(self, **columns: Running) -> Series:
        return Series(self.df.withColumns({name: self._local(r, self.keys) for name, r in columns.items()}), self.keys, self.order)

    def where(self, condition: Column) -> Series:
        return self._with(self.df.where(condition))

    def put(self, **columns: Column) -> Series:
        """Plain columns."""
        return self._with(self.df.withColumns(columns))

    def per(self, name: str, value: Column, *groups: str) -> Series:
        """An aggregate over the key's rows that are equal in ``groups``."""
        return self._with(self.df.withColumn(name, value.over(Window.partitionBy(*self.keys, *groups))))

    def _with(self, df: DataFrame) -> Series:
        return type(self)(df, self.keys, self.order)


class Ranged(Series):
    """The same over rows that have their range in ``__range`` and a tie-breaker in ``__tie``."""

    def add(self, **columns: Running) -> Series:
        df = self.df
        if means := {name: r for name, r in columns.items() if r.kind == "mean"}:
            for name, r in means.items():
                df = self._mean(df, name, r)
        columns = {name: r for name, r in columns.items() if r.kind != "mean"}
        if not columns:
            return self._with(df)
        at, groups = F.struct(*self.order), [*self.keys, "__range"]
        ends, carried, whole = [], {}, {}
        prior = Window.partitionBy(*self.keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        for i, (name, r) in enumerate(columns.items()):
            end, carry, local = f"__end{i}", f"__carry{i}", F.col(f"__local{i}")
            if r.kind == "number":
                ends.append(F.count("*").alias(end))
            elif r.kind == "total":
                ends.append(F.sum(r.value).alias(end))
            else:  # a struct, so that a null value is told from none
                held = F.struct(r.value.alias("v"))
                ends.append(F.max_by(F.when(r.value.isNotNull(), held) if r.kind == "latest" else held, F.when(r.value.isNotNull(), at) if r.kind == "latest" else at).alias(end))
            if r.kind in ("number", "total"):
                carried[carry] = F.sum(end).over(prior)
                whole[name] = F.when(F.col(carry).isNull(), local).otherwise(F.coalesce(local, F.lit(0)) + F.col(carry))
            else:
                carried[carry] = (F.last(end, ignorenulls=True) if r.kind == "latest" else F.last(end)).over(prior)
                whole[name] = F.coalesce(local, F.col(carry)["v"]) if r.kind == "latest" else F.when(F.col("__first"), F.col(carry)["v"]).otherwise(local)
        local = {f"__local{i}": self._local(r, groups) for i, r in enumerate(columns.values())}
        if any(r.kind == "before" for r in columns.values()):
            local["__first"] = F.row_number().over(Window.partitionBy(*groups).orderBy(*self.order)) == 1
        chain = df.groupBy(*groups).agg(*ends).select(*groups, *(c.alias(n) for n, c in carried.items()))
        return self._with(_joined(df.withColumns(local), chain, groups).withColumns(whole).drop(*local, *carried))

    def _mean(self, df: DataFrame, name: str, r: Running) -> DataFrame:
        """Rows at the end of a range also stand, as a halo, before the ranges that
        begin less than ``n`` rows later."""
        groups = [*self.keys, "__range"]
        df = self._with(df).add(__at=number()).df.withColumn("__value", r.value)
        starts = df.groupBy(*groups).agg(F.min("__at").alias("first"))
        ahead = Window.partitionBy(*self.keys).orderBy("__range").rowsBetween(1, r.n)  # every range has a row
        targets = starts.select(*groups, F.collect_list(F.struct("__range", "first")).over(ahead).alias("targets"))
        near = F.filter("targets", lambda t: t["first"] - F.col("__at") < r.n)
        rows = df.select(*groups, "__at", "__value")
        halo = _joined(rows, targets, groups).select(*self.keys, "__at", "__value", F.explode(near).alias("to")).select(*self.keys, F.col("to.__range").alias("__range"), "__at", "__value", F.lit(True).alias("__halo"))
        both = df.withColumn("__halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
        w = Window.partitionBy(*groups).orderBy("__at").rowsBetween(1 - r.n, 0)
        return both.withColumn(name, F.avg("__value").over(w)).where(~F.col("__halo")).drop("__halo", "__at", "__value")

    def per(self, name: str, value: Column, *groups: str) -> Series:
        found = self.df.groupBy(*self.keys, *groups).agg(value.alias(name))
        return self._with(_joined(self.df, found, [*self.keys, *groups]))


def _joined(df: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` with the other columns of ``small``; keys may be null."""
    other = small.withColumnsRenamed({c: f"__of_{c}" for c in on})
    return df.join(other, functools.reduce(lambda a, b: a & b, (df[c].eqNullSafe(other[f"__of_{c}"]) for c in on)), "left").drop(*(f"__of_{c}" for c in on))


def along(df: DataFrame, steps: Callable[[Series], Series], *, keys: Sequence[str] = ("entity_id",), order: Sequence[str] = ("ts_ms", "seq"), long: int | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with what ``steps`` adds along each key's rows, in ``order``.

    Keys of up to ``long`` rows (``LONG``) go by windows, all of a key in one task;
    keys of more are cut into ranges of about ``rows`` rows (``RANGE``). Which keys
    are long is counted first. Rows that are equal in ``order`` come in some order;
    null keys are one key; an empty table stays empty."""
    long, rows = LONG if long is None else long, RANGE if rows is None else rows
    counts = reliable(df.groupBy(*keys).agg(F.count("*").alias("__rows")).where(F.col("__rows") > long))
    hot = counts.agg(F.count("*"), F.sum("__rows")).first()
    if not hot[0]:
        return steps(Series(df, keys, order)).df
    marked = _joined(df, F.broadcast(counts) if hot[0] <= 100_000 else counts, keys)
    short = marked.where(F.col("__rows").isNull()).drop("__rows")
    tied = marked.where(F.col("__rows").isNotNull()).drop("__rows").withColumn("__tie", F.monotonically_increasing_id())
    ranges = max(2, -(-hot[1] // rows))
    ordered = [*keys, *order, "__tie"]
    cut = stored(tied.repartitionByRange(ranges, *ordered).withColumn("__range", F.spark_partition_id()))
    scanned = steps(Ranged(cut, keys, [*order, "__tie"])).df.drop("__range", "__tie")
    return steps(Series(short, keys, order)).df.unionByName(scanned)
