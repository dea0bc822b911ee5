"""Window operators over keyed, ordered readings, and snapshot comparison.

Running functions go along each entity's rows in ``order``; an entity of very many
rows is cut into ranges (``series``; ``long`` and ``rows`` set from where on and how long).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import change_kinds
from ..session import reliable
from . import series as sr
from .series import Series, along


def _over(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def rolling_mean(df: DataFrame, value: str, *, keys=("entity_id",), order=("ts_ms", "seq"), n: int = 60, digits: int = 3, **size) -> DataFrame:
    """``rolling``: mean of the last ``n`` values, rounded half-even, 0 without any."""
    out = along(df, lambda s: s.add(rolling=sr.mean(F.col(value), n)), keys=keys, order=order, **size)
    return out.withColumn("rolling", F.coalesce(F.bround("rolling", digits), F.lit(0.0)))


def reading_change(df: DataFrame, value: str, *, keys=("entity_id",), order=("ts_ms", "seq"), threshold: float, **size) -> DataFrame:
    """``motion`` (change over ``threshold``; first rows have none) and ``rate`` per second."""
    out = along(df, lambda s: s.add(__ts=sr.before(F.col("ts_ms")), __was=sr.before(F.col(value))), keys=keys, order=order, **size)
    gap = (F.col("ts_ms") - F.col("__ts")) / 1000
    moved = F.abs(F.col(value) - F.col("__was")) > threshold
    return out.withColumns({"motion": F.coalesce(moved, F.lit(False)), "rate": F.when(gap > 0, 1 / gap).otherwise(0.0)}).drop("__ts", "__was")


def settle_detection(df: DataFrame, still: int, *, keys=("entity_id",), order=("ts_ms", "seq"), **size) -> DataFrame:
    """``settled`` on the ``still``-th still row after motion, once per motion
    episode; never before the first motion."""
    quiet = (~F.col("motion")).cast("long")

    def steps(s: Series) -> Series:
        s = s.add(episode=sr.total(F.col("motion").cast("long")), __still=sr.total(quiet))
        return s.add(__base=sr.latest(F.when(F.col("motion"), F.col("__still"))))

    inside = F.col("__still") - F.coalesce("__base", F.lit(0))
    out = along(df, steps, keys=keys, order=order, **size)
    return out.withColumn("settled", (F.col("episode") > 0) & ~F.col("motion") & (inside == still)).drop("__still", "__base")


def identity_streak(df: DataFrame, *, keys=("entity_id",), order=("ts_ms", "seq"), confirm: int = 5, least: float = 0.8, **size) -> DataFrame:
    """``state_id``, ``phase``, ``frames``: the run of one id above a confidence.
    A low reading empties the id and breaks the run; a null confidence is low."""
    low = F.coalesce(F.col("confidence") < least, F.lit(True))

    def steps(s: Series) -> Series:
        s = s.put(__low=low).add(__was=sr.before(F.struct(F.col("__low").alias("low"), F.col("item_id").alias("id"))), __at=sr.number())
        broke = F.col("__low") | F.coalesce(F.col("__was.low"), F.lit(True)) | ~F.col("item_id").eqNullSafe(F.col("__was.id"))
        return s.add(__from=sr.latest(F.when(broke, F.col("__at"))))

    out = along(df, steps, keys=keys, order=order, **size)
    run = F.col("__at") - F.col("__from") + 1
    frames = F.when(F.col("__low"), 0).otherwise(run).cast("int")
    phase = F.when(F.col("__low"), "empty").when(run >= confirm, "confirmed").otherwise("candidate")
    return out.select(*df.columns, F.when(~F.col("__low"), F.col("item_id")).alias("state_id"), phase.alias("phase"), frames.alias("frames"))


def carry_forward(df: DataFrame, name: str, value: Column, *, keys=("entity_id",), order=("ts_ms", "seq"), **size) -> DataFrame:
    """``df`` with ``name``: the last value that is not null, up to this row."""
    return along(df, lambda s: s.add(**{name: sr.latest(value)}), keys=keys, order=order, **size)


def as_of_join(left: DataFrame, right: DataFrame, *, keys=("entity_id",), time: str = "ts_ms", order: Sequence[str] = (), **size) -> DataFrame:
    """Each row of ``left`` with ``match``, the last row of ``right`` (as a struct) of its
    key whose ``time`` is not later; null without one. Of right rows at one time the
    last by ``order`` counts. Both tables are merged along the time of each key, and
    what a range of a long key begins with is carried over from the range before.
    Rows of ``right`` without a time match nothing, nor do rows of ``left`` without one."""
    row = lambda df: F.struct(*(df[f"`{c}`"] for c in df.columns))
    placed = lambda df: [*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(time).alias("__time")]
    mine = left.select(*placed(left), F.lit(1).alias("__left"), row(left).alias("__row"))
    other = right.where(F.col(time).isNotNull()).select(*placed(right), F.lit(0).alias("__left"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), row(right).alias("match"))
    both = mine.unionByName(other, allowMissingColumns=True)
    names = [f"__k{i}" for i in range(len(keys))]
    out = along(both, lambda s: s.add(__found=sr.latest(F.col("match"))), keys=names, order=["__time", "__left", *(f"__o{i}" for i in range(len(order)))], **size)
    return out.where("__left = 1").select("__row.*", F.col("__found").alias("match"))


def empty_streak(df: DataFrame, *, keys=("entity_id",), order=("ts_ms", "seq"), clear_after: int = 2, **size) -> DataFrame:
    """``held``: the last item, cleared only by ``clear_after`` empty rows in a
    row; ``layout_id`` counts publishes and clears."""
    empty = F.col("item").isNull()

    def steps(s: Series) -> Series:
        s = s.add(__empty=sr.total(empty.cast("long")), __last=sr.latest(F.col("item")))
        s = s.add(__base=sr.latest(F.when(~empty, F.col("__empty"))))
        s = s.put(__streak=F.col("__empty") - F.coalesce("__base", F.lit(0)))
        event = ~empty | ((F.col("__streak") == clear_after) & F.col("__last").isNotNull())
        return s.add(layout_id=sr.total(event.cast("long")))

    out = along(df, steps, keys=keys, order=order, **size)
    return out.withColumn("held", F.when(F.col("__streak") < clear_after, F.col("__last"))).select(*df.columns, "held", "layout_id")


def change_only(df: DataFrame, columns: Sequence[str], *, keys=("entity_id",), order=("ts_ms", "seq"), **size) -> DataFrame:
    """Rows that differ from the one before in ``columns``."""
    print_ = F.struct(*columns)
    out = along(df, lambda s: s.add(__was=sr.before(print_), __at=sr.number()), keys=keys, order=order, **size)
    return out.where((F.col("__at") == 1) | ~F.col("__was").eqNullSafe(print_)).drop("__was", "__at")


def last_n(df: DataFrame, n: int, *, keys=("entity_id",), order=("ts_ms", "seq")) -> DataFrame:
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))).where(F.col("r") <= n).drop("r")


def refresh_hold(df: DataFrame, value: str, *, every: int = 30, keys=("entity_id",), order=("ts_ms", "seq"), **size) -> DataFrame:
    """``calibration``: taken anew on every ``every``-th row, held between; a
    missing value keeps the last good one."""

    def steps(s: Series) -> Series:
        s = s.add(__at=sr.number()).put(due=(F.col("__at") - 1) % every == 0)
        return s.add(calibration=sr.latest(F.when(F.col("due"), F.col(value))))

    return along(df, steps, keys=keys, order=order, **size).drop("__at")


def smooth(df: DataFrame, value: str, alpha: float, *, key: str = "entity_id", order=("ts_ms", "seq"), chunk: int = 10_000) -> DataFrame:
    """``smoothed``: current += (value - current) * alpha, from the first value.

    The recurrence is a sum with geometric weights, so a long series is cut into
    chunks: each is summed by itself and the chunks' ends are chained.
    """
    w = _over([key], order)
    given = df.withColumn("nth", F.row_number().over(w) - 1).withColumn("part", F.floor(F.col("nth") / chunk))
    keep = 1 - alpha

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        current = 0.0
        for pdf in batches:  # chunks one after the other; a row tells where the next begins
            out = []
            for nth, v in zip(pdf["nth"].tolist(), pdf[value].tolist(), strict=True):
                if nth % chunk == 0:
                    current = 0.0
                current = v if nth == 0 else current + (v - current) * alpha
                out.append(current)
            yield pdf.assign(local=out)

    near = given.repartition(key, "part").sortWithinPartitions(key, "part", "nth")
    local = near.mapInPandas(run, given.withColumn("local", F.lit(0.0)).schema)
    ends = local.groupBy(key, "part").agg(F.max_by("local", "nth").alias("end"), F.count("*").alias("n"))

    def chain(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        here, now = None, 0.0
        for pdf in batches:  # a row for each chunk, in order
            starts = []
            for k, end, n in zip(pdf[key], pdf["end"], pdf["n"], strict=True):
                here, now = k, now if k == here else 0.0
                starts.append(now)
                now = end + now * keep**n
            yield pdf[[key, "part"]].assign(start=starts)

    starts = ends.repartition(key).sortWithinPartitions(key, "part").mapInPandas(chain, ends.select(key, "part", F.lit(0.0).alias("start")).schema)
    return local.join(starts, [key, "part"]).select(*df.columns, (F.col("local") + F.col("start") * F.pow(F.lit(keep), F.col("nth") % chunk + 1)).alias("smoothed"))


def timeline(df: DataFrame, *, keys=("entity_id",), order=("ts_ms", "seq"), **size) -> DataFrame:
    """Markers between a start and a stop: ``session``, ``offset_ms`` since its
    start and ``duration_ms``, the last offset."""
    start, stop = F.col("marker") == "start", (F.col("marker") == "stop").cast("long")

    def steps(s: Series) -> Series:
        s = s.add(session=sr.total(start.cast("long")), __stops=sr.total(stop)).put(__before=F.col("__stops") - stop)
        s = s.add(__begin=sr.latest(F.when(start, F.struct(F.col("ts_ms").alias("ms"), F.col("__before").alias("stops")))))
        s = s.where((F.col("session") > 0) & (F.col("__before") == F.col("__begin.stops"))).put(offset_ms=F.col("ts_ms") - F.col("__begin.ms"))
        return s.per("duration_ms", F.max("offset_ms"), "session")

    return along(df, steps, keys=keys, order=order, **size).select(*df.columns, "session", "offset_ms", "duration_ms")


def best_of(df: DataFrame, score: str, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each group's row of the highest score, the first of equals."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *order))).where("r = 1").drop("r")


def global_position(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``pos`` of each row in the order of the whole table, and its ``size``:
    ranges of the order are numbered by themselves and their counts added up, so
    no task sees the whole table."""
    ranged = reliable(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))  # one row for each range
    whole = Window.orderBy("range")
    before = counts.select("range", (F.sum("n").over(whole) - F.col("n")).alias("before"), F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "range").select(*df.columns, (F.col("before") + F.col("inside") - 1).alias("pos"), "size")


def evenly_spaced(df: DataFrame, n: int, *, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``n`` rows of each ordered group, both ends included: positions round
    half-even. Groups of ``n`` rows or fewer are whole."""
    if keys:
        w = Window.partitionBy(*keys)
        out = df.withColumns({"pos": F.row_number().over(w.orderBy(*order)) - 1, "size": F.count("*").over(w)})
    else:
        out = global_position(df, order)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (F.col("size") - 1) / (n - 1)).cast("int"))
    return out.where((F.col("size") <= n) | F.array_contains(wanted, F.col("pos"))).drop("pos", "size")


def throttle(df: DataFrame, least_ms: int, *, key: str = "entity_id", order=("ts_ms", "seq")) -> DataFrame:
    """At most one row per ``least_ms`` since the last one kept. Sorted rows are
    streamed; of a key only the last kept time is held."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        here, last = None, None
        for pdf in batches:
            kept = []
            for k, t in zip(pdf[key], pdf["ts_ms"], strict=True):
                if k != here:
                    here, last = k, None
                kept.append(last is None or t - last >= least_ms)
                last = t if kept[-1] else last
            yield pdf[kept]

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, df.schema)


def median_baseline(df: DataFrame, *, key: str = "key", value: str = "value", threshold: float) -> DataFrame:
    """``baseline`` (median per key) and ``foreground`` (further from it than ``threshold``)."""
    base = df.groupBy(key).agg(F.percentile(value, 0.5).alias("baseline"))
    return df.join(base, key).withColumn("foreground", F.abs(F.col(value) - F.col("baseline")) > threshold)


def foreground_ratio(cells: DataFrame, regions: DataFrame, *, width: int, height: int, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """``keys, region_id, ratio``: the share of a region's cells that are foreground.
    ``cells`` (keys, cx, cy, foreground) are those of a frame's grid of ``width`` x
    ``height``, absent ones background; ``regions`` (keys, region_id, x, y, w, h) are cut
    at the frame. A region without a cell inside the frame has 0, as has a frame
    without foreground.

    Cells and regions meet in the tiles of the grid that a region touches, 16 cells
    wide, so a frame is no single group."""
    tile = 16
    left, top = F.greatest(F.lit(0), F.col("x")), F.greatest(F.lit(0), F.col("y"))
    right, bottom = F.least(F.lit(width), F.col("x") + F.col("w")), F.least(F.lit(height), F.col("y") + F.col("h"))
    cut = regions.select(*keys, "region_id", left.cast("long").alias("l"), top.cast("long").alias("t"), right.cast("long").alias("r"), bottom.cast("long").alias("b"))
    size = F.greatest(F.lit(0).cast("long"), F.col("r") - F.col("l")) * F.greatest(F.lit(0).cast("long"), F.col("b") - F.col("t"))
    cut = cut.withColumn("cells", size)
    tiles = lambda lo, hi: F.sequence(F.floor(F.col(lo) / tile), F.floor((F.col(hi) - 1) / tile))
    spread = cut.where("cells > 0").withColumn("tx", F.explode(tiles("l", "r"))).withColumn("ty", F.explode(tiles("t", "b")))
    lit = cells.where("foreground").select(*keys, "cx", "cy", F.floor(F.col("cx") / tile).alias("tx"), F.floor(F.col("cy") / tile).alias("ty"))
    met = lit.join(spread, [*keys, "tx", "ty"]).where((F.col("cx") >= F.col("l")) & (F.col("cx") < F.col("r")) & (F.col("cy") >= F.col("t")) & (F.col("cy") < F.col("b")))
    hits = met.groupBy(*keys, "region_id").agg(F.count("*").alias("hits"))
    return cut.join(hits, [*keys, "region_id"], "left").select(*keys, "region_id", F.coalesce(F.col("hits") / F.nullif(F.col("cells"), F.lit(0)), F.lit(0.0)).alias("ratio"))


def snapshot_diff(previous: DataFrame, current: DataFrame, baseline: DataFrame, *, noise: float, threshold: float, shift_share: float = 0.45, pair: tuple[str, ...] = ()) -> DataFrame:
    """``key, kind, shifted`` of keys whose value changed by more than ``noise``.
    With ``pair`` columns many pairs of snapshots are compared at once, each by itself.

    Presence is the ratio to the key's baseline; without a baseline a key counts
    as present on both sides. ``shifted``: so many keys changed that the whole
    scene did, and kinds mean nothing.

    The baseline has a row a key, as snapshots have, and is met by a sorted shuffle:
    sent out, it would pass the driver whole, at every comparison again.
    """
    p, c = previous.select(*pair, "key", F.col("value").alias("before")), current.select(*pair, "key", F.col("value").alias("after"))
    changed = F.abs(F.coalesce("before", F.lit(0.0)) - F.coalesce("after", F.lit(0.0))) > noise
    both = p.join(c, [*pair, "key"], "full_outer").withColumn("changed", changed)
    share = both.groupBy(*pair).agg(F.avg(F.col("changed").cast("double")).alias("share"))  # a row a pair
    ratio = lambda v: F.coalesce(v, F.lit(0.0)) / F.nullif(F.col("base"), F.lit(0.0))
    kind = change_kinds(ratio(F.col("before")), ratio(F.col("after")), F.col("base"), threshold)
    found = both.where("changed").join(baseline.select("key", F.col("value").alias("base")).hint("merge"), "key", "left").select(*pair, "key", kind.alias("kind"))
    found = found.join(share, list(pair)) if pair else found.crossJoin(F.broadcast(share))  # one row
    return found.select(*pair, "key", "kind", (F.coalesce("share", F.lit(0.0)) >= shift_share).alias("shifted"))


def peak_levels(df: DataFrame, *, key: str = "entity_id", ts: str = "ts", value: str = "value", width: str = "150 milliseconds") -> DataFrame:
    """Loudest value of each tumbling window in decibels."""
    from ..functions.scalars import decibels

    w = F.window(ts, width)
    return df.groupBy(key, w.alias("w")).agg(F.max(F.abs(value)).alias("peak")).select(key, F.col("w.start").alias("start"), decibels(F.col("peak")).alias("db"))
