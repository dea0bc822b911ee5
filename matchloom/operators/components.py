"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import compact, reliable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, rows: int | None = None) -> DataFrame:
    """``node, root``: each node of an edge table with its component's smallest node.

    Alternating large-star and small-star steps: every node's larger neighbours
    are tied to the node's smallest neighbour, then its smaller ones, until the
    edges are one star for each component. The edge count never grows, rounds
    are logarithmic, a hub's minimum is aggregated before the shuffle and its
    join is one that adaptive execution splits. Null ends and self-loops are
    dropped; repeated edges count once. ``rows``, where it is known, is the
    number of edges; short tables are then grouped and joined in place.
    """
    edges = edges if rows is None else compact(edges, rows)
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = _settle(now)
    while True:
        both = compact(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * mark[0])
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        now, after = _settle(compact(small, 2 * mark[0]).distinct())
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return compact(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root"))), 2 * mark[0])


def _settle(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = reliable(edges)
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return compact(edges, mark[0]), tuple(mark)
