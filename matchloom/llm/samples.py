"""Bounded samples of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thinned(df: DataFrame, most: int, *by: str) -> DataFrame:
    """About half as many again as ``most`` rows of ``df`` (all, if there are few):
    those whose hash of ``by`` lies under a threshold, set from the row count."""
    total = df.count()
    return df.where(F.xxhash64(*by) < int(-(2**63) + 2**64 * 1.5 * most / total)) if total > 2 * most else df


def first(df: DataFrame, most: int, *by: str) -> DataFrame:
    """``most`` rows of ``df`` at most: those of the smallest hashes of ``by``."""
    return df.orderBy(F.xxhash64(*by), *by).limit(most)


def bounded(df: DataFrame, most: int, *by: str) -> DataFrame:
    """The first of a thinned table, so that no task sends or gets many more than
    ``most`` rows. Where many rows are equal in ``by`` fewer may come; nulls and
    ties are in order."""
    return first(thinned(df, most, *by), most, *by)
