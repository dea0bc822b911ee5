"""Every registered query of the library, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``run(spark, sf_dir)`` under a name."""

    def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        ENTRIES[name] = Entry(run, sql)
        return run

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: e.run for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in ENTRIES.items() if e.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENTRIES["j1_knn_flagship"].run(spark, sf_dir)
