"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent (a local session in tests) a fresh temporary
    folder is set once and kept for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
        return named
    return named or held.get()


#: Folders written by the scopes that are open; the first scope is the process.
_written: list[list[tuple[SparkSession, str]]] = [[]]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _leave() -> None:
    for spark, path in _written[0]:
        with suppress(Exception):  # the session may have been stopped
            _delete(spark, path)


@contextmanager
def scratch() -> Iterator[None]:
    """At the end of this block, after an error too, every folder that operators
    wrote inside is deleted. What is to outlive it must have been written or
    collected. Blocks nest; what is written outside of any goes at the process's end."""
    _written.append([])
    try:
        yield
    finally:
        for spark, path in _written.pop():
            _delete(spark, path)


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted with its scope."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4()}"
    _written[-1].append((spark, path))
    return path


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here and
    a lost executor costs nothing that was computed before."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    _written[-1].append((spark, _behind(out)))
    return out


def kept(df: DataFrame) -> DataFrame:
    """``reliable`` for the scope around the innermost one: it outlives the block it is written in."""
    out = reliable(df)
    if len(_written) > 1:
        _written[-2].append(_written[-1].pop())
    return out


def stored(df: DataFrame) -> DataFrame:
    """As ``reliable``, as Parquet: compressed, and read column by column."""
    path = folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the folders behind ``reliable`` tables that nothing reads any more."""
    for df in frames:
        path = _behind(df)
        for scope in _written:
            if (df.sparkSession, path) in scope:
                scope.remove((df.sparkSession, path))
        _delete(df.sparkSession, path)


def _behind(df: DataFrame) -> str:
    return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


def compact(df: DataFrame, rows: int, per_partition: int = 200_000) -> DataFrame:
    """``df``, whose row count is known, in no more partitions than it needs.
    Up to ``per_partition`` short rows are one partition, over which grouping and
    joining exchange nothing; larger tables keep many."""
    return df.coalesce(max(1, -(-rows // per_partition)))
