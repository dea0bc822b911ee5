"""Uniform shuffle into shards of exact size, by a hypergeometric matrix.

How many rows of each input partition go to each shard is drawn first: a random
matrix whose row sums are the partitions' counts and whose column sums are the
shards' exact sizes, which is the law that one uniform shuffle of all rows would
have. Each partition then permutes its own rows against its row of the matrix,
rows are exchanged once, and they are permuted again where they arrive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable


def exact_sizes(rows: int, shards: int) -> np.ndarray:
    """Shard sizes at most one apart."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


#: Populations from which draws are made by summing the law itself; numpy's generator ends at 10^9.
LARGE = 10**9


def communication_matrix(counts: dict[int, int], sizes: np.ndarray, seed: int) -> dict[int, np.ndarray]:
    """Rows to send from each partition to each shard.

    Many rows are split first: how much of each shard the first half of the
    partitions fills is drawn, then each half is drawn by itself, so only few
    draws are from large populations."""
    rng, out = np.random.default_rng(seed), {}

    def fill(partitions: list[int], left: np.ndarray) -> None:
        if len(partitions) > 1 and left.sum() >= LARGE:
            half = partitions[: len(partitions) // 2]
            here = _draw(rng, left, sum(counts[p] for p in half))
            fill(half, here)
            fill(partitions[len(half) :], left - here)
            return
        for p in partitions:
            out[p] = _draw(rng, left, counts[p])
            left = left - out[p]

    fill(sorted(counts), sizes.copy())
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, take: int) -> np.ndarray:
    """``take`` rows out of shards with ``left`` places: the marginals of a
    multivariate hypergeometric law, one shard at a time."""
    row, pool = np.zeros(len(left), np.int64), int(left.sum())
    for s in range(len(left)):
        good, rest = int(left[s]), pool - int(left[s])
        row[s] = take if rest == 0 else 0 if good == 0 or take == 0 else rng.hypergeometric(good, rest, take) if pool < LARGE else _summed(rng, good, rest, take)
        take, pool = take - int(row[s]), rest
    return row


def _summed(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """One hypergeometric draw by inversion. The law is summed over twelve
    standard deviations on both sides of its mean, from the quotients of
    neighbouring terms, which holds at any population."""
    pool = good + bad
    mean = take * good / pool
    spread = 12 * math.sqrt(mean * (bad / pool) * ((pool - take) / max(1, pool - 1))) + 12
    low, high = max(0, take - bad, int(mean - spread)), min(good, take, int(mean + spread) + 1)
    x = np.arange(low, high, dtype=np.float64)
    step = np.log(good - x) + np.log(take - x) - np.log(x + 1) - np.log(bad - take + x + 1)
    law = np.concatenate([[0.0], np.cumsum(step)])
    law = np.cumsum(np.exp(law - law.max()))
    return low + min(int(np.searchsorted(law, rng.random() * law[-1], "right")), high - low)


def shard_rows(df: DataFrame, shards: int, *, seed: int = 0, rows_per_block: int = 200_000) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in
    each shard); columns of these names are replaced.

    Sizes differ by one at most and every arrangement is equally likely. Nulls,
    ties, empty and repeated rows are rows like others: no value is looked at.
    A shard is exchanged in blocks of about ``rows_per_block`` rows, so no task
    holds a whole one. The input is written to the shared folder first: both
    passes then see the same partitions even if an executor is lost between.
    Pass only the columns wanted (a key, or the text to write out).
    """
    df = reliable(df.drop("shard", "slot"))
    counts = {int(r[0]): int(r[1]) for r in df.groupBy(F.spark_partition_id()).count().collect()}
    total = sum(counts.values())
    sizes = exact_sizes(total, shards)
    matrix = communication_matrix(counts, sizes, seed)
    blocks = max(1, -(-total // (shards * rows_per_block)))
    names = df.columns
    schema = df.select("*", F.lit(0).alias("shard"), F.lit(0).alias("__sharding_block"), F.lit(0).cast("long").alias("__sharding_key")).schema

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        row = matrix.get(partition, np.zeros(shards, np.int64))
        rng = np.random.default_rng([seed, partition])
        to = np.repeat(np.arange(shards, dtype=np.int32), row)
        rng.shuffle(to)
        done = 0
        for batch in batches:
            n = batch.num_rows
            if done + n > len(to):
                raise RuntimeError(f"partition {partition} has more rows than were counted")
            cols = [*batch.columns, pa.array(to[done : done + n]), pa.array(rng.integers(0, blocks, n, dtype=np.int32)), pa.array(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "shard", "__sharding_block", "__sharding_key"])
            done += n
        if done != len(to):
            raise RuntimeError(f"partition {partition} has fewer rows than were counted")

    sent = reliable(df.mapInArrow(permute, schema))
    held = sent.groupBy("shard", "__sharding_block").count()  # shards x blocks rows
    before = held.select("shard", "__sharding_block", (F.sum("count").over(Window.partitionBy("shard").orderBy("__sharding_block")) - F.col("count")).alias("__sharding_before"))
    place = F.row_number().over(Window.partitionBy("shard", "__sharding_block").orderBy("__sharding_key"))
    placed = sent.withColumn("__sharding_place", place)
    small = shards * blocks <= 100_000
    return placed.join(F.broadcast(before) if small else before, ["shard", "__sharding_block"]).select(*names, F.col("shard"), (F.col("__sharding_before") + F.col("__sharding_place") - 1).cast("long").alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.encode("text", "UTF-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).cast("long").alias("text_crc32"))
    out = shard_rows(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
