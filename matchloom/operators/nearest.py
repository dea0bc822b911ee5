"""Approximate nearest neighbours by an inverted file over trained coarse centroids.

The index is a folder: ``centroids`` (trained on a bounded sample), ``cells`` (every
row, packed into blocks of one cell each) and ``layout``. It is built once and
reused. A query looks into the cells whose centroids are nearest to it; how many it
takes for a wanted recall is measured on a sample of the rows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import reliable, stored

#: Rows that centroids are trained on at most, centroids at most, rows of a block, and queries of a pack.
SAMPLE, CELLS, BLOCK, PACK = 50_000, 4096, 4096, 256
#: Queries that are routed at once: their distances to all centroids are held together.
ROUTED = 512
#: Queries of the sample that a recall is measured on at most.
MEASURED = 200


def _numbers(column: pa.Array, codes: bool) -> np.ndarray:
    """Vectors as a matrix; codes as rows of -1 and 1, so that centroids can be taken of them."""
    if not codes:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    raw = column.to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(len(column), 8)
    return np.unpackbits(raw, axis=1).astype(np.float64) * 2 - 1


def _away(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances without the points' own norms, which no order of centroids needs."""
    return (centroids * centroids).sum(axis=1) - 2 * points @ centroids.T


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    """Each row's ``k``-th least number. The least numbers of many runs bound it from above, so that
    few have to be put in order; for small whole numbers they are counted."""
    run = d.shape[1] // (4 * k)
    if d.dtype != np.uint8 or run < 4:
        return np.partition(d, k - 1, axis=1)[:, k - 1]
    bound = np.partition(d[:, : d.shape[1] // run * run].reshape(len(d), -1, run).min(axis=2), k - 1, axis=1)[:, k - 1]
    row, col = np.divmod(np.flatnonzero(d <= bound[:, None]), d.shape[1])
    held = np.bincount(row * 256 + d[row, col], minlength=len(d) * 256).reshape(-1, 256).cumsum(axis=1)
    return (held < k).sum(axis=1).astype(np.uint8)


def train(points: np.ndarray, cells: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Centroids of ``points`` by Lloyd's rounds; an empty cell takes the point that lies farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(cells, len(points)), replace=False)].copy()
    norms = (points * points).sum(axis=1)
    for _ in range(rounds):
        own, off = np.zeros(len(points), np.int64), np.zeros(len(points))
        for lo in range(0, len(points), 4096):
            d = _away(points[lo : lo + 4096], centroids)
            own[lo : lo + 4096] = d.argmin(axis=1)
            off[lo : lo + 4096] = d.min(axis=1) + norms[lo : lo + 4096]
        held = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        full = held > 0
        centroids[full] = sums[full] / held[full, None]
        empty = np.flatnonzero(~full)
        centroids[empty] = points[np.argsort(-off)[: len(empty)]]
    return centroids


class Index:
    """An index opened from its folder; ``search`` needs nothing else."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.codes, self.id_type, self.rows = spark.read.parquet(f"{path}/layout").first()
        held = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # CELLS at most
        self.centroids = np.array([r.v for r in held], np.float64).reshape(len(held), -1 if held else 0)

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, item: str = "item_id", value: str = "vec", cells: int | None = None, sample: int = SAMPLE) -> Index:
        """Index every row of ``rows`` at ``path``: ``value`` is an array of numbers, or
        a 64-bit code where its type is long (distance: bits that differ).

        Rows whose value is null, empty or holds a null or non-finite number have no
        place in a cell and are left out, as are vectors of another length than the
        sample's first; repeated rows, equal values and null items are rows like
        others. ``cells`` defaults to four times the root of the number of rows, at
        most ``CELLS``. Cells are packed in blocks, so one value that a third of all
        rows have is many blocks of equal size."""
        codes = rows.schema[value].dataType.simpleString() == "bigint"
        usable = rows.select(F.col(item).alias("item"), F.col(value).alias("v") if codes else F.col(value).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
        if not codes:
            usable = usable.where((F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))
        spark, total = rows.sparkSession, usable.count()
        share = min(1.0, 1.5 * sample / max(1, total))
        some = usable.select("v").where(F.xxhash64("item", "v") < int(-(2**63) + share * (2**64 - 1))) if share < 1 else usable.select("v")
        seen = some.limit(sample).toArrow()["v"].combine_chunks()
        width = 64 if codes else len(seen[0]) if len(seen) else 0
        if not codes:
            usable = usable.where(F.size("v") == width)
            seen = seen.filter(pa.compute.equal(pa.compute.list_value_length(seen), width))
        centroids = train(_numbers(seen, codes), cells or int(min(CELLS, max(1, 4 * total**0.5)))) if len(seen) else np.zeros((0, width))
        spark.createDataFrame([(codes, rows.schema[item].dataType.simpleString(), total)], "codes boolean, id_type string, total long").coalesce(1).write.parquet(f"{path}/layout")
        spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(centroids)], "cell int, v array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        cls._write_cells(usable, f"{path}/cells", centroids, codes)
        return cls(spark, path)

    @staticmethod
    def _write_cells(usable: DataFrame, path: str, centroids: np.ndarray, codes: bool) -> None:
        sent = usable.sparkSession.sparkContext.broadcast(centroids)  # CELLS x dimensions at most
        kind, value = (usable.schema[c].dataType.simpleString() for c in ("item", "v"))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = _numbers(batch.column(1), codes)
                own = np.concatenate([np.zeros(0, np.int64), *(_away(points[lo : lo + 2048], sent.value).argmin(axis=1) for lo in range(0, len(points), 2048))])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=["item", "v", "cell"])

        placed = stored(usable.mapInArrow(assign, f"item {kind}, v {value}, cell int"))
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # CELLS rows at most
        dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("item", "v", F.monotonically_increasing_id()), F.col("parts")))
        number = np.int64 if codes else np.float64

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, items, v = (batch.column(c) for c in range(3))
                own = cell.to_numpy()
                order = np.argsort(own, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                    for lo in range(0, len(at), BLOCK):
                        take = pa.array(at[lo : lo + BLOCK])
                        block = v.take(take)
                        values = (block if codes else block.flatten()).to_numpy(zero_copy_only=False).astype(number).tobytes()
                        held = items.take(take)
                        yield pa.RecordBatch.from_arrays([pa.array([own[at[0]]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), pa.array([values])], names=["cell", "items", "refs"])

        near = dealt.repartition("cell", "part").sortWithinPartitions("cell").select("cell", "item", "v")
        near.mapInArrow(pack, f"cell int, items array<{kind}>, refs binary").write.parquet(path)

    def search(self, queries: DataFrame, k: int, *, probes: int, item: str = "item_id", value: str = "vec", keep: tuple[str, ...] = (), others: bool = False) -> DataFrame:
        """The ``k`` nearest rows of the ``probes`` cells nearest to each query:
        ``query_id, *keep, item_id, distance, rank, cell_rank, compared``. Ties go by
        item; distances are exact (Euclidean, or bits that differ); ``cell_rank`` tells
        in which of the query's cells a row was found, ``compared`` with how many rows
        the query was compared in the block that held this one. ``probes`` of all cells
        is an exact search. With ``others`` rows of the query's own id are no results. A query is told from others by its id and the ``keep``
        columns; unusable queries give no rows, as does an empty index."""
        codes, centroids = self.codes, self.centroids
        sent = self.spark.sparkContext.broadcast(centroids)
        v = F.col(value) if codes else F.col(value).cast("array<double>")
        asked = queries.select(F.col(item).alias("query_id"), *keep, v.alias("v")).where(F.col("v").isNotNull())
        width = centroids.shape[1]
        if not codes:
            asked = asked.where((F.size("v") == width) & F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))
        names = ["query_id", *keep]
        kinds = {c: asked.schema[c].dataType.simpleString() for c in names}
        number = np.int64 if codes else np.float64
        take = min(probes, len(centroids))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(lo, ROUTED) for b in batches for lo in range(0, len(b), ROUTED)) if take else ():
                points, column = _numbers(batch.column(len(names)), codes), batch.column(len(names))
                ranked = np.argsort(_away(points, sent.value), axis=1, kind="stable")[:, :take]
                row, rank = np.repeat(np.arange(len(points)), take), np.tile(np.arange(take), len(points))
                own = ranked.ravel()
                order = np.argsort(own, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else ():
                    for lo in range(0, len(at), PACK):
                        some = pa.array(row[at[lo : lo + PACK]])
                        block = column.take(some)
                        values = (block if codes else block.flatten()).to_numpy(zero_copy_only=False).astype(number).tobytes()
                        lists = [pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), batch.column(c).take(some)) for c in range(len(names))]
                        ranks = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.array(rank[at[lo : lo + PACK]], pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array([own[at[0]]], pa.int32()), *lists, ranks, pa.array([values])], names=["cell", *names, "ranks", "asked"])

        packs = reliable(asked.mapInArrow(route, ", ".join(["cell int", *(f"{c} array<{t}>" for c, t in kinds.items()), "ranks array<int>, asked binary"])))
        held = self.spark.read.parquet(f"{self.path}/cells")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for items, refs, values, ranks, *ids in zip(*batch.columns, strict=True):
                    items, refs = items.values, np.frombuffer(refs.as_buffer(), number)
                    q = np.frombuffer(values.as_buffer(), number)
                    if codes:
                        d = np.bitwise_count(q[:, None].view(np.uint64) ^ refs[None].view(np.uint64))  # 64 at most
                    else:
                        refs, q = refs.reshape(-1, width), q.reshape(-1, width)
                        d = np.zeros((len(q), len(refs)))
                        for c in range(width):
                            step = q[:, c, None] - refs[None, :, c]
                            d += step * step
                        d = np.sqrt(d)
                    ids, none = [x.values for x in ids], 255 if codes else np.inf
                    if others:
                        both = pa.concat_arrays([ids[0].cast(items.type), items]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                        d[both[: len(ids[0]), None] == both[None, len(ids[0]) :]] = none
                    # Everything as near as the k-th stays, so that ties can go by item.
                    cut = _kth(d, k) if d.shape[1] > k else np.full(len(d), none, d.dtype)
                    row, col = np.divmod(np.flatnonzero((d <= cut[:, None]) & (d != none)), d.shape[1])
                    row_, col_ = pa.array(row), pa.array(col)
                    yield pa.RecordBatch.from_arrays([*(x.take(row_) for x in ids), items.take(col_), pa.array(d[row, col].astype(np.float64)), ranks.values.take(row_), pa.array(np.full(len(row), d.shape[1]), pa.int64())], names=[*names, "item_id", "distance", "cell_rank", "compared"])

        schema = ", ".join([*(f"{c} {t}" for c, t in kinds.items()), f"item_id {self.id_type}, distance double, cell_rank int, compared long"])
        met = held.join(packs, "cell").select("items", "refs", "asked", "ranks", *names).mapInArrow(compare, schema)
        at = Window.partitionBy(*names).orderBy("distance", F.col("item_id").asc_nulls_last())
        return met.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)

    def probes_for(self, recall: float, k: int, *, margin: float = 0.04, others: bool = False) -> int:
        """How many cells a query must look into for ``recall`` of its ``k`` nearest, as
        measured (with ``margin`` added) by exact searches of at most ``MEASURED`` rows
        of the index itself, each beside what is equal to it or, with ``others``, beside
        other items only. All cells if nothing less will do."""
        value = "bigint" if self.codes else "array<double>"
        held = self.spark.read.parquet(f"{self.path}/cells").select("cell", F.posexplode("items").alias("at", "item"), "refs")
        picked = held.orderBy(F.xxhash64("item", "cell", "at"), "cell", "at").limit(MEASURED)
        codes, width = self.codes, self.centroids.shape[1]

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for at, refs in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    flat = np.frombuffer(refs.as_buffer(), np.int64 if codes else np.float64)
                    out.append(int(flat[at]) if codes else flat[at * width : (at + 1) * width].tolist())
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), pa.array(out, pa.int64() if codes else pa.list_(pa.float64()))], names=["no", "item", "v"])

        asked = picked.withColumn("no", F.monotonically_increasing_id()).select("at", "no", "refs", "item").mapInArrow(unpack, f"no long, item {self.id_type}, v {value}")
        # Without ``others`` the row is its own nearest, which is not counted.
        found = self.search(reliable(asked), k + (not others), probes=len(self.centroids), item="item", value="v", keep=("no",), others=others).where(F.col("rank") > int(not others))
        needed = {r[0]: r[1] for r in found.groupBy("cell_rank").count().collect()}
        total, so_far = sum(needed.values()), 0
        for probes in range(1, len(self.centroids) + 1):
            so_far += needed.get(probes - 1, 0)
            if so_far >= min(1.0, recall + margin) * total:
                return probes
        return max(1, len(self.centroids))
