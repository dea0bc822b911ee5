"""Conflict-constrained best-fit packing of documents into token windows.

Documents longer than a window are cut into pieces first. Pieces are dealt to
groups by hash, and each group is packed by itself, longest piece first: open
bins are kept by residual room, and every bin carries bitmaps of the sources and
duplicate clusters it has. A piece takes the tightest bin with room whose
bitmaps do not have its source or cluster; the search goes on to the next
larger residual until one is compatible, else a bin is opened.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable


class Bins:
    """Open bins ordered by residual room, with conflict bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.filled = np.zeros(capacity + 1, np.int32)  # bins at each residual
        self.with_mark: dict[tuple[str, int], np.ndarray] = {}  # of those, bins that have a source or cluster
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _having(self, kind: str, mark: int) -> np.ndarray:
        return self.with_mark.setdefault((kind, mark), np.zeros(self.capacity + 1, np.int32))

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin that a piece goes to; -1 as source or cluster conflicts with none."""
        free = self.filled[size:]
        for kind, mark in (("s", source), ("c", cluster)):
            if mark >= 0 and (kind, mark) in self.with_mark:
                free = np.minimum(free, self.filled[size:] - self.with_mark[kind, mark][size:])
        for room in np.flatnonzero(free > 0) + size:
            for b in self.levels[room]:
                if not (source >= 0 and self.sources[b] >> source & 1) and not (cluster >= 0 and self.clusters[b] >> cluster & 1):
                    self._move(b, int(room), int(room) - size, source, cluster)
                    return b
        b = len(self.sources)
        self.sources.append(0)
        self.clusters.append(0)
        self._move(b, -1, self.capacity - size, source, cluster)
        return b

    def _move(self, b: int, old: int, new: int, source: int, cluster: int) -> None:
        if old >= 0:
            del self.levels[old][b]
            self.filled[old] -= 1
            for kind, bits in (("s", self.sources[b]), ("c", self.clusters[b])):
                while bits:
                    mark = (bits & -bits).bit_length() - 1
                    self._having(kind, mark)[old] -= 1
                    self._having(kind, mark)[new] += 1
                    bits &= bits - 1
        self.levels[new][b] = None
        self.filled[new] += 1
        for kind, marks, mark in (("s", self.sources, source), ("c", self.clusters, cluster)):
            if mark >= 0:
                marks[b] |= 1 << mark
                self._having(kind, mark)[new] += 1


def pack(sizes: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int) -> list[int]:
    """Bin numbers of pieces in the order given. Only marks that two pieces have
    can conflict; the others get no bit."""
    bits = []
    for marks in (sources, clusters):
        often = [m for m, n in Counter(m for m in marks if m is not None).items() if n > 1]
        bits.append({m: i for i, m in enumerate(often)})
    bins = Bins(capacity)
    return [bins.place(size, bits[0].get(s, -1), bits[1].get(c, -1)) for size, s, c in zip(sizes, sources, clusters, strict=True)]


def pieces(docs: DataFrame, capacity: int, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None) -> DataFrame:
    """``doc_id, source, cluster, start, n_tokens``: a document's tokens
    (runs of non-space) in spans of at most ``capacity``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = F.regexp_count(text, F.lit(r"\S+"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.xxhash64(text) if cluster is None else cluster).cast("long").alias("cluster"), count.cast("long").alias("all"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("all") - 1, F.lit(0)), F.lit(capacity).cast("long"))
    return rows.select("doc_id", "source", "cluster", "all", F.explode(starts).alias("start")).select("doc_id", "source", "cluster", "start", F.least(F.col("all") - F.col("start"), F.lit(capacity)).cast("int").alias("n_tokens"))


def pack_documents(docs: DataFrame, *, capacity: int = 2048, group_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, n_tokens, source, bin_group, bin``.

    In a bin (``bin_group``, ``bin``) the tokens are ``capacity`` at most and no
    two pieces share a source or a duplicate cluster (by default: equal texts;
    pieces of one document count as one cluster). A null source or cluster
    conflicts with nothing; texts that are null or empty are pieces of 0 tokens.
    Every row is packed, repeated ones too; ties of length go by hash, id and
    start; an empty table gives no rows. Groups have about ``group_rows`` pieces
    by a hash of all of a piece's columns, so that a hot source or cluster is
    spread over all groups; the tightest bin is that of a piece's own group.
    """
    cut = reliable(pieces(docs, capacity, id_col=id_col, text_col=text_col, source_col=source_col, cluster=cluster))
    groups = max(1, -(-cut.count() // group_rows))
    dealt = cut.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "start", "cluster", "source"), F.lit(groups)).cast("int"))

    order = [("n_tokens", "descending"), *((c, "ascending") for c in ("cluster", "doc_id", "start", "source"))]

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        bins = pack(table["n_tokens"].to_pylist(), table["source"].to_pylist(), table["cluster"].to_pylist(), capacity)
        return table.append_column("bin", pa.array(bins, pa.int32()))

    schema = dealt.select("*", F.lit(0).alias("bin")).schema
    return dealt.groupBy("bin_group").applyInArrow(work, schema).select("doc_id", "start", "n_tokens", "source", "bin_group", "bin")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
