"""Exact top-k search by inner product, by columnar branch-and-bound.

Candidates lie in vertical layout, dimension by dimension. Scores are
accumulated block of dimensions by block; after each block a candidate's score
can grow by the product of the remaining norms at most, so candidates whose
bound is under the query's k-th best score so far are compacted away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import compact, reliable
from .vector_codes import whole_numbers

FOUND = "query_id long, vec_id long, score long"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: Vectors whose sum of squares reaches this are searched with whole numbers of any size, as a score could pass a long.
LARGEST = 2.0**62
#: A score of any size as limbs of so many decimal digits, the highest first and signed; as many as doubles can need.
DIGITS, LIMBS = 36, 20
_NONE = np.iinfo(np.int64).max


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), np.iinfo(np.int64).min)
        self.ids = np.full((queries, k), _NONE)

    @property
    def floor(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in (query, id, score) triples."""
        k = self.scores.shape[1]
        touched = np.unique(q)
        q = np.concatenate([q, np.repeat(touched, k)])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        scores = np.concatenate([scores, self.scores[touched].ravel()])
        order = np.lexsort((ids, ~scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        self.scores[q[top], rank[top]] = scores[top]
        self.ids[q[top], rank[top]] = ids[top]


def search_block(best: Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, block: int = 16) -> None:
    """Take one block of candidates (``columns``: dimensions x candidates, whole
    numbers as float64) into ``best``.

    Bounds are floats and lowered by what rounding can add to them, a share of
    the norms' product; scores that a float may not hold (products of norms of
    2^53 or more) are summed again as longs, so every score is exact while the
    product of the norms is under 2^63."""
    dims = len(columns)
    cuts = list(range(block, dims, block)) + [dims]
    tail = lambda m, axis: np.sqrt(np.maximum(0, np.flip(np.cumsum(np.flip(m * m, axis), axis), axis)))
    q_tail, c_tail = tail(queries, 1), tail(columns, 0)
    largest = q_tail[:, 0] * c_tail[0].max()
    slack = 8 * (dims + 8) * 2.0**-53 * largest
    at = cuts[0]
    part = queries[:, :at] @ columns[:at]
    own = query_ids[:, None] == ids[None, :]
    # A first k per query, wholly scored, so that there is a floor to cut by.
    k = min(best.scores.shape[1], len(ids))
    guess = np.where(own, -np.inf, part)
    seed = np.argpartition(-guess, k - 1, axis=1)[:, :k]
    full = np.einsum("qd,dqk->qk", queries, columns[:, seed])
    floor = np.where(own[np.arange(len(seed))[:, None], seed], -np.inf, full).min(axis=1) if k == best.scores.shape[1] else np.full(len(seed), -np.inf)
    floor = np.maximum(floor, best.floor.astype(float)) - slack
    bound = part if at == dims else part + q_tail[:, at, None] * c_tail[at]
    q, c = np.nonzero((bound >= floor[:, None]) & ~own)
    score = part[q, c]
    for to in cuts[1:]:
        if not len(q):
            break
        score = score + np.einsum("pd,dp->p", queries[q, at:to], columns[at:to, c])
        at = to
        if at < dims:
            live = score + q_tail[q, at] * c_tail[at, c] >= floor[q]
            q, c, score = q[live], c[live], score[live]
    live = score >= floor[q]
    q, c, score = q[live], c[live], score[live]
    if len(q):
        whole = score.astype(np.int64)
        if largest.max() >= 2.0**53:
            whole = np.einsum("pd,dp->p", queries.astype(np.int64)[q], columns.astype(np.int64)[:, c])
        best.add(q, ids[c], whole)


def search_block_exact(query: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, k: int, block: int = 16) -> list[tuple[int, int]]:
    """(score, id) of one query's ``k`` best in a block, Python's whole numbers all
    through: the same blocks of dimensions and remaining-mass bounds, with roots taken upwards."""
    at_most = np.frompyfunc(lambda x: math.isqrt(x) + 1, 1, 1)
    left = np.flatnonzero(ids != own)
    score = np.zeros(len(left), dtype=object)
    tail = lambda m, lo: (m[lo:] * m[lo:]).sum(axis=0)
    for lo in range(0, len(query), block):
        score = score + (query[lo : lo + block, None] * columns[lo : lo + block][:, left]).sum(axis=0)
        if lo + block < len(query) and len(left) > k:
            reach = at_most(tail(query, lo + block) * tail(columns[:, left], lo + block))
            floor = sorted(score - reach)[-k]
            live = np.array(score + reach >= floor, dtype=bool)
            left, score = left[live], score[live]
    return sorted(((int(s), int(i)) for s, i in zip(score, ids[left])), key=lambda x: (-x[0], x[1]))[:k]


def _limbs(score: int) -> list[Decimal]:
    out = []
    for _ in range(LIMBS - 1):
        score, low = divmod(score, 10**DIGITS)
        out.append(Decimal(low))
    return [Decimal(score), *reversed(out)]


def _limbs_of_long(score: Column) -> Column:
    """The same of a column of longs."""
    kind, full = "decimal(38,0)", Decimal(10**DIGITS)
    low = F.when(score < 0, F.lit(full).cast(kind) + score).otherwise(score).cast(kind)
    return F.concat(F.array(F.when(score < 0, -1).otherwise(0).cast(kind)), F.array_repeat(F.when(score < 0, F.lit(full - 1)).otherwise(0).cast(kind), LIMBS - 2), F.array(low))


def _exact(stored: DataFrame, asked: DataFrame, k: int, scale: float) -> DataFrame:
    """``query_id, vec_id, limbs``: candidates past queries (both ``id, v``) by whole numbers of any size."""
    names = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("limbs", pa.list_(pa.decimal128(38, 0)))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked_ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            whole = lambda column: [np.array([int(x) for x in whole_numbers(np.array(v, np.float64), int(scale))], dtype=object) for v in column.to_pylist()]
            vectors, queries, found = whole(batch.column(1)), whole(batch.column(3)), []
            at: dict[tuple[int, bytes], list[int]] = {}
            for row, q in enumerate(asked_ids.tolist()):
                at.setdefault((q, len(queries[row])), []).append(row)
            for (q, _), some in at.items():
                columns = np.stack([vectors[r] for r in some], axis=1)
                found += [(q, i, _limbs(s)) for s, i in search_block_exact(queries[some[0]], q, ids[some], columns, k)]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], names.field(c).type) for c in range(3)], schema=names)

    met = stored.crossJoin(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")).hint("shuffle_replicate_nl")).where(F.size("v") == F.size("q"))
    return met.mapInArrow(scan, "query_id long, vec_id long, limbs array<decimal(38,0)>")


def _packed(vectors: DataFrame, scale: float, rows: int) -> DataFrame:
    """``size, ids, columns``: the usable vectors of ``vectors`` (id, v), scaled and
    floored, in vertical blocks of up to ``rows`` vectors of one length."""
    schema = pa.schema([("size", pa.int32()), ("ids", pa.binary()), ("columns", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = np.floor(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
            starts = np.cumsum(sizes) - sizes
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == size)
                for lo in range(0, len(at), rows):
                    some = at[lo : lo + rows]
                    block = flat[starts[some][:, None] + np.arange(size)]
                    with np.errstate(over="ignore", invalid="ignore"):
                        fits = (block * block).sum(axis=1) < LARGEST  # false for what is not finite
                    if fits.any():
                        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids[some][fits].tobytes()]), pa.array([np.ascontiguousarray(block[fits].T).tobytes()])], schema=schema)

    return vectors.mapInArrow(work, "size int, ids binary, columns binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, query_rows: int = 128, candidate_rows: int = 1024, blocks_a_task: int = 32) -> DataFrame:
    """Each query's k best vectors: ``query_id, rank, vec_id, score``.

    Components become floor(scale * x), x as double; the score is their inner
    product; ties go to the smaller id; rows with the query's id (the query
    itself) are no candidates. Vectors that are null, empty or hold a null or
    non-finite component, and rows without id take no part; a query meets
    vectors of its own length only. Vectors whose sum of squares is 2^62 or more,
    if there are any, meet the others in whole numbers of any size: ranks are exact,
    and a score that no long holds is null. A repeated row counts once per repetition as
    candidate; as query an id counts once, by its smallest usable vector. Other
    columns are not carried; empty tables give no rows.

    All queries meet all vectors, both packed into blocks: every task takes some
    blocks of queries past some of candidates and keeps k rows a query.
    """
    v = F.col(vec_col).cast("array<double>")
    whole = lambda df: df.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    usable = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False))) & (F.size("v") > 0)
    large = F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.abs(x * scale) + 1) * (F.abs(x * scale) + 1)) >= LARGEST
    asked, held = whole(queries).where(usable).groupBy("id").agg(F.min("v").alias("v")), whole(vectors).where(usable)
    if held.where(large).isEmpty() and whole(queries).where(usable & large).isEmpty():
        return _ranked(_searched(held, asked, k, scale, query_rows, candidate_rows, blocks_a_task), k, F.desc("score"))
    small = _searched(held.where(~large), asked.where(~large), k, scale, query_rows, candidate_rows, blocks_a_task)
    small = small.select("query_id", "vec_id", "score", _limbs_of_long(F.col("score")).alias("limbs"))
    wide = _exact(held.where(large), asked, k, scale).unionByName(_exact(held.where(~large), asked.where(large), k, scale))
    sign = F.element_at("limbs", 1)
    inner = F.slice("limbs", 2, F.lit(LIMBS - 2))
    value = F.element_at("limbs", LIMBS) - F.when(sign < 0, F.lit(Decimal(10**DIGITS)).cast("decimal(38,0)")).otherwise(0)
    plain = ((sign == 0) & F.forall(inner, lambda x: x == 0)) | ((sign == -1) & F.forall(inner, lambda x: x == Decimal(10**DIGITS - 1)))
    wide = wide.select("query_id", "vec_id", F.when(plain & value.between(-(2**63), 2**63 - 1), value).cast("long").alias("score"), "limbs")
    return _ranked(small.unionByName(wide), k, F.desc("limbs"))


def _ranked(found: DataFrame, k: int, best: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(best, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(held: DataFrame, asked: DataFrame, k: int, scale: float, query_rows: int, candidate_rows: int, blocks_a_task: int) -> DataFrame:
    """``query_id, vec_id, score``: the best of every task, of vectors whose scores fit a long."""
    asked = reliable(_packed(asked, scale, query_rows).select(F.col("size").alias("with_size"), F.col("ids").alias("query_ids"), F.col("columns").alias("queries"), F.monotonically_increasing_id().alias("block")))
    asked = compact(asked, asked.count(), blocks_a_task)
    stored = _packed(held, scale, candidate_rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests: dict[int, tuple[np.ndarray, Best]] = {}
        for batch in batches:
            for size, ids, columns, with_size, query_ids, rows, block in zip(*batch.columns, strict=True):
                if size.as_py() != with_size.as_py():
                    continue
                ids, query_ids = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(query_ids.as_buffer(), np.int64)
                if block.as_py() not in bests:
                    bests[block.as_py()] = (query_ids.copy(), Best(len(query_ids), k))
                columns = np.frombuffer(columns.as_buffer(), np.float64).reshape(size.as_py(), -1)
                rows = np.ascontiguousarray(np.frombuffer(rows.as_buffer(), np.float64).reshape(size.as_py(), -1).T)
                search_block(bests[block.as_py()][1], query_ids, rows, ids, columns)
        for query_ids, best in bests.values():
            got = best.ids != _NONE
            query = np.repeat(query_ids, k).reshape(best.ids.shape)
            yield pa.RecordBatch.from_arrays([pa.array(query[got]), pa.array(best.ids[got]), pa.array(best.scores[got])], schema=_ARROW)

    # A stated query set against all rows, block by block.
    return stored.crossJoin(asked.hint("shuffle_replicate_nl")).mapInArrow(scan, FOUND)


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
