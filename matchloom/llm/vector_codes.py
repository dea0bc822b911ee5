"""Vectors as short codes: product quantisation in whole numbers, entries found by a GNAT.

Vectors are cut into equal parts and every part position has a codebook. Nearest
entries are searched in a geometric near-neighbour access tree over the codebook: a
node holds split points, every split point holds the range of its distances to each
child's entries, and a query's distance to a split point rules out the children whose
range it misses by more than the best distance so far. Distances for this are
rounded so that only what is strictly farther can be ruled out; what is left is
compared in whole numbers, ties by the entry's number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Sums leave a task as limbs of so many bits, so that any whole numbers can be summed by columns of longs.
LIMB = 30
#: Label sums up to this number of rows are sent to every task; more are joined by a shuffle.
SENT_LABELS = 100_000
_LONG = 2**63 - 1
_isqrt = np.frompyfunc(math.isqrt, 1, 1)


def squares_fit(points: np.ndarray, others: np.ndarray) -> bool:
    """Whether every squared distance between two such rows fits in a long."""
    most = [int(abs(x).max()) if x.size else 0 for x in (points, others)]
    return (most[0] + most[1]) ** 2 * max(1, points.shape[1]) < 2**62


def narrowed(points: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as longs, where they are small enough to be squared."""
    return points.astype(np.int64) if squares_fit(points, points) else points


def _squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    away = points - entry
    return (away * away).sum(axis=1)


def _roots(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the root from below and above: floats for longs, whole numbers for others."""
    if squared.dtype == object:
        low = _isqrt(squared)
        return low, low + (low * low != squared)
    root = np.sqrt(squared.astype(np.float64))
    return root * (1 - 2.0**-50), root * (1 + 2.0**-50)


class Gnat:
    """The tree over the rows of ``entries`` that ``members`` names."""

    def __init__(self, entries: np.ndarray, members: np.ndarray | None = None, *, splits: int = 4):
        members = np.arange(len(entries)) if members is None else members
        self.entries = entries
        self.points = self._far_apart(members, splits)
        rest = np.setdiff1d(members, self.points)
        away = np.stack([_squared(entries[rest], entries[p]) for p in self.points]) if len(rest) else np.zeros((len(self.points), 0))
        own = away.argmin(axis=0) if len(rest) else np.zeros(0, np.int64)
        sets = [np.append(rest[own == j], self.points[j]) for j in range(len(self.points))]
        self.low, self.high = [], []
        for p in self.points:
            bounds = [_roots(_squared(entries[s], entries[p])) for s in sets]
            self.low.append([low.min() for low, _ in bounds])
            self.high.append([high.max() for _, high in bounds])
        self.children = [Gnat(entries, s[:-1], splits=splits) if len(s) > 1 else None for s in sets]

    def _far_apart(self, members: np.ndarray, splits: int) -> np.ndarray:
        """Split points: the first member, then what is farthest from those chosen."""
        chosen = [members[0]]
        near = _squared(self.entries[members], self.entries[members[0]])
        while len(chosen) < min(splits, len(members)):
            left = ~np.isin(members, chosen)
            chosen.append(members[left][near[left].argmax()])
            near = np.minimum(near, _squared(self.entries[members], self.entries[chosen[-1]]))
        return np.array(chosen)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each query's nearest entry (the smallest number of equal ones), its squared
        distance, and how many distances were computed."""
        if not squares_fit(queries, self.entries):
            queries = queries.astype(object)
        elif queries.dtype == object and self.entries.dtype != object:
            queries = queries.astype(np.int64)
        best = _squared(queries, self.entries[self.points[0]])
        found = np.full(len(queries), self.points[0])
        return found, best, len(queries) + self._search(queries, np.arange(len(queries)), found, best, True)

    def _search(self, queries: np.ndarray, rows: np.ndarray, found: np.ndarray, best: np.ndarray, top: bool = False) -> int:
        live = np.ones((len(rows), len(self.points)), bool)
        computed = 0
        for i, p in enumerate(self.points):
            mine = np.flatnonzero(live[:, i])
            if not len(mine):
                continue
            at = rows[mine]
            squared = best[at] if top and i == 0 else _squared(queries[at], self.entries[p])
            computed += 0 if top and i == 0 else len(at)
            closer = (squared < best[at]) | ((squared == best[at]) & (p < found[at]))
            best[at[closer]], found[at[closer]] = squared[closer], p
            low, high = _roots(squared)
            reach = _roots(best[at])[1]
            if reach.dtype != object:
                reach = reach * (1 + 2.0**-50)  # for the rounding of the differences below
            for j in range(len(self.points)):
                if j != i or self.children[j] is not None:
                    # The split point itself is in its child's range, but its distance is known by now.
                    out = (self.low[i][j] - high > reach) | (low - self.high[i][j] > reach)
                    live[mine[out.astype(bool)], j] = False
        for j, child in enumerate(self.children):
            if child is not None and len(at := rows[live[:, j]]):
                computed += child._search(queries, at, found, best)
        return computed


def whole_numbers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for finite doubles, exact at any size: longs, or Python's
    whole numbers where a component reaches 2^62. ``scale`` is a power of two."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if not len(flat) or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    exact = lambda x: int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)
    return np.array([exact(x) for x in flat.tolist()], dtype=object)


def _limbs(sums: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers ``l0, l1, ...`` with ``sums = l0 + l1 * 2^LIMB + ...``."""
    while sums.dtype == object and any(abs(int(x)) >= 2**62 for x in sums):
        yield np.array([int(x) & (2**LIMB - 1) for x in sums], np.int64)
        sums = np.array([int(x) >> LIMB for x in sums], dtype=object)
    sums = sums.astype(np.int64)
    yield sums & (2**LIMB - 1)
    yield sums >> LIMB


def _matrices(batches: Iterator[pa.RecordBatch], column: int, width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Every batch with its vectors (all of ``width`` components) as whole numbers."""
    for batch in batches:
        flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
        points = whole_numbers(flat, scale).reshape(-1, width)
        yield batch, narrowed(points) if points.dtype == object else points


class Codebooks:
    """The entries of every part position, ``books[part]``: entries x components."""

    def __init__(self, books: list[np.ndarray], scale: int):
        self.books, self.scale = [narrowed(b) if b.dtype == object else b for b in books], scale

    @property
    def width(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()

    def trees(self) -> list[Gnat]:
        return [Gnat(b) for b in self.books]

    def decode(self, codes: DataFrame, code_col: str = "code") -> DataFrame:
        """``codes`` with ``decoded``: the entries that its codes name, as doubles; null for null."""
        books, scale = [b.astype(np.float64) for b in self.books], self.scale

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(names.index(code_col)).to_pylist()
                rows = [None if c is None else np.concatenate([b[int(c[2 * p : 2 * p + 2], 16)] for p, b in enumerate(books)]) / scale for c in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*names, "decoded"])

        codes = codes.drop("decoded")
        names = codes.columns
        return codes.mapInArrow(work, codes.select("*", F.array().cast("array<double>").alias("decoded")).schema)


def _usable(vectors: DataFrame, id_col: str, vec_col: str, *more) -> DataFrame:
    """``id, v`` and more columns of the rows whose vector holds finite numbers only."""
    rows = vectors.select(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{vec_col}`"].cast("array<double>").alias("v"), *more)
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False))))


def fit(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> Codebooks | None:
    """Codebooks over all usable vectors (see ``encode``); None if there are none.

    Each round is one scan: tasks assign their vectors' parts and send sums and
    counts by entry, which are added up before the driver gets them, so it holds
    ``entries`` times a vector's components whatever the number of rows."""
    rows = _usable(vectors, id_col, vec_col)
    in_order = [F.col("id").asc_nulls_last(), "v"]
    first = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*in_order).select(F.size("v")).first()
    if first is None:
        return None
    width = first[0]
    rows = rows.where(F.size("v") == width)
    seeds = np.array([r.v for r in rows.orderBy(*in_order).limit(entries).collect()], np.float64)
    books = Codebooks(np.split(whole_numbers(seeds.ravel(), scale).reshape(-1, width), parts, axis=1), scale)
    for _ in range(rounds):
        books = _improved(rows, books)
    return books


def _improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    trees, scale, width = books.trees(), books.scale, books.width
    parts, entries = len(books.books), len(books.books[0])
    each = width // parts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of every part and entry the sums by position and, at the end, the count.
        total = np.zeros((parts, entries, each + 1), dtype=object)
        seen = False
        for _, points in _matrices(batches, 0, width, scale):
            seen = seen or len(points) > 0
            small = points.dtype != object and (not points.size or int(np.abs(points).max()) * len(points) < 2**62)
            for p, tree in enumerate(trees):
                mine = points[:, p * each : (p + 1) * each]
                found, _, _ = tree.nearest(mine)
                order = np.argsort(found, kind="stable")
                at = np.flatnonzero(np.append(True, found[order][1:] != found[order][:-1])) if len(found) else np.zeros(0, np.int64)
                if len(at):
                    sums = np.add.reduceat(mine[order] if small else mine[order].astype(object), at, axis=0)
                    total[p, found[order][at], :each] += sums
                    total[p, :, each] += np.bincount(found, minlength=entries)
        if seen:
            flat = total.ravel()
            place = np.arange(len(flat))
            for n, limb in enumerate(_limbs(flat)):
                some = limb != 0
                yield pa.RecordBatch.from_arrays([pa.array(place[some], pa.int64()), pa.array(np.full(some.sum(), n), pa.int32()), pa.array(limb[some])], names=["place", "limb", "value"])

    summed = rows.select("v").mapInArrow(work, "place long, limb int, value long")
    # Limbs of one task may be split otherwise than another's; each has its own power.
    got = summed.groupBy("place", "limb").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(parts * entries * (each + 1), dtype=object)
    for r in got:
        total[r.place] += int(r.value) << (LIMB * r.limb)
    total = total.reshape(parts, entries, each + 1)
    new = []
    for p, old in enumerate(books.books):
        book = old.astype(object)
        used = total[p, :, each] > 0
        book[used] = total[p, used, :each] // total[p, used, each:]
        new.append(book)
    return Codebooks(new, scale)


def encode(vectors: DataFrame, books: Codebooks | None, *more, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id``, the columns ``more``, ``code`` (two hex digits a part), ``error`` (the
    squared distances to the entries, summed) and ``too_far`` of every usable vector.

    Rows whose vector is null or holds null or non-finite components are dropped,
    as they have no code. Components count as floor(scale * x) at any size; an error
    that no long holds is null and told by ``too_far``. All vectors have the length
    of the first one (by id, nulls last) that cuts into equal parts; vectors of another
    length take no part in the fit and have a null code and error. Rows with equal
    or null ids are rows like others; the first entries are those of the smallest
    ids, of equal ids the smaller vectors first. Empty tables give no rows."""
    rows = _usable(vectors, id_col, vec_col, *more)
    none = {"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long"), "too_far": F.lit(False)}
    if books is None:
        return rows.drop("v").withColumns(none)
    trees, scale, width = books.trees(), books.scale, books.width
    each = width // len(trees)
    names = [c for c in rows.columns if c != "v"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points in _matrices(batches, len(names), width, scale):
            codes, errors = np.zeros((len(points), len(trees)), np.uint8), np.zeros(len(points), dtype=object)
            for p, tree in enumerate(trees):
                codes[:, p], squared, _ = tree.nearest(points[:, p * each : (p + 1) * each])
                errors += squared
            far = errors > _LONG
            digits = codes.tobytes().hex()
            texts = [digits[2 * len(trees) * r : 2 * len(trees) * (r + 1)] for r in range(len(points))]
            errors[far] = None
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array(errors, pa.int64()), pa.array(far.astype(bool))], names=[*names, "code", "error", "too_far"])

    schema = rows.drop("v").withColumns(none).schema
    fits = F.size("v") == width
    coded = rows.where(fits).select(*names, "v").mapInArrow(work, schema)
    return coded.union(rows.where(~fits).drop("v").withColumns(none))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` (label, error, too_far) with ``label_error``: the errors of its label
    summed, nulls together; null where no long holds it."""
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = stored(coded.groupBy("label").agg(F.when(~F.max("too_far") & (whole <= _LONG), whole).cast("long").alias("label_error"))).withColumnRenamed("label", "of")
    if sums.count() <= SENT_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = fit(vectors)
    coded = with_label_error(stored(encode(vectors, books, F.col("label"))))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest() if books else None).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The whole fit in SQL, round by round."""
    out = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // (n // {parts}) AS part, (i - 1) % (n // {parts}) AS place, v[i] AS c
  FROM (SELECT vec_id, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS i FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}),
b0 AS MATERIALIZED (SELECT part, entry, place, c FROM x JOIN first USING (vec_id)),"""
    for r in range(rounds + 1):
        out += f"""
a{r} AS MATERIALIZED (SELECT vec_id, part, min(d * {entries} + entry) AS m FROM
  (SELECT x.vec_id, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c))::HUGEINT AS d FROM x JOIN b{r} b ON x.part = b.part AND x.place = b.place GROUP BY 1, 2, 3) GROUP BY 1, 2),"""
        if r < rounds:
            out += f"""
s{r} AS (SELECT a.part, a.m % {entries} AS entry, x.place, sum(x.c)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} a JOIN x ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY 1, 2, 3),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, b.c)::BIGINT AS c
  FROM b{r} b LEFT JOIN s{r} s ON s.part = b.part AND s.entry = b.entry AND s.place = b.place),"""
    return out + f"""
e AS (SELECT vec_id, string_agg(printf('%02x', (m % {entries})::INTEGER), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{rounds})
SELECT k.vec_id, e.code, e.error, sum(e.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, h.codebooks_sha256
FROM kept k JOIN e USING (vec_id) CROSS JOIN h
"""


ORACLE_SQL = _oracle()
