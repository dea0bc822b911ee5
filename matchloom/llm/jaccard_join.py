"""N-gram Jaccard join by vertical partitioning.

The n-grams (word shingles, as 64-bit hashes) of all documents have one global
order, which is cut into fragments. A fragment counts, apart from all others,
what documents share in its range; the counts are summed per document and per
pair.

1. *Classes.* Documents of equal shingle sets (told by a 128-bit digest) form a
   class; one set stands for it.
2. *Prune.* Fragments of the hash order's first half count how many of each
   class's shingles any other class has. A class that is linked lacks at most a
   quarter of its shingles in its partner, which bounds that sum from below.
   Shingles that several classes of one batch have are counted where they are
   read; one entry of them goes on, so a common one is no large group anywhere.
3. *Order.* For the classes left, document frequencies are counted with partial
   aggregation; each set is put in the order (frequency, hash), rarest first.
4. *Pairs.* Groups of near copies are first tied together by comparing each set
   with one other of the same minimum hash, so that no group's pairs are all
   emitted. Then two classes of different groups are a pair if a shingle lies in
   the first seventh of the smaller set and the first quarter of the larger one
   and the length and position bounds hold: such prefixes make this exact.
5. *Overlaps.* Segments of both sides meet by fragment, partial overlaps are
   counted there, and sums per pair decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import compact, reliable
from .words import shingle_sets, slices

#: Shingles that one fragment task takes in, about.
FRAGMENT = 1_500_000
#: Classes up to which keys are sent to all tasks instead of joined by a shuffle.
SENT_IDS = 500_000
#: Segments that a set is cut into when overlaps are counted.
SEGMENTS = 8
#: Minimum hashes by which near copies meet a partner.
HASHES = 4
#: Similarity 3/4: the overlap of two linked sets is 3/7 of their sizes' sum or more.
NUM, DEN = 3, 4


def _digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes(), seed=len(grams))


def _short(digest: bytes) -> int:
    """The first 64 bits, by which a class is told in fragments. Two classes of
    equal ones count as one there, which matters only if these two are linked."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _row(id_col: str, text_col: str) -> list[Column]:
    """A row's identity: its id, null told apart from every id, and its text's hash."""
    return [F.col(id_col).isNull().alias("no"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("print")]


ROW = ["no", "id", "print"]


def fingerprints(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``no, id, print, n, head, key, short`` per row: its identity, set size, size
    in the order's first half, class (null without words)."""
    schema = pa.schema([("no", pa.bool_()), ("id", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("head", pa.int32()), ("key", pa.binary()), ("short", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                size, head, key = [], [], []
                for grams in shingle_sets(part.column(3), n):
                    size.append(len(grams))
                    head.append(int(np.searchsorted(grams, np.uint64(1 << 63))))
                    key.append(_digest(grams) if len(grams) else None)
                short = [None if k is None else _short(k) for k in key]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(size, pa.int64()), pa.array(head, pa.int32()), pa.array(key, pa.binary()), pa.array(short, pa.int64())], schema=schema)

    given = docs.select(*_row(id_col, text_col), F.col(text_col).alias("text"))
    return given.mapInArrow(work, "no boolean, id long, print long, n long, head int, key binary, short long")


_SEGMENT = "f int, keys binary, single binary, several binary, grams binary, common binary"
_SEGMENT_ARROW = pa.schema([("f", pa.int32()), *((c, pa.binary()) for c in ("keys", "single", "several", "grams", "common"))])
#: Bytes of a shingle within its fragment. Equal ones of different shingles only make a class look more shared.
WIDTH = 6


def _low(grams: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def _fragments(sets: dict[int, np.ndarray], count: int) -> Iterator[dict]:
    """Some classes' sets (values under 2^63) by fragment, of which there are
    ``count``. Shingles of one class come with their owners; those of several
    are counted for each owner and come once, without owner."""
    keys = np.array(list(sets), np.int64)
    grams = np.concatenate(list(sets.values())) if sets else np.zeros(0, np.uint64)
    if not len(grams):
        return
    owner = np.repeat(np.arange(len(keys)), [len(g) for g in sets.values()])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    runs = np.diff(np.append(np.flatnonzero(new), len(grams)))
    several = np.repeat(runs > 1, runs)
    at = ((grams >> np.uint64(31)) * np.uint64(count)) >> np.uint64(32)
    cuts = [*np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])), len(at)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        who, mine = np.unique(owner[lo:hi], return_inverse=True)
        many, piece = several[lo:hi], grams[lo:hi]
        by = np.argsort(mine[~many], kind="stable")
        tally = lambda which: np.bincount(mine[which], minlength=len(who)).astype(np.uint32).tobytes()  # noqa: B023, E731
        yield {"f": int(at[lo]), "keys": keys[who].tobytes(), "single": tally(~many), "several": tally(many), "grams": _low(piece[~many][by]), "common": _low(piece[many & new[lo:hi]])}


def _wide(low: bytes) -> np.ndarray:
    part = np.frombuffer(low, np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :WIDTH] = part
    return out.view(np.uint64).ravel()


def _shared_in_fragment(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a fragment and how many of their shingles in it another class
    has too (or more, where copies of a class were counted in several batches)."""
    join = lambda name: b"".join(table.column(name).to_pylist())
    keys, mine = np.unique(np.frombuffer(join("keys"), np.int64), return_inverse=True)
    single, several = np.frombuffer(join("single"), np.uint32), np.frombuffer(join("several"), np.uint32)
    owner, grams, common = np.repeat(mine, single), _wide(join("grams")), np.unique(_wide(join("common")))
    order = np.lexsort((owner, grams))
    owner, grams = owner[order], grams[order]
    if len(grams):  # copies of a class bring the same shingle again
        first = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])
        owner, grams = owner[first], grams[first]
        new = np.concatenate([[True], grams[1:] != grams[:-1]])
        runs = np.diff(np.append(np.flatnonzero(new), len(grams)))
        shared = np.repeat(runs > 1, runs) | np.isin(grams, common, assume_unique=False)
        count = np.bincount(owner[shared], minlength=len(keys))
    else:
        count = np.zeros(len(keys), np.int64)
    whole = np.zeros(len(keys), np.int64)
    np.maximum.at(whole, mine, single.astype(np.int64) + several)
    return keys, np.minimum(whole, count + np.bincount(mine, weights=several, minlength=len(keys)).astype(np.int64))


def _shared_counts(docs: DataFrame, n: int, text_col: str, count: int) -> DataFrame:
    """``short, shared``: how many shingles of the first half another class has too, at least."""
    schema = pa.schema([("short", pa.int64()), ("shared", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                sets = {_short(_digest(g)): g[: np.searchsorted(g, np.uint64(1 << 63))] for g in shingle_sets(part.column(0), n) if len(g)}
                rows = list(_fragments(sets, count))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SEGMENT_ARROW)

    def work(table: pa.Table) -> pa.Table:
        keys, shared = _shared_in_fragment(table)
        return pa.Table.from_arrays([pa.array(keys), pa.array(shared)], schema=schema)

    segments = docs.select(F.col(text_col).alias("text")).mapInArrow(cut, _SEGMENT)
    return segments.groupBy("f").applyInArrow(work, "short long, shared long").groupBy("short").agg(F.sum("shared").alias("shared"))


def _sets(docs: DataFrame, n: int, text_col: str) -> DataFrame:
    """``key, n, grams`` of every text with words, each class once."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                sets = {_digest(g): g for g in shingle_sets(part.column(0), n) if len(g)}
                bounds = np.cumsum([0, *(len(g) for g in sets.values())])
                flat = np.concatenate([*sets.values(), np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))], schema=schema)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(work, "key binary, n long, grams array<long>").dropDuplicates(["key"])


def _ordered(sets: DataFrame) -> DataFrame:
    """``key, n, size, grams, low``: the shingles that two classes or more have,
    in the global order (frequency, hash), and their minimum hashes. Classes that
    share under three quarters of their shingles are dropped: they have no link."""
    each = sets.select("key", "n", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("often")).where("often > 1")
    low = F.array(*(F.min(F.xxhash64("gram", F.lit(j))) for j in range(HASHES)))
    whole = each.join(often, "gram").groupBy("key", "n").agg(F.count("*").cast("int").alias("size"), F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("order"), low.alias("low"))
    return whole.where(DEN * F.col("size") >= NUM * F.col("n")).select("key", "n", "size", F.col("order.gram").alias("grams"), "low")


def _by_segment(sets: DataFrame) -> DataFrame:
    """``key, f, seg``: each set cut by fragment of the hash order."""
    of = lambda f: F.struct(F.lit(f).alias("f"), F.filter("grams", lambda g: F.shiftrightunsigned(g, 61) == f).alias("seg"))
    return sets.select("key", F.explode(F.array(*map(of, range(SEGMENTS)))).alias("s")).select("key", "s.f", "s.seg").where(F.size("seg") > 0)


def _linked(pairs: DataFrame, segments: DataFrame) -> tuple[DataFrame, int]:
    """The pairs ``a, b`` (given with ``na, nb``) of similarity 3/4 or more and
    their number: partial overlaps by fragment, summed per pair."""
    pairs = reliable(pairs)
    count = pairs.count()
    if not count:
        return pairs.select("a", "b"), 0
    pairs = compact(pairs, count)
    sent = F.broadcast if count <= SENT_IDS else lambda df: df  # then only segments of paired sets move
    left = segments.withColumnsRenamed({"key": "a", "seg": "seg_a"}).join(sent(pairs), "a")
    right = segments.withColumnsRenamed({"key": "b", "seg": "seg_b"}).join(sent(pairs.select("b").distinct()), "b", "left_semi")
    partial = left.join(right, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("seg_a", "seg_b")).alias("part"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    linked = reliable(whole.where(DEN * F.col("both") >= NUM * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))
    count = linked.count()
    return compact(linked, count), count


def _ties(sets: DataFrame) -> DataFrame:
    """Pairs by which groups of near copies hang together: of all sets with one
    minimum hash each is paired with one of them. For the first hashes this is
    the set of the fewest shingles of its own (an original rather than its
    copies), for the last any, so that no set depends on one choice."""
    own = F.when(F.col("j") < HASHES - 1, F.col("n") - F.col("size")).otherwise(F.xxhash64("key"))
    some = sets.select("key", "n", "size", F.posexplode("low").alias("j", "bucket"))
    leaders = some.groupBy("j", "bucket").agg(F.min(F.struct(own.alias("o"), "key", "n")).alias("l"), F.count("*").alias("c")).where("c > 1")
    return some.join(leaders, ["j", "bucket"]).where(F.col("key") != F.col("l.key")).select(F.col("key").alias("a"), F.col("l.key").alias("b"), F.col("n").alias("na"), F.col("l.n").alias("nb")).distinct()


def _prefix_pairs(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs of different groups that can be linked. Of two linked sets the
    smaller has 6/7 of its shingles in common and the larger 3/4, so their first
    common one lies that far in front; single shingles rank first and need no row."""
    rows = sets.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("grp", F.coalesce("root", "key"))
    alone = F.col("n") - F.col("size")
    take = F.greatest(F.floor(F.col("n") / DEN) + 1 - alone, F.lit(0)).cast("int")
    prefixes = rows.select("key", "n", "grp", alone.alias("alone"), F.posexplode(F.slice("grams", F.lit(1), take)).alias("at", "gram"))
    prefixes = prefixes.select("gram", "key", "n", "grp", (F.col("alone") + F.col("at")).alias("rank"))
    mixed = prefixes.groupBy("gram").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("gram")
    prefixes = reliable(prefixes.join(mixed, "gram"))
    a, b = (prefixes.select("gram", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "rank", "grp"))) for side in "ab")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("key_a") < F.col("key_b")))
    most = F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b"))  # overlap if this is the first shared shingle
    near = (NUM + DEN) * most >= NUM * (F.col("n_a") + F.col("n_b"))
    met = a.where(7 * F.col("rank_a") <= F.col("n_a")).join(b, "gram").where(smaller & (F.col("grp_a") != F.col("grp_b")) & near)
    return met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb")).distinct()


def jaccard_classes(docs: DataFrame, *, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """``(members, links, count of links)``: ``members`` has ``no, id, print`` (see
    ``_row``), ``n`` and ``key`` of every row (``key`` null without words) and
    ``links`` the pairs ``a, b`` of class keys that tie all linked classes
    together (similarity 0.75 or more)."""
    prints = reliable(fingerprints(docs, n, id_col, text_col))
    members = prints.select(*ROW, "n", "key")
    none = members.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    total = prints.agg(F.sum("head")).first()[0] or 0
    classes = prints.where("key is not null").groupBy("key", "short", "n", "head").agg(F.min(F.struct(*ROW)).alias("one"))
    shared = _shared_counts(docs, n, text_col, max(16, -(-int(total) // FRAGMENT)))
    left = reliable(classes.join(shared, "short", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("head") - F.floor(F.col("n") / DEN)).select("one.*"))
    held = left.count()
    if not held:
        return members, none, 0
    some = docs.select(*_row(id_col, text_col), F.col(text_col).alias("text")).join(F.broadcast(left) if held <= SENT_IDS else left, ROW, "left_semi")
    sets = reliable(_ordered(reliable(_sets(some, n, "text"))))
    held = sets.count()
    if not held:
        return members, none, 0
    segments = reliable(_by_segment(sets))
    links, known = _linked(_ties(compact(sets.select("key", "n", "size", "low"), held)), segments)
    groups = connected_components(links, rows=known)
    more, count = _linked(_prefix_pairs(sets, groups), segments)
    stars = groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return members, stars.unionByName(more) if count else stars, known + count


def _components(members: DataFrame, links: DataFrame, count: int) -> DataFrame:
    """``key, part``: each class with a key of its component."""
    roots = connected_components(links, rows=count).withColumnsRenamed({"node": "key", "root": "part"})
    return members.where("key is not null").select("key").distinct().join(roots, "key", "left").select("key", F.coalesce("part", "key").alias("part"))


def jaccard_join(docs: DataFrame, *, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_shingles`` and ``component_id``.

    Words are runs of non-space (ASCII space, \\t to \\r), A-Z lower-cased. Two
    documents link when their shingle sets' Jaccard similarity is 0.75 or more;
    ``component_id`` is the smallest id that links reach. Null and empty texts
    have no shingles and link with nothing; rows with a null id are members like
    others, but only ids that are not null count as smallest (null where there is
    none); repeated rows link with each other; an empty table gives no rows.
    Other columns are not carried. Classes of equal sets are told by 128 bits.
    """
    members, links, count = jaccard_classes(docs, n=n, id_col=id_col, text_col=text_col)
    least = lambda df, by: df.groupBy(by).agg(F.min("least").alias("least"))
    classes = least(members.where("key is not null").select("key", F.when(~F.col("no"), F.col("id")).alias("least")), "key")
    if count:
        parts = reliable(_components(members, links, count).join(classes, "key"))
        classes = parts.drop("least").join(least(parts, "part"), "part").drop("part")
    own = F.when(~F.col("no"), F.col("id"))
    return members.join(classes, "key", "left").select(own.alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", own).alias("component_id"))


def keep_one(docs: DataFrame, *, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked rows, columns as they were: that of the
    smallest id, null ids last, among rows of one id by text. Of repeated rows
    (equal id and text) one stays; rows without words are no copies and all stay.
    Columns of any names are as they were; an empty table gives no rows.
    """
    members, links, count = jaccard_classes(docs, n=n, id_col=id_col, text_col=text_col)
    held = members.where("key is not null").groupBy(*ROW, "key").agg(F.count("*").alias("c"))
    held = held.join(_components(members, links, count), "key") if count else held.withColumn("part", F.col("key"))
    held = reliable(held.select("part", F.struct(*ROW).alias("row"), "c"))
    first = held.groupBy("part").agg(F.min("row").alias("first"))
    marked = held.join(first, "part").withColumn("stays", F.col("row") == F.col("first")).where("not stays or c > 1")
    marked = reliable(marked.select(F.col("row").alias("__row"), F.col("stays").alias("__again")))
    found = marked.count()
    sent = F.broadcast(marked) if found <= SENT_IDS else marked
    judged = docs.select(F.struct(*docs.columns).alias("__doc"), F.struct(*_row(id_col, text_col)).alias("__row")).join(sent, "__row", "left")
    rest = judged.where("__again is null").select("__doc.*")
    if marked.where("__again").isEmpty():
        return rest
    return rest.unionByName(judged.where("__again").dropDuplicates(["__row"]).select("__doc.*"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w,' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4],' '))) END AS g FROM w),
e AS (SELECT r, doc_id, len(g) AS n, unnest(g) AS x FROM s),
o AS (SELECT a.r AS ra, b.r AS rb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT ra, rb FROM o WHERE 100 * i >= 75 * (na + nb - i)),
y AS (SELECT ra AS u, rb AS v FROM l UNION SELECT rb, ra FROM l),
c(r, m) AS (SELECT r, r FROM s UNION SELECT c.r, y.v FROM c JOIN y ON c.m = y.u)
SELECT s.doc_id, any_value(len(s.g))::BIGINT AS n_shingles, min(t.doc_id) AS component_id
FROM s JOIN c ON s.r = c.r JOIN s t ON t.r = c.m GROUP BY s.r, s.doc_id
"""
