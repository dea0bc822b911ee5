import hashlib
import math

import numpy as np
import pytest

from matchloom import session
from matchloom.llm import vector_codes as codes
from matchloom.llm.vector_codes import Gnat, fit, encode, whole_numbers, with_label_error


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error, label error, digest) of rows (id, label, vector), in Python's whole numbers."""
    kept = [(i, label, [math.floor(x) * scale if abs(x) >= 2**53 else math.floor(scale * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = next((len(v) for _, _, v in order if v and len(v) % parts == 0), None)
    if width is None:
        return sorted([(i, None, None, None, None) for i, _, _ in kept], key=repr)
    each = width // parts
    cut = lambda v: [v[p * each : (p + 1) * each] for p in range(parts)]
    fitting = [(i, label, cut(v)) for i, label, v in order if len(v) == width]
    books = [[v[p] for _, _, v in fitting[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        got = [assign(v) for _, _, v in fitting]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for (_, _, v), a in zip(fitting, got, strict=True) if a[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums, over = [], {}, set()
    for i, label, v in fitting:
        a = assign(v)
        error = sum(far(v[p], books[p][a[p]]) for p in range(parts))
        sums[label] = sums.get(label, 0) + error
        out.append((i, label, "".join(f"{x:02x}" for x in a), error if error < 2**63 else None))
    out += [(i, label, None, None) for i, label, v in kept if len(v) != width]
    return sorted([(i, c, e, s if (s := sums.get(label)) is not None and s < 2**63 else None, digest) for i, label, c, e in out], key=repr)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, label string, embedding array<{kind}>, code string, error int").repartition(4)


def result(df):
    books = fit(df)
    coded = with_label_error(session.stored(encode(df, books, df["label"])))
    return sorted([(r.id, r.code, r.error, r.label_error, books and books.digest()) for r in coded.collect()], key=repr)


def random_rows(seed, n=90, width=16, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, width)) * 3
    return [(int(i), ["a", "b", None][i % 3], [float(np.float32(x)) for x in middles[i % 5] + rng.normal(size=width) * spread]) for i in rng.permutation(n)]


def test_against_brute_force(spark):
    rows = random_rows(0) + [(200, "a", None), (201, "b", [None] * 16), (202, None, [float("nan")] * 16), (203, "a", [float("inf")] * 16), (None, "z", [1.0] * 16), (3, "a", [0.5] * 16), (-5, "c", [0.1] * 15), (-6, "c", []), (204, "d", [0.25] * 24)]
    rows += [(300, "hot", rows[0][2])] * 40
    with session.scratch():
        df = table(spark, rows)
        want = brute(rows)
        assert result(df) == want
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        limit, codes.SENT_LABELS = codes.SENT_LABELS, 0
        try:
            assert result(df) == want
        finally:
            codes.SENT_LABELS = limit
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rows", [[], [(1, "a", None)], [(1, "a", [1.0] * 5)], [(1, None, [0.5] * 8)], random_rows(4, n=9, width=8)])
def test_small_tables(spark, rows):
    with session.scratch():
        assert result(table(spark, rows)) == brute(rows)


def test_numbers_of_any_size(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.normal(size=8) * 2.0 ** rng.integers(0, 60)]) for i in range(60)]
    rows += [(70, "c", [1e30, -3e38] * 4), (71, "c", [1.7e308, -1.7e308] * 4), (72, "d", [5e-324] * 8), (73, "d", [-5e-324] * 8)]
    with session.scratch():
        assert result(table(spark, rows, "double")) == brute(rows)
    assert whole_numbers(np.array([1.5, -1e300, 2.0**53 + 2]), 4096).tolist() == [6144, -int(1e300) * 4096, (2**53 + 2) * 4096]


@pytest.mark.parametrize("kind", ["even", "lumps", "ties", "large", "huge"])
def test_tree_against_all_distances(kind):
    rng = np.random.default_rng(3)
    for k in (1, 2, 5, 16, 100):
        spread = {"even": 4000, "lumps": 40, "ties": 2, "large": 2**28, "huge": 2**28}[kind]
        entries = rng.integers(-spread, spread + 1, (k, 6))
        queries = rng.integers(-spread, spread + 1, (300, 6))
        if kind == "lumps":
            entries += rng.integers(0, 4, (k, 1)) * 100_000
            queries += rng.integers(0, 4, (300, 1)) * 100_000
        if kind == "huge":
            entries, queries = entries.astype(object) * 10**30, queries.astype(object) * 10**30
        away = np.array([[sum((int(x) - int(y)) ** 2 for x, y in zip(q, e)) for e in entries] for q in queries], dtype=object)
        found, squared, computed = Gnat(entries).nearest(queries)
        assert found.tolist() == [row.tolist().index(min(row)) for row in away]  # the smallest number of equal ones
        assert squared.tolist() == [min(row) for row in away]
        assert computed <= 300 * k
        if kind == "lumps" and k == 100:
            assert computed < 0.5 * 300 * k  # whole subtrees are ruled out


def test_decoded_vectors_are_the_entries(spark):
    rows = random_rows(7)
    with session.scratch():
        df = table(spark, rows)
        books = fit(df)
        got = books.decode(session.stored(encode(df, books))).collect()
        vectors = {i: v for i, _, v in rows}
        for r in got:
            away = sum((math.floor(4096 * x) - round(4096 * y)) ** 2 for x, y in zip(vectors[r.id], r.decoded, strict=True))
            assert away == r.error
