"""Toxicity by a factorization machine over hashed terms.

Each term has a weight and a short factor; two terms of one text add the product
of their factors. So a term that is harmless alone can turn another one toxic,
which additive weights cannot say.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import first, thinned
from .words import NOT_LETTER, slices, word_hashes

#: Learning looks at so many labelled documents at most; terms are hashed to so
#: many buckets, and every bucket that occurs in those documents is a feature.
SAMPLE, BUCKETS, FACTORS = 20_000, 1 << 18, 8
#: Of learning: the penalties of a weight and of a factor, steps a phase, rounds without gain that end it, and least steps of a round.
L1, GROUP, STEPS, PATIENCE, ROUND = 4e-3, 1e-3, 400, 8, 10


@dataclass
class Machine:
    feature: np.ndarray  # bucket -> feature, -1 for none
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, texts: pa.Array) -> np.ndarray:
        """Log odds of each text."""
        hashes, bounds = word_hashes(texts, NOT_LETTER)
        feature = self.feature[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        has = feature >= 0
        pairs = np.unique(text[has] * np.int64(len(self.weight) + 1) + feature[has])
        return self._margin(pairs // (len(self.weight) + 1), pairs % (len(self.weight) + 1), len(bounds) - 1)

    def _margin(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(text, weights=self.weight[feature], minlength=n)
        for f in range(self.factor.shape[1]):
            v = self.factor[feature, f]
            out += 0.5 * (np.bincount(text, weights=v, minlength=n) ** 2 - np.bincount(text, weights=v * v, minlength=n))
        return out


def _terms(labelled: DataFrame) -> DataFrame:
    """``toxic, place, terms``: each text's distinct buckets."""
    schema = pa.schema([("toxic", pa.int32()), ("place", pa.int64()), ("terms", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                hashes, bounds = word_hashes(part.column(2), NOT_LETTER)
                bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int32)
                terms = [np.unique(bucket[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(terms, pa.list_(pa.int32()))], schema=schema)

    return labelled.mapInArrow(work, "toxic int, place long, terms array<int>")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 0) -> Machine:
    """Learn from ``SAMPLE`` labelled documents at most (those of the smallest
    hashed ids; where labels of one id differ the larger holds). Spark hashes the
    terms of their whole texts; the driver fits the machine on the buckets."""
    some = thinned(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()), SAMPLE, id_col)
    known = some.groupBy(id_col).agg(F.max(F.col(label_col)).cast("int").alias("__toxic"))
    picked = first(known, SAMPLE, id_col)
    joined = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(picked), id_col)
    held = _terms(joined.select(F.col("__toxic").alias("toxic"), F.xxhash64(id_col, "__text").alias("place"), F.col("__text").alias("text"))).toArrow()
    order = np.argsort(held["place"].to_numpy(), kind="stable")  # whatever order Spark gave
    toxic, lists, feature = held["toxic"].to_numpy()[order].astype(float), held["terms"].combine_chunks(), np.full(BUCKETS, -1, np.int32)
    if not len(toxic) or toxic.sum() in (0, len(toxic)):
        rate = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.01
        return Machine(feature, float(np.log(rate / (1 - rate))), np.zeros(1), np.zeros((1, FACTORS)))
    lists = lists.take(pa.array(order))
    terms, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    seen = np.unique(terms)
    feature[seen] = np.arange(len(seen))
    return _fit(feature, feature[terms], sizes, toxic, seed)


def _fit(feature: np.ndarray, terms: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, seed: int, batch: int = 256) -> Machine:
    """AdaGrad over batches in two phases; a step touches the features of its rows only.

    First the weights alone, under an L1 penalty that leaves few of the many terms of
    few documents. Then the factors beside them: the weights that are left grow free
    of the penalty, others may still come in against it, and each factor is shrunk as
    a whole. No term's part in a pair is judged by how it goes with the label alone:
    a factor starts and moves by how often its term occurs, and nothing else. Each
    phase ends with the state of the least loss on a fifth of the rows, set apart."""
    rng = np.random.default_rng(seed)
    begin = np.cumsum(sizes) - sizes

    def of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some rows each of their terms is in, and the terms."""
        n = sizes[some]
        text = np.repeat(np.arange(len(some)), n)
        return text, terms[np.arange(len(text)) + (begin[some] - np.cumsum(n) + n)[text]]

    size = max(1, int(feature.max()) + 1)
    machine = Machine(feature, float(np.log(toxic.mean() / (1 - toxic.mean()))), np.zeros(size), np.zeros((size, 0)))
    test = rng.random(len(toxic)) < 0.2
    train_rows = np.flatnonzero(~test)
    apart = np.flatnonzero(test) if toxic[test].sum() >= 20 and not toxic[test].all() else np.arange(len(toxic))
    n = np.bincount(of(train_rows)[1], minlength=size)
    often = n / (n + 50.0)
    square_w, square_v = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3)
    free = np.zeros(size, bool)
    # What a rate of few rows is off by goes with the root of their number; so do the penalties, for few rows.
    few = max(1.0, math.sqrt(2500 / max(1, len(train_rows))))
    for phase in ("weights", "factors"):
        if phase == "factors":
            free = machine.weight != 0
            machine.factor = rng.normal(0, 0.03, (size, FACTORS)) * often[:, None]
        k = machine.factor.shape[1]
        least, kept, since, steps = np.inf, None, 0, 0
        while since < PATIENCE and (steps < STEPS or kept is None):
            batches = []
            while len(train_rows) and len(batches) < ROUND:  # a few rows are passed several times
                rng.shuffle(train_rows)
                batches += [train_rows[lo : lo + batch].copy() for lo in range(0, len(train_rows), batch)]
            for some in batches:
                text, f = of(some)
                grad = (_chance(machine._margin(text, f, len(some))) - toxic[some]) / len(some)
                here, at = np.unique(f, return_inverse=True)
                g = np.bincount(at, weights=grad[text], minlength=len(here))
                square_w[here] += g * g
                pace = 0.1 / np.sqrt(square_w[here])
                w = machine.weight[here] - pace * g
                machine.weight[here] = np.where(free[here], w, np.sign(w) * np.maximum(0, np.abs(w) - L1 * few * pace))
                if k:
                    v = machine.factor[f]
                    sums = np.stack([np.bincount(text, weights=v[:, c], minlength=len(some)) for c in range(k)], 1)
                    own = grad[text, None] * (sums[text] - v)
                    g = np.stack([np.bincount(at, weights=own[:, c], minlength=len(here)) for c in range(k)], 1) * often[here, None]
                    square_v[here] += g * g
                    pace = 0.05 * often[here, None] / np.sqrt(square_v[here])
                    v = machine.factor[here] - pace * g
                    norm = np.sqrt((v * v).sum(axis=1)) + 1e-12
                    machine.factor[here] = v * np.maximum(0, 1 - GROUP * few * pace.mean(axis=1) / norm)[:, None]
                machine.bias -= 0.1 * float(grad.sum())
                steps += 1
            p = np.clip(_chance(machine._margin(*of(apart), len(apart))), 1e-9, 1 - 1e-9)
            loss = -float(np.mean(np.where(toxic[apart] > 0, np.log(p), np.log(1 - p))))
            since += 1
            if loss < least:
                least, kept, since = loss, (machine.bias, machine.weight.copy(), machine.factor.copy()), 0
            if not len(train_rows):
                break
        machine.bias, machine.weight, machine.factor = kept
    # The cut that the rows set apart like best (by F1) becomes log odds 0.
    z = machine._margin(*of(apart), len(apart))
    by = np.argsort(-z, kind="stable")
    hits = np.cumsum(toxic[apart][by])
    f1 = 2 * hits / (np.arange(1, len(by) + 1) + toxic[apart].sum())
    best = int(np.argmax(f1))
    nearest = z[by[min(best + 1, len(by) - 1)]]
    machine.bias -= float((z[by[best]] + nearest) / 2)
    return machine


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scores(machine: Machine, spark: SparkSession, text: str) -> Column:
    """The score of a text column; only texts leave the JVM."""
    sent = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        parts = slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0)
        z = np.concatenate([*(sent.value.margin(part.column(0)) for part in parts), np.zeros(0)])
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return judge(F.col(text))


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id and ``score`` (0 to 1).

    Whole texts are read; null and empty texts get the machine's bias as score.
    Rows stay as they are: repeated, null ids and empty tables alike; equal
    texts get equal scores. Other columns are not carried.
    """
    return docs.select(F.col(id_col), _scores(machine, docs.sparkSession, text_col).alias("score"))


def _held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = train(docs, labels.where(~_held_out()))
    return score(docs, machine).select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, most: float = 0.5) -> DataFrame:
    """The documents with a toxicity score under ``most``. Null and empty texts
    have the machine's bias as score; null ids and repeated rows are rows like
    others; columns of any names are as they were; an empty table gives no rows."""
    machine = train(docs, labels.where(~_held_out()))
    judged = docs.select(F.struct(*docs.columns).alias("doc"), _scores(machine, docs.sparkSession, "text").alias("score"))
    return judged.where(F.col("score") < most).select("doc.*")
