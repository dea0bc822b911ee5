"""Language identification by words first, then shorter and shorter n-grams.

A known word scores by its log frequency in each language. An unseen word backs
off: at each of its characters the longest known n-gram that begins there, from
five characters down to one, gives the score, and the word has their mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable
from .samples import first, thinned
from .words import _VALUE, NOT_LETTER, _pieces, _power, mix, raw, slices

LONGEST = 5
#: Learning looks at so many labelled documents at most; all of their words and n-grams are kept.
SAMPLE = 12_000

#: Lower case of ASCII; all that is no letter reads as one space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[NOT_LETTER] = 32


class Table:
    """Hashed strings with a row of per-language scores each."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray):
        size = 1 << max(4, (2 * len(hashes)).bit_length())
        self.keys, self.rows, self.mask = np.zeros(size, np.uint64), np.full(size, -1, np.int32), np.uint64(size - 1)
        self.scores = scores.astype(np.float32)
        todo, at = np.arange(len(hashes)), hashes & self.mask
        while len(todo):
            free = np.flatnonzero(self.rows[at[todo]] < 0)
            free = free[np.unique(at[todo][free], return_index=True)[1]]  # one string a slot
            self.rows[at[todo[free]]], self.keys[at[todo[free]]] = todo[free], hashes[todo[free]]
            todo = np.delete(todo, free)
            at[todo] = (at[todo] + np.uint64(1)) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where unknown."""
        at = hashes & self.mask
        out = np.full(len(hashes), -1, np.int32)
        todo = np.arange(len(hashes))
        while len(todo):
            row = self.rows[at[todo]]
            hit = (row >= 0) & (self.keys[at[todo]] == hashes[todo])
            out[todo[hit]] = row[hit]
            todo = todo[(row >= 0) & ~hit]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
        return out


def _hashes(strings: pa.Array) -> np.ndarray:
    """The hash of each string."""
    data, offsets = raw(strings)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[_FOLD[data]] * up[: len(data)], out=sums[1:])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]])


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: list[Table]  # of 1, 2, ... characters

    def log_scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sums of word scores (texts x languages) and word counts of lower-cased texts."""
        data, offsets = raw(texts)
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for lo, hi in _pieces(data, offsets, NOT_LETTER):
            part = data[lo:hi]
            letter = ~NOT_LETTER[part]
            edge = np.zeros(len(part) + 1, bool)
            edge[offsets[(offsets >= lo) & (offsets <= hi)] - lo] = True
            starts = np.flatnonzero(letter & (edge[:-1] | np.concatenate([[True], ~letter[:-1]])))
            ends = np.flatnonzero(letter & (edge[1:] | np.concatenate([~letter[1:], [True]]))) + 1
            if not len(starts):
                continue
            up, down = _power(len(part) + 2)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUE[_FOLD[part]] * up[: len(part)], out=sums[1:])
            text = np.searchsorted(offsets, starts + lo, "right") - 1
            count += np.bincount(text, minlength=len(count))
            row = self.words.find(mix((sums[ends] - sums[starts]) * down[starts]))
            known = row >= 0
            for i in range(total.shape[1]):
                total[:, i] += np.bincount(text[known], weights=self.words.scores[row[known], i], minlength=len(total))
            if not known.all():
                self._back_off(total, text[~known], starts[~known], ends[~known], part)
        return total, count

    def _back_off(self, total: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: np.ndarray) -> None:
        # The unseen words alone, each between two spaces.
        sizes = ends - starts + 2
        begin = np.cumsum(sizes) - sizes
        flat = np.full(int(sizes.sum()), 32, np.uint8)
        inner = np.arange(len(flat)) - np.repeat(begin, sizes)
        inside = (inner > 0) & (inner < np.repeat(sizes, sizes) - 1)
        flat[inside] = _FOLD[part[(np.repeat(starts, sizes) + inner - 1)[inside]]]
        up, down = _power(len(flat) + 1)
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_VALUE[flat] * up[: len(flat)], out=sums[1:])
        chars = np.flatnonzero((flat & 0xC0) != 0x80)
        word = np.searchsorted(begin, chars, "right") - 1
        stop = np.append(chars, len(flat))
        last = np.searchsorted(chars, begin + sizes)  # the character after each word's own
        found = np.zeros(len(chars), bool)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # where the longest known n-gram is which
        at = np.arange(len(chars))
        for n in range(LONGEST, 0, -1):
            todo = np.flatnonzero(~found & (at + n <= last[word]))
            row = self.grams[n - 1].find(mix((sums[stop[todo + n]] - sums[chars[todo]]) * down[chars[todo]]))
            hit = row >= 0
            hits.append((todo[hit], row[hit], self.grams[n - 1].scores))
            found[todo[hit]] = True
        share = 1 / np.bincount(word, minlength=len(starts))  # a word has the mean of its characters
        score = np.zeros(len(chars))
        for i in range(total.shape[1]):
            score[:] = 0
            for place, row, scores in hits:
                score[place] = scores[row, i]
            total[:, i] += np.bincount(text[word], weights=score * share[word], minlength=len(total))


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from ``SAMPLE`` labelled rows at most (those of the smallest hashed
    ids), whole texts. Spark counts and hashes; the driver gets the hash and count of
    every word and n-gram of the sample once for each language."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    picked = first(thinned(usable.select(id_col), SAMPLE, id_col).distinct(), SAMPLE, id_col)
    some = usable.join(F.broadcast(picked), id_col, "left_semi").select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"))
    counts = some.select("lang", F.explode(F.split("text", r"[^a-z\x{80}-\x{10FFFF}]+")).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    counts = reliable(counts)
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    grams = None
    for n in range(1, LONGEST + 1):
        cut = F.transform(F.sequence(F.lit(1), F.length("word") + 3 - n), lambda i, n=n: F.substring(padded, i, F.lit(n)))
        part = counts.where(F.length("word") + 2 >= n).select("lang", "count", F.explode(cut).alias("gram"))
        grams = part if grams is None else grams.unionByName(part)
    langs = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    tables = [_scored(counts, langs)]
    grams = reliable(grams.groupBy("lang", F.col("gram").alias("word")).agg(F.sum("count").alias("count")))
    tables += [_scored(grams.where(F.length("word") == n), langs) for n in range(1, LONGEST + 1)]
    return Model(langs, tables[0], tables[1:])


def _scored(counts: DataFrame, langs: list[str]) -> Table:
    """Log frequencies by language, half a count added to each."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(batch.column(0)).view(np.int64)), batch.column(1), batch.column(2)], names=["hash", "lang", "count"])

    number = F.array_position(F.array(*map(F.lit, langs)).cast("array<string>"), F.col("lang")).cast("int") - 1
    got = counts.select("word", number.alias("lang"), "count").mapInArrow(hashed, "hash long, lang int, count long").toArrow()
    hashes, row = np.unique(got["hash"].to_numpy().view(np.uint64), return_inverse=True)
    seen = np.full((len(hashes), len(langs)), 0.5)
    np.add.at(seen, (row, got["lang"].to_numpy()), got["count"].to_numpy())
    return Table(hashes, np.log(seen / seen.sum(axis=0)) if len(hashes) else seen)


def _verdict(model: Model, spark: SparkSession, text: str) -> Column:
    """``lang_pred`` and ``score`` of a text column; only texts leave the JVM."""
    sent = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(lowered: pa.Array, letter: pa.Array) -> pa.Array:
        model, langs, scores = sent.value, [], []
        for part in slices(pa.RecordBatch.from_arrays([lowered, letter], names=["text", "letter"]), 0):
            has = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if not model.langs:
                langs += ["und"] * len(has)
                scores.append(np.zeros(len(has)))
                continue
            sums, count = model.log_scores(part.column(0))
            sums = sums * np.minimum(1, 20 / np.maximum(count, 1))[:, None]
            share = np.exp(sums - sums.max(axis=1, keepdims=True))
            langs += [model.langs[b] if h else "und" for b, h in zip(share.argmax(axis=1), has, strict=True)]
            scores.append(np.where(has, 1 / share.sum(axis=1), 0.0))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], fields=list(kind))

    return judge(F.lower(text), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, ``lang_pred`` and ``score``.

    ``score`` is the share of the likeliest language, from the summed scores of
    twenty words' worth at most, so mixed texts score lower. A text that is null
    or has no letter is ``und`` with score 0, as is any text where nothing was
    learned. Whole texts are read. Rows stay as they are: repeated, null ids,
    ties (the first language in name order wins) and empty tables alike.
    """
    judged = docs.select(F.col(id_col), _verdict(model, docs.sparkSession, text_col).alias("__verdict"))
    return judged.select(id_col, "__verdict.lang_pred", "__verdict.score")


def _held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~_held_out()))
    return identify(docs, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, least: float = 0.3) -> DataFrame:
    """The documents with letters whose language is told with a score of ``least``
    or more; the language is learned from the ``lang`` that these documents carry.
    Null and empty texts go; null ids stay and repeated rows stay repeated; columns
    of any names are as they were; an empty table gives no rows."""
    model = train(docs.where(~_held_out()))
    judged = docs.select(F.struct(*docs.columns).alias("doc"), _verdict(model, docs.sparkSession, "text").alias("verdict"))
    return judged.where((F.col("verdict.lang_pred") != "und") & (F.col("verdict.score") >= least)).select("doc.*")
