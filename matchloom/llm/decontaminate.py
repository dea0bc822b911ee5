"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a hash of the tokens that a fixed mask selects out of a short span;
the tokens that it passes over may differ. Seeds of the benchmark and of the
training texts meet in an equi-join; each hit gives a diagonal (how far the item
is shifted in the text), and along it the texts are compared token by token.

Masks are lossless for the rule below. Every window of 13 tokens with two
substitutions or fewer holds a span in which one of the two long masks avoids
them both; an item of 9 to 12 tokens with one substitution, and a whole one of 4
or more, holds a span of the short mask. So the join finds every overlap that
the comparison accepts. Masks that no item needs are not hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable

MASKS, SHORT_MASK = ("1111011", "111001011"), "1111"
#: An overlap is a window of so many tokens of which so many may differ. A shorter
#: item must be there as a whole: of LENIENT tokens or more one may differ. Items
#: under SHORTEST tokens are no evidence, as any text may hold them.
WINDOW, MISSES, LENIENT, SHORTEST = 13, 2, 9, 4
#: Rows up to which a table is sent to all tasks instead of joined by a shuffle.
SENT_SEEDS, SENT_HITS = 1_000_000, 300_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeded(df: DataFrame, ids: list[str], masks: list[str]) -> DataFrame:
    """``ids, seed, pos``: the seeds of every span of ``words``, a row each, so
    that hashing and joining them is compiled as one."""
    hashed = df.select(*ids, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    spans = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") * len(masks) - 1)).otherwise(F.array().cast("array<int>"))
    at = hashed.select(*ids, "h", F.explode(spans).alias("span")).select(*ids, "h", (F.col("span") % len(masks)).alias("mask"), F.floor(F.col("span") / len(masks)).cast("int").alias("pos"))
    seed = F.lit(None).cast("long")
    for k, mask in enumerate(masks):
        chosen = [F.get("h", F.col("pos") + i) for i, c in enumerate(mask) if c == "1"]
        seed = F.when((F.col("mask") == k) & (F.col("pos") + len(mask) <= F.size("h")), F.xxhash64(F.lit(mask), *chosen)).otherwise(seed)
    return at.select(*ids, seed.alias("seed"), "pos").where("seed is not null")


def _key(id_col: str, text_col: str) -> Column:
    """A row's identity: its id (null told apart from every id) and its text's hash."""
    return F.struct(F.col(id_col).isNull().alias("no"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("print"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, text_col, _key(id_col, text_col).alias("__row"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row and benchmark item that overlap: ``__row`` (see
    ``_key``), the item and ``matched``, the most equal tokens on a diagonal.

    Null and empty texts overlap with nothing. Equal items are reported each,
    items with a null id under that null; repeated document rows are reported
    once; empty tables give no rows.
    """
    items = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("words")).where(F.size("words") >= SHORTEST).distinct()
    items = items.withColumn("entry", F.xxhash64(F.col("item").isNull(), "item", "words"))  # items without id join too
    short = F.size("words") < WINDOW
    any_short, any_long = (x or 0 for x in items.agg(F.sum(short.cast("int")), F.sum((~short).cast("int"))).first())
    masks = [*(MASKS if any_long else ()), *([SHORT_MASK] if any_short else ())]
    if not masks:
        return _keyed(docs, id_col, text_col).select("__row", F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item"), F.lit(0).alias("matched")).limit(0)
    item_seeds = _seeded(items.where(~short), ["entry"], list(MASKS)).unionByName(_seeded(items.where(short), ["entry"], [SHORT_MASK]))
    item_seeds = reliable(item_seeds.withColumnRenamed("pos", "item_pos"))
    if item_seeds.count() <= SENT_SEEDS:
        item_seeds = F.broadcast(item_seeds)
    keyed = _keyed(docs.select(id_col, text_col), id_col, text_col)
    words = keyed.select("__row", tokens(F.col(text_col)).alias("words"))
    hits = _seeded(words, ["__row"], masks).join(item_seeds, "seed").select("__row", "entry", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    hits = reliable(hits)
    small = hits.count() <= SENT_HITS
    rows = hits.select("__row").distinct()
    texts = keyed.join(F.broadcast(rows) if small else rows, "__row", "left_semi").groupBy("__row").agg(F.first(text_col).alias("text"))
    found = texts.select("__row", tokens(F.col("text")).alias("words")).join(hits, "__row").join(items.withColumnRenamed("words", "item_words"), "entry")
    same = F.transform(F.sequence(F.lit(0), F.size("item_words") - 1), _equal)
    compared = reliable(found.select("__row", "item", same.alias("same")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    long = F.exists(F.sequence(F.lit(1), F.greatest(F.size("same") - WINDOW + 1, F.lit(1))), lambda at: total(F.slice("same", at, F.lit(WINDOW))) >= WINDOW - MISSES)
    allowed = F.when(F.size("same") >= LENIENT, 1).otherwise(0)
    ok = F.when(F.size("same") >= WINDOW, long).otherwise(total(F.col("same")) >= F.size("same") - allowed)
    return compared.where(ok).groupBy("__row", "item").agg(F.max(total(F.col("same"))).alias("matched"))


def _equal(j: Column) -> Column:
    at = F.col("shift") + j
    return F.when((at >= 0) & F.get("words", F.greatest(at, F.lit(0))).eqNullSafe(F.get("item_words", j)), 1).otherwise(0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **items: str) -> DataFrame:
    """The document rows that no benchmark item overlaps with. Null and empty
    texts, null ids and repeated rows stay; columns of any names are as they
    were; an empty table gives no rows."""
    found = reliable(leaks(docs, benchmark, id_col=id_col, text_col=text_col, **items).select("__row").distinct())
    small = found.count() <= SENT_HITS
    keyed = docs.select(F.struct(*docs.columns).alias("__doc"), _key(id_col, text_col).alias("__row"))
    return keyed.join(F.broadcast(found) if small else found, "__row", "left_anti").select("__doc.*")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.when(~F.col("__row.no"), F.col("__row.id")).alias("doc_id"), F.col("item").alias("item_id"), F.col("matched").cast("long").alias("matched"))


ORACLE_SQL = r"""
WITH b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text,'')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS v FROM benchmark),
i AS (SELECT * FROM b WHERE len(v) >= 4),
d AS (SELECT row_number() OVER () AS r, doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text,'')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
bi AS (SELECT item_id, p, array_to_string(v[p:p+3],' ') AS g FROM (SELECT item_id, v, unnest(range(1, len(v) - 2)) AS p FROM i)),
di AS (SELECT r, p, array_to_string(w[p:p+3],' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 2)) AS p FROM d WHERE len(w) >= 4)),
h AS (SELECT DISTINCT r, item_id, di.p - bi.p AS s FROM di JOIN bi USING (g)),
m AS (SELECT r, h.item_id, s, list_transform(range(1, len(v) + 1), lambda j: CASE WHEN s + j >= 1 AND w[s + j] IS NOT DISTINCT FROM v[j] THEN 1 ELSE 0 END) AS same
  FROM h JOIN d USING (r) JOIN i ON h.item_id IS NOT DISTINCT FROM i.item_id),
k AS (SELECT r, item_id, list_sum(same)::BIGINT AS matched, CASE WHEN len(same) >= 13
  THEN len(list_filter(range(1, len(same) - 11), lambda a: list_sum(same[a:a+12]) >= 11)) > 0
  WHEN len(same) >= 9 THEN list_sum(same) >= len(same) - 1 ELSE list_sum(same) = len(same) END AS ok FROM m)
SELECT doc_id, item_id, max(matched) AS matched FROM k JOIN d USING (r) WHERE ok GROUP BY doc_id, text, item_id
"""
