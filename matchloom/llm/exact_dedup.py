"""Exact dedup against a persistent index of digests.

The index is a table of SHA-256 digests, bucketed and sorted by digest, one
partition a batch. New rows are brought to one row a digest, which a sort-merge
anti-join holds against the index; what is left is new and is appended in the same
buckets, so the index itself is never shuffled.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folder, stored


class DigestIndex:
    """The index at ``path``, in a folder that all executors share; made if absent.

    ``buckets`` holds for a new index only (default: the session's shuffle
    partitions) and is kept beside it, as is the type of the ids. A batch is named
    by the caller (letters, digits, ``.``, ``_``, ``-``). To add a batch of the same
    name again replaces what it added, so a job that was lost on the way is simply
    run again. One job writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path
        try:
            buckets, id_type = spark.read.parquet(f"{path}/layout").first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(buckets, id_type)], "buckets int, id_type string").coalesce(1).write.parquet(f"{path}/layout")
        self.buckets, self.id_type = buckets, id_type
        self.table = f"digest_index_{hashlib.sha256(path.encode()).hexdigest()[:20]}"
        place = f"{path}/digests".replace("'", "\\'")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{path}/digests"))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'")
        spark.catalog.recoverPartitions(self.table)

    def known(self, but: str | None = None) -> DataFrame:
        """``digest, keep_id, batch`` of every text seen, without those of batch ``but``."""
        held = self.spark.table(self.table)
        return held if but is None else held.where(F.col("batch") != but)

    def _append(self, fresh: DataFrame, batch: str) -> None:
        """``fresh`` (digest, keep_id) as the batch's partition, in place of an earlier try."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"a batch's name has letters, digits, '.', '_' and '-' only: {batch!r}")
        self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (batch = '{batch}')")
        self._files.delete(self._path(f"{self.path}/digests/batch={batch}"), True)
        rows = fresh.select("digest", F.col("keep_id").cast(self.id_type), F.lit(batch).alias("batch"))
        # One file a bucket; rows that already lie by bucket are not exchanged again.
        rows.repartition(self.buckets, "digest").write.insertInto(self.table)

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Add ``rows`` (id, row, digest; see ``digests``). One row a digest of them:
        ``digest, row, keep_id, copies, fresh``. ``keep_id`` is the id that stays (an
        earlier batch's, else the largest here, nulls lowest), ``copies`` counts the
        batch's rows, ``fresh`` tells that the batch brought the text, ``row`` the row
        that then stays."""
        groups = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("copies"))
        fresh = groups.join(self.known(but=batch).select("digest").hint("merge"), "digest", "left_anti")
        self._append(fresh.select("digest", F.col("best.id").alias("keep_id")), batch)
        return groups.join(self.known().hint("merge"), "digest").select("digest", F.col("best.row").alias("row"), "keep_id", "copies", (F.col("batch") == batch).alias("fresh"))

    def drop_copies(self, docs: DataFrame, batch: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` whose text no earlier batch had, one of equal ones (the
        largest id, nulls lowest), with all columns, whatever their names; their
        digests are appended. The rows are written to the shared folder, so that
        what is returned and what was appended are the same rows."""
        whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("whole"), docs[f"`{id_col}`"].alias("id"), digest_of(docs[f"`{text_col}`"]).alias("digest"))
        best = whole.groupBy("digest").agg(F.max_by(F.struct("whole", "id"), F.struct("id")).alias("best"))
        left = stored(best.join(self.known(but=batch).select("digest").hint("merge"), "digest", "left_anti"))
        self._append(left.select("digest", F.col("best.id").alias("keep_id")), batch)
        return left.select("best.whole.*")

    def rewritten(self, path: str, *, buckets: int | None = None) -> DigestIndex:
        """A copy at ``path`` whose buckets are one sorted file each, after many
        batches, or with another number of buckets."""
        new = DigestIndex(self.spark, path, buckets=buckets or self.buckets, id_type=self.id_type)
        new._append(self.known().select("digest", "keep_id"), "rewritten")
        return new


def digest_of(text):
    """SHA-256 of the UTF-8 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, row, digest`` of every row; ``row`` numbers the rows, so that repeated
    ones are told apart. Written to the shared folder: texts are read once."""
    return stored(docs.select(docs[f"`{id_col}`"].alias("id"), F.monotonically_increasing_id().alias("row"), digest_of(docs[f"`{text_col}`"]).alias("digest")))


def mark(rows: DataFrame, *groups: DataFrame) -> DataFrame:
    """Every row of ``rows`` with its text's verdict over the batches in ``groups``:
    ``id, digest, keep_id, group_size, kept``.

    Equal texts are one group, however long; null and empty texts are equal.
    ``group_size`` counts the rows of all ``groups``. Exactly one row of a group is
    kept, of rows repeated in whole one of them; null ids count as lowest. Empty
    tables give no rows. A text of any number of rows is one row of the aggregated
    side, and rows are joined by a shuffle that adaptive execution can split."""
    every = groups[0]
    for more in groups[1:]:
        every = every.union(more)
    chosen = F.max(F.when(F.col("fresh"), F.col("row"))).alias("chosen")
    # Written first: the join then has shuffles on both sides, of which skewed parts can be split.
    every = stored(every.groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.sum("copies").alias("group_size"), chosen))
    kept = F.coalesce(F.col("row") == F.col("chosen"), F.lit(False))
    return rows.join(every.hint("merge"), "digest").select("id", "digest", "keep_id", "group_size", kept.alias("kept"))


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents come in two batches, larger ids first: of equal texts the one that
    is met first is then the one with the largest id."""
    rows = digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    index = DigestIndex(spark, folder(spark, "digest-index"))
    middle = rows.agg(F.percentile_approx("id", 0.5)).first()[0]
    upper = F.coalesce(F.col("id") > F.lit(middle), F.lit(False))
    first = stored(index.add(rows.where(upper), "upper"))
    second = index.add(rows.where(~upper), "lower")
    return mark(rows, first, second).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""
