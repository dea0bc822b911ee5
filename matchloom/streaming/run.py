"""Starting streams over tables and following them to their end."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as st
from ..session import folder, release, reliable


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_at_once: int | None = None) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def drain(stream: DataFrame) -> DataFrame:
    """All that a finite stream gives, by a file sink in the shared folder."""
    spark = stream.sparkSession
    base = folder(spark, "stream")
    started = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start(f"{base}/rows")
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def change_feed(stream: DataFrame, publish: Callable[[DataFrame, int], None]) -> None:
    """Every micro-batch of a stream of changes to a consumer."""
    base = folder(stream.sparkSession, "feed")
    stream.writeStream.foreachBatch(publish).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()


def peak_levels(stream: DataFrame, *, ts: str = "ts", width: str = "150 milliseconds", late: str = "1 second") -> DataFrame:
    """Tumbling peaks in append mode; a window comes out when the watermark passes it."""
    return st.peak_levels(stream.withWatermark(ts, late), ts=ts, width=width)


class SnapshotLoop:
    """Snapshots of a stream against the last committed one, micro-batch by micro-batch.

    Rows are ``snapshot_id, key, value, stable``; a snapshot comes whole in one
    micro-batch, snapshots in the order of their ids. Everything lies under ``path``:
    each snapshot's rows, read from the stream once; versions of the table of tracked
    keys; one row of outcome a snapshot; and a manifest a micro-batch, which names the
    committed snapshot and the table's version. A manifest appears by a rename, and
    only then its micro-batch counts, so a batch that was lost on the way is run again
    from the manifest before it, and one that is repeated changes nothing.

    Outcomes: ``waiting_for_empty_reference`` before ``reference_at`` (from it on
    ``baseline`` holds), ``waiting_for_stable_frame`` if the snapshot is not stable,
    ``waiting_for_diff_pair`` for the first one after that, which is committed;
    ``resync_required`` if the whole scene shifted, which commits nothing. Otherwise
    removed keys leave the table, moved ones are marked for verification unless
    something was added (additions are looked at first), added ones are locked, and the
    snapshot is committed: ``state_updated``, or ``noise_or_lighting`` and
    ``no_state_change`` where nothing of these happened.

    What is committed depends on the outcome before, so snapshots go one by one; each
    comparison is a distributed join, of which a row comes to the driver.
    """

    def __init__(self, spark: SparkSession, path: str, baseline: DataFrame, *, noise: float, threshold: float, shift_share: float = 0.45, reference_at: str | None = None):
        self.spark, self.path, self.baseline = spark, path, baseline
        self.noise, self.threshold, self.shift_share, self.reference_at = noise, threshold, shift_share, reference_at
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, batch: int) -> dict | None:
        """What holds after ``batch``; the start's before the first."""
        if batch < 0:
            return {"committed": None, "table": None, "tracked": 0, "due": 0}
        place = f"{self.path}/manifest/{batch}"
        return json.loads(self.spark.read.text(place).first()[0]) if self._files.exists(self._fs_path(place)) else None

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if self._manifest(batch) is not None:
            return
        state = self._manifest(batch - 1)
        if state is None:
            raise RuntimeError(f"micro-batch {batch - 1} has no manifest")
        rows.withColumn("of", F.col("snapshot_id")).write.mode("overwrite").partitionBy("of").parquet(f"{self.path}/snapshots/batch={batch}")
        held = self.spark.read.parquet(f"{self.path}/snapshots/batch={batch}")
        order = held.groupBy("snapshot_id").agg(F.min("stable").alias("stable")).orderBy("snapshot_id").collect()  # a row a snapshot
        outcomes = [self._step(state, str(r.snapshot_id), bool(r.stable), batch, n) for n, r in enumerate(order)]
        self.spark.createDataFrame(outcomes, OUTCOME).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/outcomes/batch={batch}")
        made = f"{self.path}/making/{batch}"
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(made)
        self._files.mkdirs(self._fs_path(f"{self.path}/manifest"))
        if not self._files.rename(self._fs_path(made), self._fs_path(f"{self.path}/manifest/{batch}")):
            raise RuntimeError(f"the manifest of micro-batch {batch} could not be put in place")

    def _snapshot(self, batch: int, snapshot_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshots/batch={batch}").where(F.col("of").cast("string") == snapshot_id).select("key", "value")

    def _step(self, state: dict, snapshot_id: str, stable: bool, batch: int, n: int) -> tuple:
        row = lambda outcome, added=0, removed=0, moved=0: (snapshot_id, outcome, added, removed, moved, state["tracked"], state["due"])
        if self.reference_at is not None and snapshot_id < self.reference_at:
            return row("waiting_for_empty_reference")
        if not stable:
            return row("waiting_for_stable_frame")
        before, state_now = state["committed"], [batch, snapshot_id]
        if before is None:
            state["committed"] = state_now
            return row("waiting_for_diff_pair")
        found = reliable(st.snapshot_diff(self._snapshot(*before), self._snapshot(batch, snapshot_id), self.baseline, noise=self.noise, threshold=self.threshold, shift_share=self.shift_share))
        count = lambda k: F.count_if(F.col("kind") == k)
        shifted, added, removed, moved, all_ = found.agg(F.max("shifted"), count("added"), count("removed"), count("moved_or_replaced"), F.count("*")).first()
        if shifted:
            release(found)
            return row("resync_required")
        moved = 0 if added else moved
        if added or removed or moved:
            table = self.spark.read.parquet(state["table"]) if state["table"] else found.select("key", F.lit(False).alias("reverify")).limit(0)
            seen = table.withColumn("held", F.lit(True)).join(found.where("kind <> 'noise_or_lighting'").select("key", "kind"), "key", "full_outer")
            mark = F.when(F.col("kind") == "added", False).when((F.col("kind") == "moved_or_replaced") & F.lit(bool(moved)), True).otherwise(F.col("reverify"))
            stays = (F.col("kind") == "added") | (F.col("held") & (F.col("kind").isNull() | (F.col("kind") != "removed")))
            version = f"{self.path}/table/{batch}-{n}"
            seen.where(F.coalesce(stays, F.lit(False))).select("key", mark.alias("reverify")).write.mode("overwrite").parquet(version)
            tracked, due = self.spark.read.parquet(version).agg(F.count("*"), F.count_if("reverify")).first()
            state.update(table=version, tracked=tracked, due=due)
        state["committed"] = state_now
        release(found)
        return row("state_updated" if added or removed or moved else "noise_or_lighting" if all_ else "no_state_change", added, removed, moved)

    def outcomes(self) -> DataFrame:
        return self.spark.read.schema(OUTCOME).parquet(f"{self.path}/outcomes/*")


OUTCOME = "snapshot_id string, outcome string, added long, removed long, moved long, tracked long, to_reverify long"


def diff_stream(snapshots: DataFrame, loop: SnapshotLoop) -> DataFrame:
    """All snapshots that a finite stream holds past ``loop``; run again with the same
    path it goes on where it ended. The outcomes so far."""
    snapshots.writeStream.foreachBatch(loop).option("checkpointLocation", f"{loop.path}/offsets").trigger(availableNow=True).start().awaitTermination()
    return loop.outcomes()
