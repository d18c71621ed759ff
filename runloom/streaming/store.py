"""The event store on parquet: idempotent batch append, bulk load, compaction.

Layout: ``events/event_date=.../batch=.../part-*``, sorted within files by project, event type and time
so that row groups skip, with bloom filters on trace and run ids. A batch writes only its own
directories and overwrites them when it is repeated, so a crash between write and acknowledgement
leaves no second copy. Duplicates are looked up by identifier over all dates: the stored identifiers are
scanned alone and meet the batch's, which are broadcast up to SMALL_BATCH of them; nothing stored moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.ids import uuid_key
from runloom.operators import rollups
from runloom.operators.messages import KEY, deduplicate
from runloom.schema import EVENTS, RUN_COLUMNS
from runloom.session import cut
from runloom.sources.events import EventSource

#: Rows of a date in one file, about; a larger date is written by as many tasks.
FILE_ROWS = 2_000_000
#: Messages of a batch up to which their keys (16 bytes, or as long as an identifier that is no UUID) are broadcast.
SMALL_BATCH = 1_000_000

STORED = T.StructType([*EVENTS.fields, T.StructField("event_date", T.DateType()), T.StructField("batch", T.StringType())])


@dataclass(frozen=True)
class Appended:
    inserted: int
    duplicates: int


class RollupStore:
    """Run rollups as they are after the batches that ``refresh`` was called for.

    Rows lie in buckets of (project, run); a refresh recomputes the runs that a batch touched from all
    their events, late ones included, and rewrites only their buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, f"{path.rstrip('/')}/runs", buckets

    def _all(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def read(self) -> DataFrame:
        rows = self._all()
        return (rollups.runs(self.spark.createDataFrame([], EVENTS)) if rows is None else rows).select(*RUN_COLUMNS)

    def refresh(self, store: EventStore, batch: str | None = None) -> None:
        """Take in ``batch``, or everything anew."""
        keys, events = ["project_id", "run_id"], store.read()
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int").alias("bucket")
        stored = self._all()
        if batch is None or stored is None:
            rows = rollups.runs(events).select("*", bucket)
        else:
            touched = cut(events.where(F.col("batch") == batch).select(*keys).distinct().select("*", bucket))
            buckets = [r[0] for r in touched.select("bucket").distinct().collect()]  # ``buckets`` at most
            fresh = rollups.runs(events.join(touched.drop("bucket"), keys, "left_semi")).select("*", bucket)
            kept = stored.where(F.col("bucket").isin(buckets)).join(touched.drop("bucket"), keys, "left_anti").select(*RUN_COLUMNS, "bucket")
            rows = cut(kept.unionByName(fresh))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


class EventStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/events"

    def read(self) -> DataFrame:
        """All stored rows; no rows before the first append."""
        try:
            return self.spark.read.schema(STORED).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], STORED)

    def source(self, rollup: RollupStore | None = None) -> EventSource:
        return EventSource(self.read(), order_column=None, runs=rollup.read() if rollup else None)

    def _write(self, rows: DataFrame, batch: str, mode: str) -> None:
        dated = rows.select(*[f.name for f in EVENTS]).withColumns({"event_date": F.to_date("timestamp"), "batch": F.lit(batch)})
        # one row per date of the batch: into how many files it goes
        files = dated.groupBy("event_date").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("files"))
        # runs stay together, but for the far steps of an endless one
        part = F.pmod(F.xxhash64("run_id", F.floor(F.col("step_index") / 10_000)), F.col("files"))
        (
            dated.join(F.broadcast(files), "event_date")
            .repartition("event_date", part)
            .drop("files")
            .sortWithinPartitions("event_date", "project_id", "event_type", "timestamp")
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .option("parquet.bloom.filter.enabled#trace_id", "true")
            .option("parquet.bloom.filter.enabled#run_id", "true")
            .partitionBy("event_date", "batch")
            .parquet(self.path)
        )

    def append(self, rows: DataFrame, batch: str, order_column: str) -> Appended:
        """Add the messages that are not stored yet, on whatever date; the first of a batch by ``order_column`` wins.

        Repeating a batch under its name changes nothing.
        """
        total = rows.count()
        once = cut(deduplicate(rows, "event_id", order_column).withColumn(KEY, uuid_key(F.col("event_id"))))
        messages, keys = once.count(), once.select(KEY)
        if messages <= SMALL_BATCH:
            keys = F.broadcast(keys)
        stored = self.read().where(F.col("batch") != batch).select(uuid_key(F.col("event_id")).alias(KEY))
        # of the batch's messages those that are there; bulk loads may have stored one twice
        known = cut(stored.join(keys, KEY, "left_semi").distinct())
        inserted = messages - known.count()
        if inserted:
            self._write(once.join(known, KEY, "left_anti").drop(KEY), batch, "overwrite")
        return Appended(inserted, total - inserted)

    def bulk_load(self, rows: DataFrame, batch: str) -> None:
        """Append without looking for duplicates, for loaders that know there are none."""
        self._write(rows, batch, "append")

    def compact(self, dates: list, batch: str = "compacted") -> None:
        """Rewrite the given dates as one batch each, one row per message (that of the first batch by name)."""
        rows = self.read().where(F.col("event_date").isin(dates))
        old = [tuple(r) for r in rows.select("event_date", "batch").distinct().collect()]
        once = cut(deduplicate(rows, "event_id", "batch"))
        self._write(once.drop("event_date", "batch"), batch, "overwrite")
        from runloom.session import remove_path

        for date, name in old:
            if name != batch:
                remove_path(self.spark, f"{self.path}/event_date={date}/batch={name}")
