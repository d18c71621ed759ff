"""Structured Streaming ingestion: landing files -> validation -> payloads -> idempotent append.

A landing line is ``{"project_id", "received_at", "body"}`` with the wire event as text in ``body``.
The checkpoint is the acknowledgement: a micro-batch counts as consumed after its append. A batch that
keeps failing is written to the dead letters after ``max_attempts`` and consumed; attempts are files,
so they survive a restart.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.session import Files, cut
from runloom.streaming import payloads, wire
from runloom.streaming.store import Appended, EventStore

LANDING = "project_id string, received_at string, body string"
MAX_ATTEMPTS = 5
MAX_DEPTH = 100_000
#: Events in a landing file at most; a micro-batch of FILES files has 5000 events at most.
FILE_EVENTS = 50
FILES = 100


class Backpressure(Exception):
    """The landing backlog is full; try again later."""


def _events(name: str) -> int:
    """How many events a file of the queue stands for: the number behind the first hyphen of its name."""
    return int(name.split("-")[1])


class Landing:
    """The queue's edge on a file system all processes share: events go in as files of at most FILE_EVENTS.

    With ``consumed``, the folder in which an ingestor notes what it has taken (``Ingestor.consumed``),
    ``backlog`` is known here, at most ``fresh`` seconds old. With ``spark`` the folders may lie on any
    file system that Hadoop knows. What is consumed may be removed together with its notes while nothing is written.
    """

    def __init__(self, path: str, max_depth: int = MAX_DEPTH, spark: SparkSession | None = None, consumed: str | None = None, fresh: float = 1.0):
        self.path, self.max_depth, self.fresh = path, max_depth, fresh
        self._files, self._notes = Files(path, spark), Files(consumed, spark) if consumed else None
        self._known, self._at = 0, float("-inf")

    def backlog(self) -> int:
        """Events that wait; 0 where consumption is not noted."""
        if self._notes is None:
            return 0
        if time.monotonic() - self._at > self.fresh:
            self._known = max(0, sum(map(_events, self._files.names())) - sum(map(_events, self._notes.names())))
            self._at = time.monotonic()
        return self._known

    def put(self, project: str, bodies: Iterable[str]) -> int:
        """Queue the events; raises Backpressure if too many wait."""
        if (waiting := self.backlog()) >= self.max_depth:
            raise Backpressure(f"{waiting} events wait")
        bodies = list(bodies)
        for low in range(0, len(bodies), FILE_EVENTS):
            part, at = bodies[low : low + FILE_EVENTS], time.time_ns()
            lines = (json.dumps({"project_id": project, "received_at": f"{at:020d}-{i:09d}", "body": b}) + "\n" for i, b in enumerate(part))
            self._files.put(f"{at}-{len(part)}-{uuid.uuid4().hex}.json", "".join(lines))
        self._known += len(bodies)
        return len(bodies)


class Ingestor:
    """Handles micro-batches; tables under ``root``: events, payloads, rejected, dead_letters."""

    def __init__(self, spark: SparkSession, root: str, max_attempts: int = MAX_ATTEMPTS):
        self.spark, self.root, self.max_attempts = spark, root.rstrip("/"), max_attempts
        self.store = EventStore(spark, self.root)
        self.consumed = f"{self.root}/consumed"
        self._notes = Files(self.consumed, spark)

    def handle(self, batch: DataFrame, batch_id: int) -> Appended | None:
        """One micro-batch; None if it went to the dead letters."""
        try:
            result = self._ingest(batch, f"{batch_id:012d}")
        except Exception as error:
            if self._attempt(batch_id) < self.max_attempts:
                raise
            batch.withColumn("error", F.lit(str(error))).write.mode("overwrite").json(f"{self.root}/dead_letters/batch={batch_id}")
            result = None
        self._notes.put(f"{batch_id:012d}-{batch.count()}", "")
        return result

    def _ingest(self, batch: DataFrame, name: str) -> Appended:
        validated = cut(wire.validate(batch))
        wire.rejected(validated, "received_at").write.mode("overwrite").json(f"{self.root}/rejected/batch={name}")
        rows, texts = payloads.strip(wire.accepted(validated.drop("body"), F.col("project_id")))
        texts.withColumn("batch", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "shard").parquet(f"{self.root}/payloads")
        return self.store.append(rows, name, "received_at")

    def _attempt(self, batch_id: int) -> int:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/attempts/batch_{batch_id}")
        fs = folder.getFileSystem(conf)
        fs.create(jvm.org.apache.hadoop.fs.Path(folder, uuid.uuid4().hex)).close()
        return len(fs.listStatus(folder))

    def payloads(self) -> DataFrame:
        return self.spark.read.schema("ref string, project_id string, payload string, batch string, shard string").parquet(f"{self.root}/payloads")

    def start(self, landing: str, checkpoint: str, seconds: float | None = 1.0, files: int = FILES) -> StreamingQuery:
        """The running query. ``seconds`` None: consume what is there, in batches of ``files``, and stop."""
        stream = self.spark.readStream.schema(LANDING).option("maxFilesPerTrigger", files).json(landing)
        writer = stream.writeStream.foreachBatch(lambda batch, i: self.handle(batch, i) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def hourly_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Streaming counts and cost per project, event type and hour; rows later than ``late`` do not change them (``touched_hours`` gives such hours anew, from the store)."""
    return (
        stream.withColumn("at", F.col("timestamp").cast("timestamp"))
        .withWatermark("at", late)
        .groupBy("project_id", "event_type", F.window("at", "1 hour"))
        .agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"))
        .select("project_id", "event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", "cost_usd")
    )


def touched_hours(store: EventStore, batch: str) -> DataFrame:
    """The rows of ``hourly_counts`` for the hours that a batch touched, from all their events, however late."""
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
    events = store.read().withColumn("hour", hour)
    keys = ["project_id", "event_type", "hour"]
    touched = events.where(F.col("batch") == batch).select(*keys).distinct()
    return events.join(touched, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"))


def touched_runs(store: EventStore, batch: str) -> DataFrame:
    """Rollups of the runs that a batch touched, recomputed from all their events (late ones included)."""
    from runloom.operators import rollups

    events = store.read()
    touched = events.where(F.col("batch") == batch).select("project_id", "run_id").distinct()
    return rollups.runs(events.join(touched, ["project_id", "run_id"], "left_semi"))
