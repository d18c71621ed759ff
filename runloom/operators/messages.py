"""Messages delivered more than once: hash-bucketed sorted storage with idempotent upsert.

Each ``upsert`` collapses its rows to one per identifier (map-side first, so a hot identifier never
travels as a group) and appends one sorted run per hash bucket. Reading or compacting merges the runs
of each bucket: the bucketed scan is already partitioned by identifier, so no exchange is needed, and
a bucket holds at most one row per identifier and run. Upserting the same rows again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.ids import message_key
from runloom.session import cut, remove_path, scratch_path

KEY, VALUE = "message_key", "kept"


def collapse(df: DataFrame, id_column: str = "event_id", order_column: str = "delivery_seq") -> DataFrame:
    """``(message_key, kept)``: per message the copy with the smallest order value (nulls last).

    ``kept`` is ``struct(late, at, row)`` with all columns of ``df`` in ``row``, so names of ``df``
    never clash. Ties go to the smallest row.
    """
    return (
        df.select(
            message_key(df, id_column, order_column).alias(KEY),
            F.struct(
                F.col(order_column).isNull().alias("late"),
                F.col(order_column).alias("at"),
                F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
            ).alias(VALUE),
        )
        .groupBy(KEY)
        .agg(F.min(VALUE).alias(VALUE))
    )


class MessageStore:
    """One row per message in ``path``, as runs of hash buckets sorted by identifier.

    ``buckets`` is fixed when the store is made (default: the session's shuffle partitions, so that a
    run's shuffle partitions are its buckets). A path that holds a store is opened with what its
    manifest says, so a later session goes on with it. One writer at a time. Null identifiers: every
    such row is a message, unless a row repeats in all columns. Empty input adds an empty run. Columns
    may have any names; all runs of a store have the same.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, id_column: str = "event_id", order_column: str = "delivery_seq", buckets: int | None = None):
        self.spark, self.id_column, self.order_column = spark, id_column, order_column
        self.path = path or scratch_path(spark, "messages")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.generation = 0
        self._name = f"runloom_messages_{uuid.uuid4().hex}"
        if path:
            self._open()

    def _manifest(self):
        """Its Hadoop path and file system."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self) -> None:
        at, fs = self._manifest()
        if not fs.exists(at):
            return
        known = json.loads("\n".join(r[0] for r in self.spark.read.text(str(at)).collect()))  # one line
        self.buckets, self.generation, self.id_column, self.order_column = known["buckets"], known["generation"], known["id"], known["order"]
        self.spark.sql(
            f"CREATE TABLE {self.table} ({known['schema']}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/generation={self.generation}'"
        )

    def _record(self, generation: int) -> None:
        """Make ``generation`` the current one; the manifest is written aside and renamed."""
        at, fs = self._manifest()
        fields = self.spark.table(f"{self._name}_{generation}")._jdf.schema().toDDL()
        data = json.dumps({"buckets": self.buckets, "generation": generation, "id": self.id_column, "order": self.order_column, "schema": fields})
        aside = at.suffix(".new")
        out = fs.create(aside, True)
        out.write(bytearray(data, "utf-8"))
        out.close()
        fs.delete(at, False)
        fs.rename(aside, at)

    @property
    def table(self) -> str:
        return f"{self._name}_{self.generation}"

    def _append(self, rows: DataFrame, generation: int) -> None:
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            rows = rows.repartition(self.buckets, KEY)
        (
            rows.write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, KEY)
            .sortBy(KEY)
            .option("path", f"{self.path}/generation={generation}")
            .saveAsTable(f"{self._name}_{generation}")
        )
        self._record(generation)

    def upsert(self, df: DataFrame) -> None:
        """Append ``df`` as one run."""
        self._append(collapse(df, self.id_column, self.order_column), self.generation)

    def merged(self) -> DataFrame:
        """``(message_key, kept)``: equal identifiers of all runs collapsed, bucket by bucket."""
        return self.spark.table(self.table).groupBy(KEY).agg(F.min(VALUE).alias(VALUE))

    def read(self) -> DataFrame:
        """The kept copy of every message, with the columns that were upserted."""
        return self.merged().select(f"{VALUE}.row.*")

    def compact(self, buckets: int | None = None) -> None:
        """Rewrite all runs of each bucket as one; the old runs are removed when the new one is complete.

        With ``buckets`` the store has so many from then on (one exchange), so that buckets keep their size as it grows.
        """
        old, old_path = self.table, f"{self.path}/generation={self.generation}"
        # leftovers of a compaction that did not end
        remove_path(self.spark, f"{self.path}/generation={self.generation + 1}")
        rows = self.merged()
        if buckets is not None and buckets != self.buckets:
            self.buckets, rows = buckets, rows.repartition(buckets, KEY)
        self._append(rows, self.generation + 1)
        self.generation += 1
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        remove_path(self.spark, old_path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove_path(self.spark, self.path)


def arrival_runs(df: DataFrame, order_column: str, runs: int) -> list[DataFrame]:
    """``df`` as at most ``runs`` contiguous ranges of arrival; rows without order value join the first.

    The ranges are filters on ``order_column``, which reach the scan, so each row is read once.
    """
    low, high = df.agg(F.min(order_column), F.max(order_column)).first()
    if low is None or runs < 2 or high == low:
        return [df]
    step = -(-(high - low + 1) // runs)
    bounds = [low + i * step for i in range(1, runs) if low + i * step <= high]
    at = F.col(order_column)
    parts = [df.where((at < bounds[0]) | at.isNull())] if bounds else [df]
    for i, bound in enumerate(bounds):
        parts.append(df.where((at >= bound) & (at < bounds[i + 1])) if i + 1 < len(bounds) else df.where(at >= bound))
    return parts


def redelivered(df: DataFrame, id_column: str = "event_id", order_column: str = "delivery_seq", runs: int = 3) -> DataFrame:
    """``order_column`` of every row whose message came before; the order values must be unique.

    The rows are upserted in ``runs`` ranges of arrival, compacted, and what the store did not keep is
    returned. The last step joins on the order value, which no hot identifier can skew.
    """
    narrow = df.select(id_column, order_column)
    store = MessageStore(df.sparkSession, id_column=id_column, order_column=order_column)
    for part in arrival_runs(narrow, order_column, runs):
        store.upsert(part)
    store.compact()
    kept = store.read().select(order_column)
    found = cut(narrow.where(F.col(order_column).isNotNull()).select(order_column).join(kept, order_column, "left_anti"))
    store.drop()
    return found


def first_copies(df: DataFrame, id_column: str = "event_id", order_column: str = "delivery_seq", runs: int = 3) -> DataFrame:
    """All columns of the copy of each message that came first; order values must be unique, rows without one are kept.

    Only identifiers and order values go through the store; the wide rows meet what it found redelivered
    by order value, which no hot identifier can skew, and are never sorted. For order values that repeat
    or lack, ``deduplicate`` decides by all columns.
    """
    return df.join(redelivered(df, id_column, order_column, runs), order_column, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def deduplicate(df: DataFrame, id_column: str = "event_id", order_column: str = "delivery_seq") -> DataFrame:
    """One copy of each message with all columns, in one pass and one shuffle (no stored runs)."""
    return collapse(df, id_column, order_column).select(f"{VALUE}.row.*")
