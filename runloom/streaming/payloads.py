"""Long texts of events live in a table of their own, by reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = "payloadRef"


def reference(project: Column, event: Column) -> Column:
    """``local://<shard>/<project>/<event>``: characters outside letters, digits, _ and - become _."""
    safe = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_")
    return F.concat(F.lit("local://"), F.substring(safe(event), 1, 2), F.lit("/"), safe(project), F.lit("/"), safe(event))


def _has(column: str) -> Column:
    return F.length(F.coalesce(F.col(column), F.lit(""))) > 0


def strip(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event rows without ``input`` and ``output``, and ``payloads(ref, shard, project_id, payload)``.

    Only rows with a non-empty text get a reference, as ``payloadRef`` in their metadata.
    """
    carries, ref = _has("input") | _has("output"), reference(F.col("project_id"), F.col("event_id"))
    texts = F.to_json(F.struct(*[F.when(_has(c), F.col(c)).alias(c) for c in ("input", "output")]))
    payloads = rows.where(carries).select(ref.alias("ref"), F.substring_index(F.substring_index(ref, "/", 3), "/", -1).alias("shard"), "project_id", texts.alias("payload"))
    marked = _put("metadata", F.to_json(F.create_map(F.lit(REFERENCE), ref)))
    return rows.withColumn("metadata", F.when(carries, marked).otherwise(F.col("metadata"))).drop("input", "output"), payloads


def _entries(column: str) -> Column:
    """The JSON object's own entries by key, each value as it is, whatever lies within."""
    return F.try_parse_json(column).cast("map<string, variant>")


def _without(column: str) -> Column:
    """The JSON object without a reference at its top; what lies deeper, and text that is no object, stays."""
    kept = F.map_filter(_entries(column), lambda key, _: key != REFERENCE)
    return F.when(F.get_json_object(column, f"$.{REFERENCE}").isNull(), F.col(column)).otherwise(F.coalesce(F.to_json(kept), F.col(column)))


def _put(column: str, entry: Column) -> Column:
    """The JSON object with the one-entry JSON object ``entry`` put at its end, in place of one that it may have."""
    bare = F.btrim(_without(column))
    inner = F.btrim(F.substr(bare, F.lit(2), F.length(bare) - 2))
    return F.when(F.length(inner) == 0, entry).otherwise(F.concat(F.lit("{"), inner, F.lit(","), F.substr(entry, F.lit(2))))


def hydrate(events: DataFrame, payloads: DataFrame) -> DataFrame:
    """``events`` with ``input`` and ``output`` of their payload, and metadata without the reference.

    Events without reference, or whose payload is missing, stay as they are (texts null).
    """
    ref = F.get_json_object("metadata", f"$.{REFERENCE}")
    # the key is kept beside the reference, so that a tenant never reads another's text
    texts = payloads.select(F.col("ref").alias("_ref"), F.col("project_id").alias("_project"), "payload").dropDuplicates(["_ref", "_project"])
    joined = events.withColumn("_own", ref).join(texts, (F.col("_own") == F.col("_ref")) & (F.col("project_id") == F.col("_project")), "left")
    found = F.col("payload").isNotNull()
    return joined.select(
        *[F.when(found, _without("metadata")).otherwise(F.col("metadata")).alias("metadata") if c == "metadata" else F.col(c) for c in events.columns],
        F.get_json_object("payload", "$.input").alias("input"),
        F.get_json_object("payload", "$.output").alias("output"),
    )
