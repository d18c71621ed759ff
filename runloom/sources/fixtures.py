"""Events in a JSON file: one array of camel-case objects with explicit nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.schema import EVENTS, MONEY

_WORDS = {T.IntegerType(): "int", T.LongType(): "bigint", T.DoubleType(): "double"}


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def json_events(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Stored rows of the events in ``path`` (a file or a folder of them), in the project given.

    Event types are taken as they are, also those that the wire does not accept; absent fields are
    null, metadata is JSON text, ``{}`` where it is null; times are UTC to the millisecond. A file is
    one array and so one task; what is no object gives a row of nulls.
    """
    fields = {f.name: _WORDS.get(f.dataType, "double" if f.dataType == MONEY else "string") for f in EVENTS if f.name not in ("project_id", "metadata")}
    schema = ", ".join([*(f"{_camel(n)} {t}" for n, t in fields.items()), "metadata variant"])
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    values = {f.name: F.col(_camel(f.name)).cast(f.dataType) for f in EVENTS if f.name in fields}
    values["timestamp"] = F.date_trunc("millisecond", F.try_to_timestamp("timestamp")).cast("timestamp_ntz")
    values |= {"project_id": F.lit(project), "metadata": F.coalesce(F.to_json(F.when(~F.is_variant_null("metadata"), F.col("metadata"))), F.lit("{}"))}
    return rows.select(*[values[f.name].alias(f.name) for f in EVENTS])
