"""Identifiers and one copy per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\u000b "


def uuid_key(column: Column) -> Column:
    """Binary key that is equal for all spellings of one UUID.

    Letter case, hyphens, braces, a ``urn:uuid:`` prefix and surrounding blanks do not count. Text
    that is no UUID is its own key without surrounding blanks (letter case counts); null stays null.
    """
    bare = F.btrim(column, F.lit(BLANKS))
    lowered = F.lower(bare)
    lowered = F.when(lowered.startswith("urn:uuid:"), F.substring(lowered, 10, 1 << 20)).otherwise(lowered)
    hexed = F.translate(lowered, "-{}", "")
    # longer than 16 bytes, so it can never equal a UUID's key
    other = F.encode(F.concat(F.lit("other identifier:"), bare), "UTF-8")
    return F.when(F.length(hexed) == 32, F.coalesce(F.unhex(hexed), other)).otherwise(other)


def message_key(df: DataFrame, id_column: str = "event_id", order_column: str = "delivery_seq") -> Column:
    """``uuid_key`` of the id; a row without id is a message of its own, known by its order value and content."""
    return F.coalesce(
        uuid_key(F.col(id_column)),
        F.encode(
            F.concat(
                F.lit("no identifier:"),
                F.coalesce(F.col(order_column).cast("string"), F.lit("")),
                F.lit(":"),
                F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"),
            ),
            "UTF-8",
        ),
    )


def one_per_message(df: DataFrame, columns: list[str], id_column: str = "event_id", order_column: str = "delivery_seq") -> DataFrame:
    """``columns`` of one copy of each message: the one with the smallest ``order_column``.

    Copies collapse in the map-side aggregate first, so a message that fills a third of the table
    sends one row per task. Nulls sort last in ``order_column``; ties go to the smallest values of
    ``columns``. Rows without id are kept (see ``message_key``).
    """
    kept = [id_column, order_column] + [c for c in columns if c not in (id_column, order_column)]
    narrow = df.select(*kept)
    keyed = narrow.select(
        message_key(narrow, id_column, order_column).alias("k"),
        F.struct(
            F.col(order_column).isNull().alias("late"),
            F.col(order_column).alias("at"),
            F.struct(*columns).alias("row"),
        ).alias("v"),
    )
    return keyed.groupBy("k").agg(F.min("v").alias("v")).select("v.row.*")
