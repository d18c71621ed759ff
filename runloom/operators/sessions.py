"""Sessions by inactivity gap, by pairing session starts with session ends.

An event starts a session when no earlier event lies within the gap and ends one when no later event
does; both are found with RANGE frames. Starts and ends are numbered separately, equal numbers are
joined, and the difference of the events' ranks at end and start gives the count.

Frames and numbers are computed within (entity, time tile), so that an entity with a third of all
events is spread over its tiles; equal times are collapsed before the shuffle, which bounds a tile by
the number of distinct times in it. One row per tile carries the tile's borders and counts; running
sums over these rows turn local numbers into global ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import cut


def sessions(df: DataFrame, entity: str, time: str, gap_ms: int = 30 * 60 * 1000, tile_ms: int = 6 * 60 * 60 * 1000) -> DataFrame:
    """``(entity, start_ms, end_ms, duration_ms, n_events)``, one row per session.

    A gap of exactly ``gap_ms`` does not split. Times are taken to the millisecond, in UTC. Repeated
    rows and equal times count as events of one session. Rows with null entity or time belong to no
    session; an empty table gives no rows; extra columns are ignored.
    """
    cells = (
        df.select(F.col(entity).alias("e"), F.unix_millis(F.col(time).cast("timestamp")).alias("t"))
        .where("e is not null and t is not null")
        .groupBy("e", "t", F.floor(F.col("t") / tile_ms).alias("tile"))
        .agg(F.count("*").alias("n"))
        .repartition("e", "tile")
    )
    tile = Window.partitionBy("e", "tile")
    forward, backward = tile.orderBy("t"), tile.orderBy(F.col("back"))
    # the last earlier and the first later time in the tile; the second frame runs over negated times
    frames = (
        cells.withColumn("back", -F.col("t"))
        .withColumn("later", -F.max("back").over(backward.rangeBetween(Window.unboundedPreceding, -1)))
        .withColumn("earlier", F.max("t").over(forward.rangeBetween(Window.unboundedPreceding, -1)))
        .withColumn("rank", F.sum("n").over(forward.rowsBetween(Window.unboundedPreceding, 0)))
    )
    opens = F.col("earlier").isNull() | (F.col("t") - F.col("earlier") > gap_ms)
    closes = F.col("later").isNull() | (F.col("later") - F.col("t") > gap_ms)
    # few of the events; tiles, starts and ends are taken from them, so that the frames run once
    edges = cut(
        frames.select("e", "tile", "t", "n", "rank", opens.alias("opens"), closes.alias("closes"))
        .where("opens or closes")
        .withColumn("open_no", F.sum(F.col("opens").cast("long")).over(forward.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("close_no", F.sum(F.col("closes").cast("long")).over(forward.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # one row per tile: whether it continues the session of the tile before, and what came before it
    order = Window.partitionBy("e").orderBy("tile")
    passed = order.rowsBetween(Window.unboundedPreceding, -1)
    tiles = (
        edges.groupBy("e", "tile")
        .agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("rank").alias("events"), F.max("open_no").alias("opened"))
        .withColumn("joins", F.coalesce(F.col("first") - F.lag("last").over(order) <= gap_ms, F.lit(False)))
        .withColumn("joined", F.coalesce(F.lead(F.col("joins")).over(order), F.lit(False)))
        .select(
            "e",
            "tile",
            "first",
            "last",
            "joins",
            "joined",
            F.coalesce(F.sum("events").over(passed), F.lit(0)).alias("events_before"),
            # sessions opened before this tile, and closed before it
            F.coalesce(F.sum(F.col("opened") - F.col("joins").cast("long")).over(passed), F.lit(0)).alias("opened_before"),
        )
        .withColumn("closed_before", F.col("opened_before") - F.col("joins").cast("long"))
    )
    placed = edges.join(tiles, ["e", "tile"])
    starts = placed.where(F.col("opens") & ~(F.col("joins") & (F.col("t") == F.col("first")))).select(
        "e",
        (F.col("opened_before") + F.col("open_no") - F.col("joins").cast("long")).alias("no"),
        F.col("t").alias("start_ms"),
        (F.col("events_before") + F.col("rank") - F.col("n")).alias("rank_before"),
    )
    ends = placed.where(F.col("closes") & ~(F.col("joined") & (F.col("t") == F.col("last")))).select(
        "e",
        (F.col("closed_before") + F.col("close_no")).alias("no"),
        F.col("t").alias("end_ms"),
        (F.col("events_before") + F.col("rank")).alias("rank_at"),
    )
    return starts.join(ends, ["e", "no"]).select(
        F.col("e").alias("entity"),
        "start_ms",
        "end_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        (F.col("rank_at") - F.col("rank_before")).alias("n_events"),
    )
