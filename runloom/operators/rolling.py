"""Totals and means over trailing periods, per entity and day, days without activity included.

Events are first summed to (entity, day) cells. Cells go to tiles of ``tile_days`` days together with
the preceding ``max(windows) - 1`` days (the halo); entities go to blocks of about
``block_entities``. Each (block, tile) group is a dense numpy matrix that is multiplied by one banded
0/1 matrix per window. A group's size is bounded by its block and tile, whatever the event count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.session import cut


def band(tile_days: int, halo: int, window: int, dtype) -> np.ndarray:
    """(halo + tile_days) x tile_days: column j sums day j of the tile and the ``window`` - 1 days before."""
    lag = (halo + np.arange(tile_days))[None, :] - np.arange(halo + tile_days)[:, None]
    return ((lag >= 0) & (lag < window)).astype(dtype)


def trailing_totals(df: DataFrame, entity: str, time: str, value: str, windows: tuple[int, ...] = (7, 30), tile_days: int = 64, block_entities: int = 256) -> DataFrame:
    """One row per entity and day from its first to its last day.

    Columns: ``entity``, ``day`` (date, UTC), ``n_day`` (rows of that day), and for each window w of
    days ending with ``day``: ``total_w`` (sum of non-null values; 0 if there are none), ``n_w`` (rows
    with a value), ``mean_w`` (total / n_w; null if n_w is 0) and ``per_day_w`` (total / w). Decimal
    values are summed exactly in units of their last digit. Rows with null entity or time are left
    out; an empty table gives no rows; extra columns are ignored.
    """
    kind = df.schema[value].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else None
    whole = scale is not None or isinstance(kind, T.IntegralType)
    amount = F.sum("x")
    if scale is not None:
        amount = (amount * F.lit(10**scale)).cast("long")
    amount = F.coalesce(amount.cast("long" if whole else "double"), F.lit(0).cast("long" if whole else "double"))
    cells = cut(
        df.select(F.col(entity).alias("e"), F.unix_date(F.to_date(F.col(time))).alias("d"), F.col(value).alias("x"))
        .where("e is not null and d is not null")
        .groupBy("e", "d")
        .agg(F.count("*").alias("n"), F.count("x").alias("nv"), amount.alias("v"))
    )
    spans = cells.groupBy("e").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    blocks = max(1, -(-int(cells.agg(F.approx_count_distinct("e")).first()[0]) // block_entities))
    halo, size = max(windows) - 1, tile_days
    tile = lambda day: F.floor(F.col(day) / size).cast("int") if isinstance(day, str) else F.floor(day / size).cast("int")
    block = F.pmod(F.xxhash64("e"), F.lit(blocks)).cast("int").alias("b")
    # a cell counts in its own tile and, as halo, in the following ones it reaches
    none = F.lit(None).cast("int")
    inputs = cells.select(block, F.explode(F.sequence(tile("d"), tile(F.col("d") + halo))).alias("t"), "e", "d", "n", "nv", "v", none.alias("first"), none.alias("last"))
    zero = [F.lit(0).cast(cells.schema[c].dataType).alias(c) for c in ("n", "nv", "v")]
    wanted = spans.select(block, F.explode(F.sequence(tile("first"), tile("last"))).alias("t"), "e", none.alias("d"), *zero, "first", "last")
    names = [f"{what}_{w}" for w in windows for what in ("v", "c")]
    number = "long" if whole else "double"
    out = T.StructType(
        [T.StructField("e", df.schema[entity].dataType), T.StructField("d", T.IntegerType()), T.StructField("n", T.LongType())]
        + [T.StructField(x, T.LongType() if x[0] == "c" or whole else T.DoubleType()) for x in names]
    )

    def dense(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        origin = int(key[1]) * size - halo
        asked = group["d"].isna().to_numpy()
        want, cell = group[asked], group[~asked]
        order = pd.Index(want["e"])
        row = order.get_indexer(cell["e"])
        known = row >= 0  # the halo of a tile after the entity's last day
        row, col = row[known], cell["d"].to_numpy()[known].astype(np.int64) - origin
        grids = {}
        for name, kind_ in (("n", np.int64), ("nv", np.int64), ("v", np.int64 if number == "long" else np.float64)):
            grid = np.zeros((len(order), halo + size), kind_)
            grid[row, col] = cell[name].to_numpy()[known]
            grids[name] = grid
        days = origin + halo + np.arange(size)
        keep = (days[None, :] >= want["first"].to_numpy()[:, None]) & (days[None, :] <= want["last"].to_numpy()[:, None])
        at, on = np.nonzero(keep)
        result = {"e": want["e"].to_numpy()[at], "d": days[on].astype(np.int32), "n": grids["n"][:, halo:][keep]}
        for w in windows:
            result[f"v_{w}"] = (grids["v"] @ band(size, halo, w, grids["v"].dtype))[keep]
            result[f"c_{w}"] = (grids["nv"] @ band(size, halo, w, np.int64))[keep]
        return pd.DataFrame(result)

    rows = inputs.unionByName(wanted).groupBy("b", "t").applyInPandas(dense, out)
    columns = [F.col("e").alias("entity"), F.date_from_unix_date("d").alias("day"), F.col("n").alias("n_day")]
    for w in windows:
        total = F.col(f"v_{w}")
        if scale is not None:
            total = (total.cast("decimal(19,0)") / F.lit(10**scale).cast("decimal(19,0)")).cast(T.DecimalType(min(38, 19 + scale), scale))
        columns += [
            total.alias(f"total_{w}"),
            F.col(f"c_{w}").alias(f"n_{w}"),
            F.when(F.col(f"c_{w}") > 0, total.cast("double") / F.col(f"c_{w}")).alias(f"mean_{w}"),
            (total.cast("double") / F.lit(w)).alias(f"per_day_{w}"),
        ]
    return rows.select(*columns)
