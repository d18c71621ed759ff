"""Percentiles from merging centroid digests, certified and made exact by a second counting pass.

A digest is a set of centroid rows ``(keys..., mean, weight, low, high)``: runs of the sorted values
whose size is bounded on the scale k(q) = compression / (2 pi) * asin(2q - 1), so clusters are small in
the tails. Digests merge by clustering their centroids again. Partitions digest their own rows, so only
centroids are shuffled; merging goes through salted groups first, so that no task takes all centroids
of a hot key. As ``low`` and ``high`` are true values, any digest gives a bracket that certainly holds a
wanted order statistic; counting the values up to it and those in it gives the exact percentile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.session import cut

#: Rows that a task clusters at once.
BLOCK = 400_000
COMPRESSION = 200
#: Groups times percentiles (rows of numbers and keys) up to which the counting pass broadcasts them.
BRACKETS = 200_000


#: Names of the operator's own columns, which a key cannot have.
RESERVED = {"mean", "weight", "low", "high", "p", "n", "estimate", "rank", "below", "above", "x", "cell", "c", "salt", "passed", "a", "b"}


def _checked(keys: list[str]) -> None:
    if clash := RESERVED & {k.lower() for k in keys}:
        raise ValueError(f"rename the keys {sorted(clash)}: the result has columns of these names")


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    numbers = [T.StructField("mean", T.DoubleType()), T.StructField("weight", T.LongType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
    return T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + numbers)


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, compression: int):
    """Cluster the centroids of each group (non-negative ints); returns the same five arrays."""
    order = np.lexsort((high, low, mean, group))
    group, mean, weight, low, high = group[order], mean[order], weight[order], low[order], high[order]
    first = np.r_[True, group[1:] != group[:-1]]
    starts = np.flatnonzero(first)
    passed = np.cumsum(weight)
    before = np.repeat(passed[starts] - weight[starts], np.diff(np.r_[starts, len(group)]))
    total = np.repeat(np.add.reduceat(weight, starts), np.diff(np.r_[starts, len(group)]))
    middle = (passed - before - weight / 2) / total
    scale = np.floor(compression / (2 * np.pi) * np.arcsin(np.clip(2 * middle - 1, -1, 1)))
    cut = np.flatnonzero(first | np.r_[True, scale[1:] != scale[:-1]])
    merged = np.add.reduceat(weight, cut)
    return group[cut], np.add.reduceat(mean * weight, cut) / merged, merged, np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)


def _clustered(frame: pd.DataFrame, keys: list[str], compression: int) -> pd.DataFrame:
    codes, distinct = (frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy(), frame.drop_duplicates(keys)[keys]) if keys else (np.zeros(len(frame), int), None)
    group, *numbers = cluster(codes, *(frame[c].to_numpy() for c in ("mean", "weight", "low", "high")), compression)
    out = distinct.iloc[group].reset_index(drop=True) if keys else pd.DataFrame(index=range(len(group)))
    return out.assign(**dict(zip(("mean", "weight", "low", "high"), numbers)))


def partial_digests(df: DataFrame, keys: list[str], value: str, compression: int = COMPRESSION) -> DataFrame:
    """Centroids per group and block of rows, without a shuffle. Null and NaN values are left out; null keys
    are a group; extra columns are ignored; an empty table gives no rows."""

    _checked(keys)

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count >= BLOCK:
                yield _clustered(pd.concat(held), keys, compression)
                held, count = [], 0
        if count:
            yield _clustered(pd.concat(held), keys, compression)

    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("mean"), F.lit(1).cast("long").alias("weight"), x.alias("low"), x.alias("high"))
    return rows.mapInPandas(digest, _schema(rows, keys))


def merge_digests(digests: DataFrame, keys: list[str], compression: int = COMPRESSION, salts: int = 16) -> DataFrame:
    """One digest per group of ``keys``, from digests of finer groups, days or partitions."""
    schema = _schema(digests, keys)

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by keys; the last group of a block is carried on, as it may continue
        held: list[pd.DataFrame] = []
        count = 0
        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count < BLOCK:
                continue
            block = pd.concat(held, ignore_index=True)
            same = np.ones(len(block), bool)
            for k in keys:
                last = block[k].iloc[-1]
                same &= (block[k].isna() if pd.isna(last) else block[k] == last).to_numpy()
            if not same.all():
                yield _clustered(block[~same], keys, compression)
            tail = _clustered(block[same], keys, compression)
            held, count = [tail], len(tail)
        if count:
            yield _clustered(pd.concat(held, ignore_index=True), keys, compression)

    narrow = digests.select(*keys, "mean", "weight", "low", "high")
    salted = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    first = narrow.select("*", salted).repartition(*keys, "salt").drop("salt").sortWithinPartitions(*keys).mapInPandas(merged, schema)
    second = first.repartition(*keys) if keys else first.repartition(1)
    return (second.sortWithinPartitions(*keys) if keys else second).mapInPandas(merged, schema)


def quantiles(digests: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """Per group and probability: ``(keys..., p, n, estimate, rank, below, above)``.

    ``estimate`` interpolates between centroid means. ``rank`` is the 0-based rank p (n - 1), rounded
    down; the order statistics ``rank`` and ``rank + 1`` certainly lie in (``below``, ``above``], where
    ``below`` is null if nothing is known to lie under them.
    """
    schema = T.StructType(
        [T.StructField(k, digests.schema[k].dataType) for k in keys]
        + [T.StructField("p", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("estimate", T.DoubleType()), T.StructField("rank", T.LongType()), T.StructField("below", T.DoubleType()), T.StructField("above", T.DoubleType())]
    )

    def read(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("mean")
        mean, weight = frame["mean"].to_numpy(), frame["weight"].to_numpy()
        n = int(weight.sum())
        middle = np.cumsum(weight) - weight / 2 - 0.5
        by_low, by_high = np.argsort(frame["low"].to_numpy(), kind="stable"), np.argsort(frame["high"].to_numpy(), kind="stable")
        low, at_most = frame["low"].to_numpy()[by_low], np.cumsum(weight[by_low])
        high, at_least = frame["high"].to_numpy()[by_high], np.cumsum(weight[by_high])
        # equal borders count together
        at_most = at_most[np.searchsorted(low, low, "right") - 1]
        at_least = at_least[np.searchsorted(high, high, "right") - 1]
        rows = []
        for p in probabilities:
            rank = int(np.floor(p * (n - 1) + 1e-9))
            under = np.flatnonzero(at_most <= rank)
            over = int(np.flatnonzero(at_least >= min(rank + 2, n))[0])
            estimate = float(np.interp(p * (n - 1), middle, mean))
            rows.append((*key, p, n, estimate, rank, float(low[under[-1]]) if len(under) else None, float(high[over])))
        return pd.DataFrame(rows, columns=schema.fieldNames())

    return digests.groupBy(*keys).applyInPandas(read, schema)


def error_bound(p: Column, n: Column, compression: int = COMPRESSION) -> Column:
    """Bound of an estimate's rank error, as a share of n: the share that a cluster at p spans, for each of the three
    times that centroids are clustered (rows, salted groups, groups), and one rank."""
    return F.lit(3 * 2 * np.pi / compression) * F.greatest(F.sqrt(p * (1 - p)), F.lit(np.pi / compression)) + 1 / n


def _counted(df: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` joined to the rows of its groups (null keys match); up to BRACKETS rows of it are broadcast."""
    wanted = cut(wanted)
    renamed = wanted.select(*[F.col(k).alias(f"w_{i}") for i, k in enumerate(keys)], *[c for c in wanted.columns if c not in keys])
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"w_{i}"))
    if wanted.count() <= BRACKETS:
        renamed = F.broadcast(renamed)
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("x"))
    return rows.join(renamed, match).drop(*[f"w_{i}" for i in range(len(keys))])


def certified(df: DataFrame, keys: list[str], value: str, found: DataFrame) -> DataFrame:
    """The counting pass over ``df``: ``found`` (of ``quantiles``) with ``rank_error``, the distance of the
    estimate's true rank from the wanted one as a share of n (0 if the estimate is at that rank)."""
    x, wanted = F.col("x"), F.col("p") * (F.col("n") - 1)
    counts = _counted(df, keys, value, found).groupBy(*keys, "p", "n", "estimate").agg(F.count_if(x < F.col("estimate")).alias("under"), F.count_if(x <= F.col("estimate")).alias("upto"))
    error = F.greatest(F.lit(0.0), F.col("under") - wanted, wanted - F.greatest(F.col("upto") - 1, F.lit(0))) / F.col("n")
    return counts.select(*keys, "p", "n", "estimate", error.alias("rank_error"))


def exact(df: DataFrame, keys: list[str], value: str, found: DataFrame) -> DataFrame:
    """The counting pass over ``df``: ``(keys..., p, n, value)`` with the exact percentile, linear between ranks.

    Values up to the bracket collapse to one count, equal values in it to one each, both map-side; the
    ranks are running sums over a group's distinct values within the bracket.
    """
    x = F.col("x")
    cell = F.when(F.col("below").isNull() | (x > F.col("below")), x)
    groups = [*keys, "p", "n", "rank"]
    cells = _counted(df, keys, value, found).where(x <= F.col("above")).groupBy(*groups, cell.alias("cell")).agg(F.count("*").alias("c"))
    passed = F.sum("c").over(Window.partitionBy(*groups).orderBy(F.col("cell").asc_nulls_first()))
    ranked = cells.withColumn("passed", passed)
    pick = lambda rank: F.min(F.when(F.col("passed") > rank, F.col("cell")))
    ends = ranked.groupBy(*groups).agg(pick(F.col("rank")).alias("a"), pick(F.least(F.col("rank") + 1, F.col("n") - 1)).alias("b"))
    share = F.col("p") * (F.col("n") - 1) - F.col("rank")
    share = F.greatest(share, F.lit(0.0))
    return ends.select(*keys, "p", "n", (F.col("a") + (F.col("b") - F.col("a")) * share).alias("value"))
