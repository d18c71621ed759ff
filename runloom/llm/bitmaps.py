"""Distinct counts by linear counting on fixed bitmaps.

An identifier sets one hashed bit of a bitmap of ``bits`` positions. Bitmaps are kept as rows of
64-bit words - ``(keys..., kind, word, bits)``, words without a set bit left out but for one of a group with nulls - so that the set is a
bitwise-or aggregate: it combines map-side, spreads a hot group over its words, costs a small group only
what it holds, and merges over days and groups by the same aggregate. The estimate follows from the
share of empty bits: n = -m ln(empty / m).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relative_error(n: float, bits: int) -> float:
    """Standard error of the estimate of ``n`` identifiers, relative to ``n``."""
    load = n / bits
    return math.sqrt(bits * (math.exp(load) - load - 1)) / n


def bits_for(max_ids: int, error: float) -> int:
    """The smallest power of two of bits (64 at least) that keeps the standard error at ``max_ids``, and so below, within ``error``."""
    bits = 64
    while max_ids / bits > 40 or relative_error(max(1, max_ids), bits) > error:
        bits *= 2
    if bits > 1 << 36:
        raise ValueError("more bits than words have numbers; split the identifiers by a key first")
    return bits


def bits_of(df: DataFrame, ids: list[str], least_ids: int, error: float) -> int:
    """Bits that hold any group of ``df``, and ``least_ids`` identifiers at least, within the standard error ``error``.

    A table of no more rows than that needs no look at its identifiers; of a larger one their number is
    estimated within about 1 % first, so that no bitmap fills up.
    """
    if df.count() <= least_ids:
        return bits_for(least_ids, error)
    counts = df.agg(*[F.approx_count_distinct(c, 0.01) for c in ids]).first()
    return bits_for(max(least_ids, math.ceil(1.05 * max(counts))), error)


def position(column: Column, bits: int) -> Column:
    """The identifier's bit: the first 60 bits of its MD5, modulo ``bits`` (a power of two)."""
    return F.conv(F.substring(F.md5(column.cast("string")), 1, 15), 16, 10).cast("long").bitwiseAND(F.lit(bits - 1))


#: Names of the operator's own columns, which a key cannot have.
RESERVED = {"kind", "word", "bits", "mark"}


def _checked(keys: list[str]) -> None:
    if clash := RESERVED & {k.lower() for k in keys}:
        raise ValueError(f"rename the keys {sorted(clash)}: the result has columns of these names")


def sketch(df: DataFrame, keys: list[str], ids: list[str], bits: int) -> DataFrame:
    """Mergeable partial result: ``(keys..., kind, word, bits)``, ``kind`` being the index in ``ids``.

    Null identifiers set no bit, but their group has a row; a null key is a group of its own; repeated rows change nothing; an
    empty table gives no rows.
    """
    _checked(keys)
    marks = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("kind"), position(F.col(c), bits).alias("pos")) for i, c in enumerate(ids)])
    return (
        df.select(*[F.col(k) for k in keys], F.explode(marks).alias("mark"))
        # an empty word stands for a null, so that a group of nulls only is a group
        .select(*keys, "mark.kind", F.coalesce(F.shiftright("mark.pos", 6).cast("int"), F.lit(0)).alias("word"), F.coalesce(F.expr("shiftleft(1L, cast(mark.pos & 63 as int))"), F.lit(0).cast("long")).alias("bits"))
        .groupBy(*keys, "kind", "word")
        .agg(F.bit_or("bits").alias("bits"))
    )


def merge(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the bitmaps of all groups that agree in ``keys``."""
    return partial.groupBy(*keys, "kind", "word").agg(F.bit_or("bits").alias("bits"))


def estimate(partial: DataFrame, keys: list[str], names: list[str], bits: int) -> DataFrame:
    """Per group and kind: ``<name>`` (estimate) and ``<name>_error`` (three standard errors, relative to the estimate).

    A group without identifiers of a kind has estimate and error 0. A full bitmap gives nulls: the
    group holds more than it was sized for, and must be sketched again with more bits.
    """
    ones = partial.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == i, F.bit_count("bits"))), F.lit(0)).cast("double").alias(f"o{i}") for i in range(len(names))])
    columns = []
    for i, name in enumerate(names):
        load = F.when(F.col(f"o{i}") < bits, -F.log((F.lit(float(bits)) - F.col(f"o{i}")) / F.lit(float(bits))))
        columns += [
            F.round(load * bits).cast("long").alias(name),
            F.when(F.col(f"o{i}") == 0, F.lit(0.0)).otherwise(F.round(F.lit(3.0) * F.sqrt((F.exp(load) - load - 1) * bits) / (load * bits), 6)).alias(f"{name}_error"),
        ]
    return ones.select(*keys, *columns)


def cube(partial: DataFrame, fixed: list[str], dims: list[str]) -> DataFrame:
    """The partial result for every combination of ``dims``: ``(fixed..., dims..., level, kind, word, bits)``.

    In a subtotal the dims summed over are null and their bits of ``level`` are set (the first dim has
    the highest bit). The words are partitioned by position once; all subtotals of a position are
    unions within its partition, so the expansion to 2^n levels is never shuffled.
    """
    n = len(dims)
    placed = partial.repartition(*fixed, "kind", "word")
    levels = placed.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(1 << n)])))
    kept = [F.when(F.col("level").bitwiseAND(F.lit(1 << (n - 1 - i))) == 0, F.col(d)).alias(d) for i, d in enumerate(dims)]
    return levels.select(*fixed, *kept, "level", "kind", "word", "bits").groupBy(*fixed, *dims, "level", "kind", "word").agg(F.bit_or("bits").alias("bits"))
