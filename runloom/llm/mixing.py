"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix has the size of the whole corpus and is divided into ``blocks`` equal blocks of tokens. Blocks
go to the sources by the highest quotient share / (2 a + 1), a being the blocks a source has; a source
that runs into its cap of repeats keeps what it has. Within a source the tokens of its blocks go to
shards in the same way, in blocks of the shards' own, small against a shard however large the source's
blocks are, and in proportion to the shards' tokens; what rounding and the shards' caps leave over goes
to shards with room, so a source's quota is met to the token. A shard uses all its documents as often as
its quota holds them whole, and once more those in the first blocks of a seeded order. Shards hold a
bounded number of documents, so a source with a third of all rows is many shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import cut

BLOCKS = 10_000
#: Documents that a shard holds, about, and shards of a source at most: beyond their product shards grow.
SHARD_ROWS = 100_000
MOST_SHARDS = 20_000
#: Blocks of its own that a shard's share is cut into, on average.
SHARD_BLOCKS = 64


def apportion(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Sainte-Laguë: ``seats`` by highest quotients weight / (2 a + 1), at most ``caps`` each.

    Ties go to the earlier one. Seats that no cap admits, or all if no weight is positive, stay empty.
    The seats above a common quotient, found by bisection, are given at once; only the last ones, about
    two for each weight, are given one by one.
    """
    given = _above_quotient(np.array(weights, float), seats, None if caps is None else np.array(caps, float))
    seats -= sum(given)
    queue = [(-w / (2 * a + 1), i) for i, (w, a) in enumerate(zip(weights, given)) if w > 0 and (caps is None or a < caps[i])]
    heapq.heapify(queue)
    while seats > 0 and queue:
        _, i = heapq.heappop(queue)
        given[i] += 1
        seats -= 1
        if caps is None or given[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * given[i] + 1), i))
    return given


def _above_quotient(weights: np.ndarray, seats: int, caps: np.ndarray | None) -> list[int]:
    """Seats of each weight whose quotients surely come before the last ones: the seats above a quotient, less one each."""
    total = weights.sum()
    if total <= 0 or seats <= 0:
        return [0] * len(weights)

    def above(divisor: float) -> np.ndarray:
        n = np.floor(weights / divisor + 0.5)
        return n if caps is None else np.minimum(n, np.maximum(caps, 0))

    # with ``high`` no weight has more seats than there are; with caps the divisor may have to go far down
    low, high = total / (seats + len(weights)) * 1e-9, 2 * total
    for _ in range(200):
        middle = (low * high) ** 0.5
        if above(middle).sum() <= seats:
            high = middle
        else:
            low = middle
        if high / low < 1 + 1e-12:
            break
    return np.maximum(above(high) - 1, 0).astype(np.int64).tolist()


def share_out(quota: int, held: list[int], repeats: int) -> list[int]:
    """Tokens of ``quota`` for each shard, by Sainte-Laguë in proportion to ``held``; together exactly the quota, or all that
    ``repeats`` uses give if that is less."""
    room = np.array(held, np.int64) * repeats
    quota = min(quota, int(room.sum()))
    block = max(1, quota // (SHARD_BLOCKS * max(1, len(held))))
    given = np.array(apportion([float(h) for h in held], quota // block, (room // block).tolist()), np.int64) * block
    # less than a block for the last and for each shard at its cap: to the shards that have room, in order
    room -= given
    before = np.cumsum(room) - room
    return (given + np.clip(quota - int(given.sum()) - before, 0, room)).tolist()


def at_cap(turns: list[int], caps: list[int]) -> list[bool]:
    """Which sources run into their cap, in whole blocks, within the seats that come to them.

    Seats lie within half a block and half the number of sources of the exact share, so with that margin
    no source that is short is left out.
    """
    return [cap <= turn + 1 + len(caps) / 2 for turn, cap in zip(turns, caps)]


def clean_source(column: Column) -> Column:
    """Source names compare without regard to letter case and surrounding blanks."""
    return F.lower(F.btrim(column, F.lit(" \t\r\n")))


def mix(sizes: DataFrame, item: str, source: str, tokens: str, targets: list[tuple[str, str, float, int]], blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Uses and shares.

    ``targets``: (mix, source, target share, greatest number of uses of a document), a fixed small
    list. Uses: ``(mix_id, source, item, tokens, uses)``, uses of 1 or more. Shares: one row per target,
    ``(mix_id, source, target_share, max_repeats, tokens_available, longest_tokens, tokens_target, tokens_used,
    tokens_off, block_tokens, share_of_target_size, share_reached, is_short)``; ``is_short`` if all documents at full
    repeats have fewer tokens than the target share of the tokens of all documents. ``tokens_off`` is used
    less target; of a source that is not short it is within a block or so of ``block_tokens`` and less than
    a document (of ``longest_tokens`` at most) for each shard, either way and without a bias. Documents without source count
    in that total and are in no mix; null or zero sizes use no tokens and are left out; a target without
    documents is short unless there are no tokens at all (then every target is 0). Equal documents are documents of their own; items must be unique.
    """
    spark = sizes.sparkSession
    rows = cut(sizes.select(F.col(item).alias("item"), clean_source(F.col(source)).alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens")))
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    size = max(1, -(-total // blocks))
    named = sorted({clean for _, clean, _, _ in targets})
    sums = rows.where(F.col("source").isin(named)).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"), F.count("*").alias("n")).collect()
    held, longest = {r["source"]: r["tokens"] for r in sums}, {r["source"]: r["longest"] for r in sums}
    counts = {s: 1 for s in named} | {r["source"]: min(MOST_SHARDS, -(-r["n"] // shard_rows)) for r in sums}
    shards_of = spark.createDataFrame(pd.DataFrame({"source": pd.Series(list(counts), dtype=object), "shards": pd.Series(list(counts.values()), dtype="int64")}), "source string, shards long")
    placed = rows.where("tokens > 0").join(F.broadcast(shards_of), "source").withColumn("shard", F.pmod(F.xxhash64("item", F.lit(seed)), F.col("shards"))).drop("shards")
    # one row per shard, MOST_SHARDS a source at most
    shard_tokens = {s: [] for s in named}
    for r in placed.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).orderBy("source", "shard").collect():
        shard_tokens[r["source"]].append((r["shard"], r["tokens"]))
    quotas, report = [], []
    for mix_id in dict.fromkeys(m for m, *_ in targets):
        own = [t for t in targets if t[0] == mix_id]
        turns = apportion([t[2] for t in own], round(blocks * sum(t[2] for t in own)))
        # seats that come to a source at its cap stay empty; whether it is short by part of a block, the sums say
        reached = at_cap(turns, [held.get(name, 0) * repeats // size for _, name, _, repeats in own])
        for (_, name, share, repeats), seats, full in zip(own, turns, reached):
            available, wanted = held.get(name, 0), share * total
            short = full and available * repeats < wanted
            report.append((mix_id, name, float(share), int(repeats), int(available), int(longest.get(name, 0)), float(wanted), short))
            if not available:
                continue
            shares = shard_tokens[name]
            if short:  # every document at full repeats
                quotas += [(mix_id, name, shard, repeats, 0) for shard, _ in shares]
                continue
            tokens_of = [t for _, t in shares]
            for (shard, held_here), quota in zip(shares, share_out(seats * size, tokens_of, repeats)):
                quotas.append((mix_id, name, shard, quota // held_here, quota % held_here))
    quota = spark.createDataFrame(pd.DataFrame(quotas, columns=["mix_id", "source", "shard", "whole", "part"]), "mix_id string, source string, shard long, whole long, part long") if quotas else spark.createDataFrame([], "mix_id string, source string, shard long, whole long, part long")
    order = Window.partitionBy("mix_id", "source", "shard").orderBy(F.xxhash64("item", F.lit(seed + 1), "mix_id"), "item")
    passed = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    uses = (
        placed.join(F.broadcast(quota), ["source", "shard"])  # at most MOST_SHARDS rows a target
        # the document on a quota's edge is in as often as the quota reaches into it, so that shards' errors cancel out
        .withColumn("reach", passed - F.col("tokens") * (F.pmod(F.xxhash64("mix_id", "source", "shard", F.lit(seed + 2)), F.lit(1 << 20)) + 0.5) / (1 << 20))
        .select("mix_id", "source", "item", "tokens", (F.col("whole") + (F.col("reach") < F.col("part")).cast("long")).alias("uses"))
        .where("uses > 0")
    )
    used = uses.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"))
    targeted = spark.createDataFrame(report, "mix_id string, source string, target_share double, max_repeats long, tokens_available long, longest_tokens long, tokens_target double, is_short boolean")
    shares = targeted.join(F.broadcast(used), ["mix_id", "source"], "left").withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0)))
    whole = F.sum("tokens_used").over(Window.partitionBy("mix_id"))
    shares = shares.select(
        "mix_id",
        "source",
        "target_share",
        "max_repeats",
        "tokens_available",
        "longest_tokens",
        "tokens_target",
        "tokens_used",
        (F.col("tokens_used") - F.col("tokens_target")).alias("tokens_off"),
        F.lit(size).cast("long").alias("block_tokens"),
        (F.col("tokens_used") / F.lit(max(1, total))).alias("share_of_target_size"),
        F.when(whole > 0, F.col("tokens_used") / whole).otherwise(F.lit(0.0)).alias("share_reached"),
        "is_short",
    )
    return uses.withColumnRenamed("item", item), shares
