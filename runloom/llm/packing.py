"""Filling fixed-capacity containers, by the configuration linear program over the length histogram.

Items are (document, length). Lengths are rounded up to units of the capacity, so the program sees a
histogram of at most UNITS classes however many items there are. Items of 1 / SMALL of the capacity or
more are its classes, in groups of neighbouring classes that count as their mean; all smaller ones
together are one more class, a fluid of their total size.
A configuration says how many items of each group one container takes and how much room it leaves to the
fluid. Multiplicative weights find the configurations of the covering program: each round a knapsack
dynamic program prices the best one under the weights, and classes it holds lose weight. Pivots make the
best mix of them a basic solution, and pricing that closes the gap to the program's lower bound to GAP.
It is rounded down, and what remains is solved again until it fills a few containers. As groups are
means, each container gives its smallest item of two or more back (and more where it is overfull). These,
the small items and the last large ones then go, largest first, where each leaves least room;
``Plan.program_share`` says what share of the large items' size stays where the program placed it.

The plan is a list of (configuration, containers): its size depends on the classes, not on the items.
Items find their container without meeting each other: an item's rank within its class is a slot, and
slots belong to containers by ranges. Ranks are taken in shards of a class, so no class is one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.session import cut

UNITS = 8192
#: Items under 1 / SMALL of the capacity are a fluid to the program.
SMALL = 4
#: Groups of classes in the program at most.
CLASSES = 600
#: Step of the weights of the class that a round covers most, and rounds of the weights per class.
STEP = 0.25
ROUNDS = 1
#: Pivots behind which the basis is inverted anew.
REFRESH = 200
#: Configurations that pivots choose from before all are priced again.
FEW = 30
#: Pivots per class without a container saved, and configurations per class priced behind the weights' rounds, before a solve stops short of GAP.
STALLED = 2
PRICED = 2
#: The program is solved until its containers are certified to be within this share of its lower bound.
GAP = 0.0005


def price(weights: np.ndarray, classes: np.ndarray, units: int) -> np.ndarray:
    """Copies of each class in the container of greatest weight: an unbounded knapsack.

    ``classes`` are sizes in units, ascending. Capacities are solved in blocks no longer than the
    smallest class, so that a block depends on earlier ones only and is one table of
    (capacity, class) values.
    """
    # a class that a smaller one outweighs is never needed
    useful = np.flatnonzero(weights > np.r_[-np.inf, np.maximum.accumulate(weights)[:-1]])
    every, classes, weights = classes, classes[useful], weights[useful]
    block, pad = int(classes[0]), int(classes[-1])
    best = np.full(pad + units + 1, -np.inf)
    best[pad : pad + min(block, units + 1)] = 0.0
    choice = np.full(units + 1, -1)
    for low in range(block, units + 1, block):
        rows = np.arange(low, min(low + block, units + 1))
        fit = int(np.searchsorted(classes, rows[-1], "right"))
        value = best[pad + rows[:, None] - classes[None, :fit]] + weights[:fit]
        pick = value.argmax(1)
        top = value[np.arange(len(rows)), pick]
        # a larger capacity is never worse: carry the best smaller one along
        carried = np.maximum.accumulate(np.r_[best[pad + low - 1], top])[1:]
        choice[rows] = np.where(top >= carried, pick, -1)
        best[pad + rows] = carried
    taken = np.zeros(len(every), np.int64)
    room = units
    while room >= block:
        if choice[room] < 0:
            room -= 1
        else:
            taken[useful[choice[room]]] += 1
            room -= int(classes[choice[room]])
    return taken


class _Basis:
    """A basic solution of the covering program over the configurations known so far, made better by pivots."""

    def __init__(self, classes: np.ndarray, demand: np.ndarray, units: int):
        # a configuration of its own for every class; demands that differ in far digits keep pivots from going in circles
        self.m = len(classes)
        self.demand = demand * (1 + 1e-7 * (np.arange(1, self.m + 1) * 0.6180339887 % 1))
        self.columns = np.diag(units // classes).astype(float)
        self.cost = np.ones(self.m)
        self.inverse = np.diag(1.0 / np.diag(self.columns))
        self.amount = self.inverse @ self.demand
        self.pivots = 0

    def prices(self) -> np.ndarray:
        return self.cost @ self.inverse

    def improve(self, known: np.ndarray) -> None:
        """Pivot until none of the ``known`` configurations, nor less of a class that is covered twice, saves a container."""
        some, lowest, idle = known[:0], np.inf, 0
        while idle < STALLED * self.m:
            total = float(self.cost @ self.amount)
            lowest, idle = (total, 0) if total < lowest * (1 - 1e-9) else (lowest, idle + 1)
            y = self.prices()
            if not len(some) or (some @ y).max() < 1 + 1e-7:  # all are priced again only when the best few are used up
                saved = known @ y
                some = known[np.argsort(saved)[-FEW:]]
            saved = some @ y - 1
            best, spare = int(saved.argmax()), int(y.argmin())
            if max(saved[best], -y[spare]) < 1e-7:
                return
            column, cost = (some[best], 1.0) if saved[best] >= -y[spare] else (-np.eye(self.m)[spare], 0.0)
            move = self.inverse @ column
            ratio = np.divide(self.amount, move, out=np.full(self.m, np.inf), where=move > 1e-9)
            out = int(ratio.argmin())
            if ratio[out] == np.inf:
                return
            self.columns[:, out], self.cost[out] = column, cost
            self.pivots += 1
            self._exchange(out, move)
            if self.pivots % REFRESH == 0:
                self._refresh()
            self.amount = np.maximum(self.inverse @ self.demand, 0.0)

    def _exchange(self, out: int, move: np.ndarray) -> None:
        row = self.inverse[out] / move[out]
        self.inverse -= np.outer(move, row)
        self.inverse[out] = row

    def _refresh(self) -> None:
        """The inverse anew, by exchanging the unit columns for the basis' own, so that rounding does not add up."""
        columns, self.inverse, open_ = self.columns, np.eye(self.m), np.ones(self.m, bool)
        order = np.zeros(self.m, int)
        for i in range(self.m):
            move = self.inverse @ columns[:, i]
            out = int((np.abs(move) * open_).argmax())
            self._exchange(out, move)
            open_[out], order[i] = False, out
        self.inverse = self.inverse[order]


def solve(classes: np.ndarray, counts: np.ndarray, units: int, fluid: float = 0.0) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Fractional (copies, containers) that cover the counts and ``fluid`` units of anything, and a lower bound of the containers.

    The last of the copies is the room left to the fluid, if there is any. Multiplicative weights find
    configurations; the best mix of those found is a basic solution, with no more configurations than
    classes. Any weights bound the containers from below, so the gap of the two is known; what the weights
    leave of it is closed by pricing the basic solution itself.
    """
    sizes, demand = (np.r_[classes, 1], np.r_[counts, fluid]) if fluid > 0 else (classes, counts)
    weights, known, bound = sizes / units, {}, 0.0
    basis = _Basis(sizes, demand, units)

    def priced(y: np.ndarray) -> np.ndarray:
        nonlocal bound
        # room is worth what the fluid in it is
        worth = y[-1] if fluid > 0 else 0.0
        over = y[: len(classes)] - worth * classes
        copies = price(over, classes, units) if over.max() > 0 else np.zeros(len(classes), np.int64)
        if fluid > 0:
            copies = np.r_[copies, units - int(copies @ classes)]
        known.setdefault(copies.tobytes(), copies)
        bound = max(bound, float(demand @ y) / float(copies @ y))
        return copies

    for _ in range(ROUNDS * len(sizes)):
        copies = priced(weights)
        hit = copies > 0
        gained = copies / demand
        weights = weights * np.exp(-STEP * gained / gained[hit].max())
        weights /= weights.max()
    for _ in range(PRICED * len(sizes) + 20):
        before = len(known)
        basis.improve(np.array(list(known.values()), float))
        priced(np.maximum(basis.prices(), 1e-12))
        if float(basis.cost @ basis.amount) <= bound * (1 + GAP) or len(known) == before:
            break
    mix = [(basis.columns[:, i].round().astype(np.int64), float(basis.amount[i])) for i in np.flatnonzero(basis.cost)]
    return mix, bound


@dataclass
class Plan:
    """Configurations with the number of containers each; class k holds lengths of ((k - 1) * unit, k * unit]."""

    capacity: int
    unit: int
    configurations: list[tuple[dict[int, int], int]] = field(default_factory=list)
    #: Share of the size of the large items (but those of the last, partial unit) that the program's configurations hold.
    program_share: float = 0.0
    #: Greatest certified gap of a solve: its containers over its lower bound, less 1.
    gap: float = 0.0
    #: No plan has fewer containers: the items' size, and the items of more than half a container.
    least: int = 0

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.configurations)

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, first rank, copies per container and first container of each range of slots, by class and rank."""
        rows, passed, base = [], {}, 0
        for copies, n in self.configurations:
            for k, c in copies.items():
                rows.append((k, passed.get(k, 0), c, base))
                passed[k] = passed.get(k, 0) + c * n
            base += n
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def plan_containers(histogram: dict[int, int], capacity: int) -> Plan:
    """Plan for ``{length: items}``, 0 < length <= capacity: a slot for every item."""
    unit = -(-capacity // UNITS)
    units = capacity // unit
    plan = Plan(capacity, unit)
    left = np.zeros(units + 2, np.int64)
    for length, n in histogram.items():
        # lengths of the last, partial unit have a container of their own
        left[min(-(-length // unit), units + 1)] += n
    if left[units + 1]:
        plan.configurations.append(({units + 1: 1}, int(left[units + 1])))
    plan.least = max(-(-sum(length * n for length, n in histogram.items()) // capacity), sum(n for length, n in histogram.items() if 2 * length > capacity))
    left = left[: units + 1]
    found: list[tuple[dict[int, int], int]] = []
    size = np.arange(units + 1)
    large = size * SMALL >= units
    whole, fluid = int((left * size)[large].sum()), int((left * size)[~large].sum())
    # a basic solution rounded down loses less than a container per group; what is lost is solved again
    while True:
        groups = _grouped(left * large, units)
        if not groups:
            break
        stock = np.array([left[g].sum() for g in groups])
        mean = np.array([-(-int(g @ left[g]) // int(n)) for g, n in zip(groups, stock)])
        mix, bound = solve(mean, stock, units, fluid)
        plan.gap = max(plan.gap, sum(amount for _, amount in mix) / bound - 1)
        before = len(found)
        for copies, amount in sorted(mix, key=lambda x: -x[1]):
            n = int(amount + 1e-6)
            fluid = max(0, fluid - n * int(copies[len(groups) :].sum()))
            _use(found, left, groups, copies[: len(groups)], n)
        if len(found) == before:
            break
    # a container's smallest item is given back, to be chosen by best fit in the room that there really is
    for copies, n in found:
        first = True
        while sum(copies.values()) > 1 and (first or sum(k * c for k, c in copies.items()) > units):
            k, first = min(copies), False
            left[k] += n
            copies[k] -= 1
            if not copies[k]:
                del copies[k]
    plan.program_share = 1 - int((left * size)[large].sum()) / whole if whole else 0.0
    plan.configurations += _best_fit(found, left, units)
    return plan


def _grouped(left: np.ndarray, units: int) -> list[np.ndarray]:
    """Ascending classes in at most CLASSES groups of about equal size, one and a half containers or more each."""
    large = np.flatnonzero(left)
    if not len(large):
        return []
    passed = np.cumsum(large * left[large])
    most = min(CLASSES, int(passed[-1]) * 2 // (3 * units))
    if len(large) <= most:
        return [large[i : i + 1] for i in range(len(large))]
    return np.split(large, np.flatnonzero(np.diff((passed - 1) * most // passed[-1])) + 1) if most else []


def _use(found: list[tuple[dict[int, int], int]], left: np.ndarray, groups: list[np.ndarray], copies: np.ndarray, n: int) -> None:
    """Use a configuration of groups ``n`` times, the largest items of each group first; where items run out, with fewer copies.

    Copies take their items by ranges, so the configurations of classes that this gives are as many as
    ranges of classes end, however large ``n`` is.
    """
    stock = np.array([left[g].sum() for g in groups])
    while n and (copies := np.minimum(copies, stock)).any():
        hit = np.flatnonzero(copies)
        some = min(n, int((stock[hit] // copies[hit]).min()))
        ranges, edges = [], {0, some}
        for g in hit.tolist():
            classes = groups[g][::-1]
            ends = np.cumsum(left[classes])
            for at in range(0, int(copies[g]) * some, some):
                ranges.append((classes, ends, at))
                edges.update((ends[(ends > at) & (ends < at + some)] - at).tolist())
        steps = sorted(edges)
        for low, high in zip(steps, steps[1:]):
            taken: dict[int, int] = {}
            for classes, ends, at in ranges:
                k = int(classes[np.searchsorted(ends, at + low, "right")])
                taken[k] = taken.get(k, 0) + 1
            found.append((taken, high - low))
            for k, c in taken.items():
                left[k] -= c * (high - low)
        stock[hit] -= copies[hit] * some
        n -= some


def _best_fit(found: list[tuple[dict[int, int], int]], left: np.ndarray, units: int) -> list[tuple[dict[int, int], int]]:
    """The configurations with all remaining items, largest first, each where it leaves least room; new ones where it fits nowhere.

    Equal containers take an item each at once, and of an item that is tiny against the room, many.
    """
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(copies: dict[int, int], n: int) -> None:
        room = units - sum(k * c for k, c in copies.items())
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((copies, n))

    for copies, n in found:
        put(copies, n)
    for k in np.flatnonzero(left)[::-1].tolist():
        m = int(left[k])
        while m:
            at = bisect.bisect_left(rooms, k)
            if at == len(rooms):
                each = units // k
                if m >= each:
                    put({k: each}, m // each)
                if m % each:
                    put({k: m % each}, 1)
                break
            room = rooms[at]
            copies, n = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            some = min(n, m)
            each = max(1, min(room // k // 4, m // some))
            if some < n:
                put(copies, n - some)
            put({**copies, k: copies.get(k, 0) + each}, some)
            m -= each * some
        left[k] = 0
    return [entry for entries in by_room.values() for entry in entries]


def pack(sizes: DataFrame, item: str, size: str, capacity: int, shard_rows: int = 200_000) -> tuple[DataFrame, Plan]:
    """``(item, piece_no, n_pieces, piece_size, container)`` and the plan.

    An item larger than ``capacity`` is split: full pieces have a container each ("own-..."), the rest
    is packed ("mix-<number>") like any other item. Items of null or zero size have one piece and no
    container (null). Items must be unique; extra columns are ignored; an empty table gives no rows.
    """
    rows = sizes.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    rest = F.pmod("size", F.lit(capacity))
    # an item of just the capacity is not split; a larger one's rest may be empty
    rows = cut(rows.withColumn("full", F.when(F.col("size") > capacity, F.floor(F.col("size") / capacity)).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.when(F.col("size") > capacity, rest).otherwise(F.col("size"))))
    # at most one row per length up to the capacity
    histogram = {r["rest"]: r["n"] for r in rows.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    plan = plan_containers(histogram, capacity)
    total = sum(histogram.values())
    unit, last = plan.unit, capacity // plan.unit + 1
    shards = max(1, -(-total // shard_rows))
    classed = rows.where("rest > 0").select("item", "full", "rest", F.least(F.ceil(F.col("rest") / unit), F.lit(last)).cast("long").alias("k"), F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"))
    counted = classed.groupBy("k", "shard").agg(F.count("*").alias("n"))
    before = counted.select("k", "shard", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = (
        classed.withColumn("no", F.row_number().over(Window.partitionBy("k", "shard").orderBy("item")))
        .join(before, ["k", "shard"])
        .select("item", "full", "rest", "k", (F.col("before") + F.col("no") - 1).alias("rank"))
    )
    slot_class, slot_rank, slot_copies, slot_base = plan.slots()
    slot_key = slot_class * (1 << 44) + slot_rank
    kind = sizes.schema[item].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("full", T.LongType()), T.StructField("rest", T.LongType()), T.StructField("number", T.LongType())])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank = frame["rank"].to_numpy()
            at = np.searchsorted(slot_key, frame["k"].to_numpy() * (1 << 44) + rank, "right") - 1
            yield frame[["item", "full", "rest"]].assign(number=slot_base[at] + (rank - slot_rank[at]) // slot_copies[at])

    packed = ranked.mapInPandas(place, schema)
    pieces = F.col("full") + F.lit(1)
    mixed = packed.select("item", pieces.alias("piece_no"), pieces.alias("n_pieces"), F.col("rest").alias("piece_size"), F.concat(F.lit("mix-"), F.col("number")).alias("container"))
    n = F.col("full") + (F.col("rest") > 0).cast("long")
    own = rows.where("full > 0").select("item", F.explode(F.sequence(F.lit(1).cast("long"), F.col("full"))).alias("piece_no"), n.alias("n_pieces"), F.lit(capacity).cast("long").alias("piece_size"), F.concat(F.lit("own-"), F.col("item").cast("string"), F.lit("-"), F.col("piece_no")).alias("container"))
    empty = rows.where("size = 0").select("item", F.lit(1).cast("long").alias("piece_no"), F.lit(1).cast("long").alias("n_pieces"), F.lit(0).cast("long").alias("piece_size"), F.lit(None).cast("string").alias("container"))
    return mixed.unionByName(own).unionByName(empty).withColumnRenamed("item", item), plan
