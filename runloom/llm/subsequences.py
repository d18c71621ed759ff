"""Frequent subsequences (gaps allowed) across many sequences, by last-position induction.

Per sequence the last position of each item is known. A prefix is known by the end of its first match;
an item extends it exactly if the item's last position lies behind that end. Patterns grow level by
level: each level is one pass over the item arrays that counts, per batch of sequences, the extensions
of the prefixes that are frequent over all sequences; only (pattern, count) rows are shuffled.

Before sequences are assembled, equal steps are collapsed and infrequent items dropped. Steps are then
range-partitioned by sequence and order, so a sequence with a third of all rows is spread over tasks
whatever its order values are. A task reads its steps in order and keeps of each sequence a word that is
shortened whenever it grows (Simon's congruence: a word with the same subsequences up to the wanted
length, which concatenation preserves; a letter may go when its ranks from the left and the right exceed
that length by more than one). What a task holds of a sequence is bounded by the items, not the rows.
Only a task's first and last sequence can go on in another one; these pieces, two for each task, are
joined in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.session import cut

#: (prefix, item) pairs that a task holds at once.
PAIRS = 2_000_000
#: Words are shortened when they have grown by so many steps.
SHORT = 256


class _Ranks:
    """Per letter the length of the shortest word that would first end at its next occurrence."""

    def __init__(self) -> None:
        self.reach: dict[int, int] = {}

    def of(self, letter: int) -> int:
        return self.reach.get(letter, 1)

    def add(self, letter: int) -> None:
        rank = self.of(letter) + 1
        for other, known in self.reach.items():
            if known > rank:
                self.reach[other] = rank
        self.reach[letter] = rank


def shorten(word: np.ndarray, length: int) -> np.ndarray:
    """A word with the same subsequences of at most ``length`` letters.

    Ranks from the left are taken over the whole word; then, from the right, a letter whose two ranks
    exceed ``length`` + 1 is dropped at once, so both ranks always hold for the word as it then is.
    """
    left, ranks = _Ranks(), np.empty(len(word), np.int64)
    for i, letter in enumerate(word.tolist()):
        ranks[i] = left.of(letter)
        left.add(letter)
    right, kept = _Ranks(), []
    for i in range(len(word) - 1, -1, -1):
        letter = int(word[i])
        if ranks[i] + right.of(letter) <= length + 1:
            kept.append(i)
            right.add(letter)
    return word[kept[::-1]]


class _Words:
    """The words of sequences that come one behind the other, in pieces; each is shortened whenever it has grown."""

    def __init__(self, length: int):
        self.length, self.name, self.parts, self.held, self.settled = length, None, [], 0, 0

    def _shortened(self) -> np.ndarray:
        word = np.concatenate(self.parts)
        return shorten(word, self.length) if len(word) > SHORT else word

    def add(self, name: object, codes: np.ndarray) -> tuple[object, np.ndarray] | None:
        """Take a piece; returns the sequence before with its word if this piece is another one's."""
        done = None
        if self.name is not None and name != self.name:
            done = self.end()
        self.name = name
        self.parts.append(codes)
        self.held += len(codes)
        if self.held > self.settled + SHORT:
            self.parts = [self._shortened()]
            self.held = self.settled = len(self.parts[0])
        return done

    def end(self) -> tuple[object, np.ndarray] | None:
        done = None if self.name is None else (self.name, self._shortened())
        self.name, self.parts, self.held, self.settled = None, [], 0, 0
        return done


def collapse(steps: DataFrame, sequence: str, order: list[str], item: str, length: int) -> DataFrame:
    """``(s, o0, o1, ..., item, times)``: equal steps as one row, ``times`` counted up to ``length``; null sequences and items are left out."""
    orders = [f"o{i}" for i in range(len(order))]
    rows = steps.select(F.col(sequence).alias("s"), *[F.col(c).alias(o) for c, o in zip(order, orders)], F.col(item).alias("item"))
    return rows.where("s is not null and item is not null").groupBy("s", *orders, "item").agg(F.least(F.count("*"), F.lit(length)).cast("int").alias("times"))


def item_supports(collapsed: DataFrame) -> DataFrame:
    """``(item, support)``: sequences that contain each item."""
    return collapsed.select("s", "item").distinct().groupBy("item").agg(F.count("*").alias("support"))


def assemble(collapsed: DataFrame, items: list[str], length: int) -> DataFrame:
    """``codes``: per sequence the codes (index in ``items``) of its steps in order, shortened where long.

    Steps of other items are left out; equal order values are ordered by code. Nulls in the order come first.
    """
    spark = collapsed.sparkSession
    names = spark.createDataFrame(pd.DataFrame({"item": pd.Series(items, dtype=object), "code": np.arange(len(items), dtype=np.int32)}), "item string, code int")
    keys = ["s", *[c for c in collapsed.columns if c not in ("s", "item", "times")], "code"]
    # one row per frequent item, of which frequent_patterns has a greatest number
    coded = collapsed.join(F.broadcast(names), "item").repartitionByRange(*keys).sortWithinPartitions(*keys).select("s", F.spark_partition_id().alias("part"), "code", "times")
    schema = T.StructType([T.StructField("s", collapsed.schema["s"].dataType), T.StructField("part", T.IntegerType()), T.StructField("edge", T.BooleanType()), T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, first = _Words(length), 0, True
        for frame in frames:
            if not len(frame):
                continue
            part = int(frame["part"].iloc[0])
            name = frame["s"].to_numpy()
            times = frame["times"].to_numpy()
            starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            codes = np.split(np.repeat(frame["code"].to_numpy(), times), np.cumsum(np.add.reduceat(times, starts))[:-1])
            done = [x for i, c in zip(starts.tolist(), codes) if (x := words.add(name[i], c))]
            if done:
                yield pd.DataFrame({"s": [x[0] for x in done], "part": part, "edge": [first] + [False] * (len(done) - 1), "codes": [x[1] for x in done]})
                first = False
        if last := words.end():
            yield pd.DataFrame({"s": [last[0]], "part": part, "edge": True, "codes": [last[1]]})

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words(length)
        for frame in frames:
            done = [x[1] for name, codes in zip(frame["s"], frame["codes"]) if (x := words.add(name, np.asarray(codes)))]
            if done:
                yield pd.DataFrame({"codes": done})
        if last := words.end():
            yield pd.DataFrame({"codes": [last[1]]})

    found = cut(coded.mapInPandas(pieces, schema))
    across = found.where("edge").repartition("s").sortWithinPartitions("s", "part").select("s", "codes").mapInPandas(joined, "codes array<int>")
    return found.where("not edge").select("codes").unionByName(across)


class _Batch:
    """The sequences of a batch: per (sequence, item) its positions; per sequence its items with last positions."""

    def __init__(self, words: list[np.ndarray], k: int):
        sizes = np.array([len(w) for w in words])
        self.k = k
        self.m = int(sizes.max()) + 1
        code = np.concatenate(words).astype(np.int64)
        seq = np.repeat(np.arange(len(words)), sizes)
        pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.places = np.sort((seq * k + code) * self.m + pos)
        cell = self.places // self.m
        first = np.r_[True, cell[1:] != cell[:-1]]
        last = np.r_[first[1:], True]
        self.seq, self.item = cell[first] // k, cell[first] % k
        self.first, self.last = self.places[first] % self.m, self.places[last] % self.m
        self.start = np.searchsorted(self.seq, np.arange(len(words) + 1))

    def pairs(self, seq: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, item index) of every prefix row (sequence, end) and each item that extends it, in blocks."""
        many = self.start[seq + 1] - self.start[seq]
        block = np.cumsum(many) // PAIRS
        for part in np.split(np.arange(len(seq)), np.flatnonzero(np.diff(block)) + 1):
            n = many[part]
            row = np.repeat(part, n)
            item = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.start[seq[row]]
            extends = self.last[item] > end[row]
            yield row[extends], item[extends]

    def next_place(self, seq: np.ndarray, item: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first position behind ``end`` of an item known to have one."""
        return self.places[np.searchsorted(self.places, (seq * self.k + item) * self.m + end, "right")] % self.m


def _extensions(words: list[np.ndarray], k: int, frequent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch: (prefix number * k + item, sequences) for all extensions of the prefixes of the last frequent level."""
    batch = _Batch(words, k)
    seq, prefix, end = batch.seq, batch.item, batch.first
    for known in frequent:  # known: sorted prefix * k + item of a level; a prefix's number is its index there
        grown = []
        for row, item in batch.pairs(seq, end):
            pattern = prefix[row] * k + batch.item[item]
            at = np.minimum(np.searchsorted(known, pattern), len(known) - 1)
            hit = known[at] == pattern
            row, item, at = row[hit], item[hit], at[hit]
            grown.append((seq[row], at, batch.next_place(seq[row], batch.item[item], end[row])))
        seq, prefix, end = (np.concatenate(x) for x in zip(*grown)) if grown else (seq[:0], prefix[:0], end[:0])
    found = []
    for row, item in batch.pairs(seq, end):  # a sequence has each prefix once, so each pattern once
        found.append(np.unique(prefix[row] * k + batch.item[item], return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pattern, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return pattern, np.bincount(where, np.concatenate([f[1] for f in found])).astype(np.int64)


def frequent_patterns(steps: DataFrame, sequence: str, order: list[str], item: str, min_support: int, length: int, max_patterns: int = 1_000_000) -> DataFrame:
    """``(items array<string>, support bigint)``: every pattern of 1 to ``length`` steps that at least
    ``min_support`` sequences contain, gaps allowed, items may repeat (then at different positions).

    Order within a sequence is ``order``, nulls first, equal steps by item name. Rows with null sequence
    or item are left out; an empty table gives no rows; repeated rows are repeated steps;
    extra columns are ignored. The frequent patterns of a level are held by the driver and sent to the
    tasks: more than ``max_patterns`` raise an error.
    """
    spark = steps.sparkSession
    min_support = max(1, min_support)
    collapsed = cut(collapse(steps, sequence, order, item, length))
    supports = {r["item"]: r["support"] for r in item_supports(collapsed).where(F.col("support") >= min_support).limit(max_patterns + 1).collect()}
    if len(supports) > max_patterns:
        raise ValueError(f"more than {max_patterns} frequent patterns; raise the support")
    items = sorted(supports)
    rows = [([name], supports[name]) for name in items]
    k = len(items)
    if k and length > 1:
        words = assemble(collapsed, items, length)
        levels: list[np.ndarray] = []
        patterns = [(i,) for i in range(k)]
        for _ in range(2, length + 1):
            known = list(levels)

            def count(frames: Iterator[pd.DataFrame], known: list[np.ndarray] = known) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    batch = [np.asarray(w) for w in frame["codes"] if len(w)]
                    if batch:
                        pattern, support = _extensions(batch, k, known)
                        yield pd.DataFrame({"pattern": pattern, "support": support})

            counted = words.mapInPandas(count, "pattern long, support long").groupBy("pattern").agg(F.sum("support").alias("support"))
            level = counted.where(F.col("support") >= min_support).limit(max_patterns + 1).toPandas().sort_values("pattern")
            if len(level) > max_patterns:
                raise ValueError(f"more than {max_patterns} frequent patterns; raise the support")
            found = level["pattern"].to_numpy()
            patterns = [(*patterns[p // k], p % k) for p in found.tolist()]
            rows += [([items[i] for i in pattern], int(n)) for pattern, n in zip(patterns, level["support"])]
            if not patterns:
                break
            levels.append(found)
    return spark.createDataFrame(rows, "items array<string>, support long")
