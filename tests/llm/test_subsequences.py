from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runloom.llm import subsequences
from runloom.llm.subsequences import frequent_patterns, shorten

SCHEMA = "run string, step int, at timestamp_ntz, item string, s string, code int, o0 int"
AT = datetime(2026, 1, 1)


def contained(word, length):
    """All subsequences of at most ``length`` letters."""
    found = {()}
    for letter in word:
        found |= {p + (letter,) for p in found if len(p) < length}
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 4))
def test_shortening_keeps_the_subsequences(word, length):
    short = shorten(np.array(word, int), length)
    assert contained(short.tolist(), length) == contained(word, length)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=25), st.lists(st.integers(0, 2), max_size=25))
def test_shortened_parts_join(first, second):
    joined = np.concatenate([shorten(np.array(w, int), 3) for w in (first, second)]).tolist()
    assert contained(joined, 3) == contained(first + second, 3)


def test_long_words_become_short():
    word = np.random.default_rng(0).integers(0, 5, 20_000)
    assert len(shorten(word, 3)) < 60


def brute(rows, support, length):
    runs = {}
    for run, step, at, item, *_ in rows:
        if run is not None and item is not None:
            runs.setdefault(run, []).append((-(10**9) if step is None else step, AT - timedelta(days=9) if at is None else at, item))
    counts = {}
    for events in runs.values():
        for pattern in contained([x[2] for x in sorted(events)], length) - {()}:
            counts[pattern] = counts.get(pattern, 0) + 1
    return {p: n for p, n in counts.items() if n >= support}


def rows(seed, n=60):
    rng = random.Random(seed)
    return [(f"r{r}", step, AT + timedelta(seconds=rng.randrange(3)), rng.choice("aaabbcd") if rng.random() > 0.1 else None, "x", 1, 2) for r in range(n) for step in range(rng.choice([0, 1, 2, 5, 9]))]


@pytest.mark.parametrize("support", [1, 8])
def test_against_brute_force(frame, support):
    data = rows(3)
    data += data[:15] + [(None, 1, AT, "a", "x", 1, 2), ("r1", None, None, "d", "x", 1, 2)]
    got = {tuple(r["items"]): r.support for r in frequent_patterns(frame(data, SCHEMA), "run", ["step", "at"], "item", support, 3).collect()}
    assert got == brute(data, support, 3)


@pytest.mark.parametrize("order", ["rising", "constant", "null"])
def test_a_hot_sequence_is_spread_over_tasks(frame, order):
    """Whatever its order values are: a rising step, and times that differ beside a step that is constant or null."""
    rng = random.Random(9)
    step = {"rising": lambda i: i, "constant": lambda i: 7, "null": lambda i: None}[order]
    data = [("hot", step(i), AT + timedelta(seconds=i), rng.choice("abcde"), "x", 1, 2) for i in range(20_000)] + rows(4, 20)
    got = {tuple(r["items"]): r.support for r in frequent_patterns(frame(data, SCHEMA), "run", ["step", "at"], "item", 2, 3).collect()}
    assert got == brute(data, 2, 3)
    collapsed = subsequences.collapse(frame(data, SCHEMA), "run", ["step", "at"], "item", 3)
    words = subsequences.assemble(collapsed, list("abcde"), 3)
    assert max(len(r.codes) for r in words.collect()) < 600
    # the range partitioning that assemble makes: no task has more than a little over its share
    keys = ["s", "o0", "o1", "item"]
    tasks = [r["count"] for r in collapsed.repartitionByRange(4, *keys).groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 2 and max(tasks) < 0.5 * sum(tasks)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.integers(0, 2), max_size=12)), max_size=12))
def test_words_in_pieces(pieces):
    pieces.sort(key=lambda x: x[0])
    words, got, want = subsequences._Words(3), {}, {}
    subsequences.SHORT, before = 4, subsequences.SHORT
    try:
        for name, codes in pieces:
            want[name] = want.get(name, []) + codes
            if done := words.add(name, np.array(codes, int)):
                got[done[0]] = done[1].tolist()
        if done := words.end():
            got[done[0]] = done[1].tolist()
    finally:
        subsequences.SHORT = before
    assert set(got) == set(want) and all(contained(got[n], 3) == contained(want[n], 3) for n in want)


def test_repeated_items_need_different_steps(frame):
    data = [("r", i, AT, "a", "x", 1, 2) for i in range(2)]
    got = {tuple(r["items"]) for r in frequent_patterns(frame(data, SCHEMA), "run", ["step", "at"], "item", 1, 3).collect()}
    assert got == {("a",), ("a", "a")}


def test_empty_and_small_blocks(frame, monkeypatch):
    assert frequent_patterns(frame([], SCHEMA), "run", ["step", "at"], "item", 1, 3).count() == 0
    assert frequent_patterns(frame(rows(1), SCHEMA), "run", ["step", "at"], "item", 10**6, 3).count() == 0
    monkeypatch.setattr(subsequences, "PAIRS", 5)
    words = [np.array(w) for w in itertools.islice(itertools.product(range(3), repeat=4), 40)]
    pattern, count = subsequences._extensions(words, 3, [np.arange(9)])
    got = {(p // 9, p // 3 % 3, p % 3): n for p, n in zip(pattern.tolist(), count.tolist())}
    want = {}
    for w in words:
        for p in {x for x in contained(w.tolist(), 3) if len(x) == 3}:
            want[p] = want.get(p, 0) + 1
    assert got == want


def test_too_many_frequent_items_raise(frame):
    steps = frame([("s", i, f"item {i}") for i in range(4)], "run string, step long, name string")
    with pytest.raises(ValueError, match="more than 3 frequent"):
        frequent_patterns(steps, "run", ["step"], "name", 1, 1, max_patterns=3)
    assert frequent_patterns(steps, "run", ["step"], "name", 1, 1, max_patterns=4).count() == 4
