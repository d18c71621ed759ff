from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from runloom.operators.sessions import sessions

SCHEMA = "user string, at timestamp_ntz, entity string, t long, tile long, e string"
ZERO = datetime(1970, 1, 1)


def row(user, ms):
    return (user, None if ms is None else ZERO + timedelta(milliseconds=ms), "x", 1, 2, "y")


def brute(rows, gap):
    times = {}
    for user, at, *_ in rows:
        if user is not None and at is not None:
            times.setdefault(user, []).append(round((at - ZERO).total_seconds() * 1000))
    out = set()
    for user, all_times in times.items():
        all_times.sort()
        start = last = all_times[0]
        n = 0
        for t in all_times:
            if t - last > gap:
                out.add((user, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.add((user, start, last, last - start, n))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("tile", [7, 100, 100_000])
def test_against_brute_force(frame, seed, tile):
    rng = random.Random(seed)
    rows, at = [], {"a": 0, "b": -500, "c": 90}
    for _ in range(300):
        user = rng.choice("aaaabc")
        at[user] += rng.choice([0, 0, 1, 5, 9, 10, 11, 30, 250])
        rows.append(row(user, at[user]))
    rows += [row(None, 5), row("a", None), row("single", 3)] + rows[:10]
    got = [tuple(r) for r in sessions(frame(rows, SCHEMA), "user", "at", gap_ms=10, tile_ms=tile).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 10)


def test_a_gap_of_exactly_the_limit_does_not_split(frame):
    half_hour = 30 * 60 * 1000
    rows = [row("a", 0), row("a", half_hour), row("a", 2 * half_hour + 1)]
    got = sorted((r.start_ms, r.end_ms, r.n_events) for r in sessions(frame(rows, SCHEMA), "user", "at").collect())
    assert got == [(0, half_hour, 2), (2 * half_hour + 1, 2 * half_hour + 1, 1)]


def test_empty(frame):
    assert sessions(frame([], SCHEMA), "user", "at").count() == 0
