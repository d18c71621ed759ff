from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from runloom.operators.rolling import trailing_totals

SCHEMA = "agent string, at timestamp_ntz, cost decimal(12,6), entity string, day string"


def brute(rows, windows):
    cells, spans = defaultdict(lambda: [0, 0, Decimal(0)]), {}
    for agent, at, cost, *_ in rows:
        if agent is None or at is None:
            continue
        d = at.date()
        c = cells[agent, d]
        c[0] += 1
        if cost is not None:
            c[1] += 1
            c[2] += cost
        low, high = spans.get(agent, (d, d))
        spans[agent] = min(low, d), max(high, d)
    out = {}
    for agent, (low, high) in spans.items():
        for i in range((high - low).days + 1):
            day = low + timedelta(days=i)
            values = [cells[agent, day][0] if (agent, day) in cells else 0]
            for w in windows:
                near = [cells[agent, day - timedelta(days=k)] for k in range(w) if (agent, day - timedelta(days=k)) in cells]
                values += [sum((c[2] for c in near), Decimal(0)), sum(c[1] for c in near)]
            out[agent, day] = values
    return out


@pytest.mark.parametrize("tile", [3, 64])
def test_against_brute_force(frame, tile):
    rng = random.Random(5)
    start = datetime(2026, 2, 20)
    rows = [(rng.choice(["a", "b", "c", None]), start + timedelta(days=rng.choice([0, 1, 2, 9, 40, 41, 77]), hours=rng.uniform(0, 23)), rng.choice([None, Decimal("0.000001"), Decimal("-3.5"), Decimal("12.25")]), "x", "y") for _ in range(200)]
    rows += rows[:20] + [("once", start, None, "x", "y"), ("a", None, Decimal(1), "x", "y")]
    got = {(r.entity, r.day): [r.n_day, r.total_7, r.n_7, r.total_30, r.n_30] for r in trailing_totals(frame(rows, SCHEMA), "agent", "at", "cost", tile_days=tile, block_entities=2).collect()}
    assert got == brute(rows, (7, 30))


def test_means_and_doubles(frame):
    rows = [("a", datetime(2026, 1, 1), 2.0), ("a", datetime(2026, 1, 1), None), ("a", datetime(2026, 1, 3, 23, 59, 59), 4.5)]
    got = trailing_totals(frame(rows, "agent string, at timestamp_ntz, v double"), "agent", "at", "v", windows=(2,)).orderBy("day").collect()
    assert [(r.day, r.total_2, r.n_2, r.mean_2, r.per_day_2) for r in got] == [(date(2026, 1, 1), 2.0, 1, 2.0, 1.0), (date(2026, 1, 2), 2.0, 1, 2.0, 1.0), (date(2026, 1, 3), 4.5, 1, 4.5, 2.25)]


def test_no_value_gives_no_mean(frame):
    got = trailing_totals(frame([("a", datetime(2026, 1, 1), None, "", "")], SCHEMA), "agent", "at", "cost").collect()
    assert got[0].mean_7 is None and got[0].total_7 == 0 and got[0].per_day_30 == 0


def test_empty(frame):
    assert trailing_totals(frame([], SCHEMA), "agent", "at", "cost").count() == 0


def test_columns_of_any_name(frame):
    rows = [(datetime(2026, 1, 1), "a", 2), (datetime(2026, 1, 2), "a", None)]
    got = trailing_totals(frame(rows, "n timestamp_ntz, d string, e long"), "d", "n", "e", windows=(2,)).orderBy("day").collect()
    assert [(r.entity, r.n_day, r.total_2, r.n_2) for r in got] == [("a", 1, 2, 1), ("a", 1, 2, 1)]
