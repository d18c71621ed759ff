from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from runloom.operators.features import event_types, feature_table

SCHEMA = "user string, kind string, at timestamp_ntz, cost decimal(12,6), entity string, n long"
T1, T2 = datetime(2026, 1, 1), datetime(2026, 1, 2, 3, 4, 5, 678000)
ROWS = [
    ("u", "a.b", T1, Decimal("1.5"), "x", 1),
    ("u", "a.b", T2, None, "x", 1),
    ("u", "c", None, Decimal("-0.25"), "x", 1),
    ("u", "c", None, Decimal("-0.25"), "x", 1),
    ("u", None, T1, Decimal("9"), "x", 1),
    ("v", "a_b", T1, None, "x", 1),
    (None, "c", T1, Decimal("1"), "x", 1),
]


def test_counts_recency_and_totals(frame):
    df = frame(ROWS, SCHEMA)
    assert event_types(df, "kind") == ["a.b", "a_b", "c"]
    got = {r.entity: r.asDict() for r in feature_table(df, "user", "kind", "at", "cost").collect()}
    assert set(got) == {"u", "v"}
    u, v = got["u"], got["v"]
    assert (u["a.b_n"], u["a.b_last"], u["a.b_total"]) == (2, T2, Decimal("1.500000"))
    assert (u["c_n"], u["c_last"], u["c_total"]) == (2, None, Decimal("-0.500000"))
    assert (u["other_n"], u["other_total"]) == (1, Decimal("9.000000"))
    assert (v["a.b_n"], v["a.b_last"], v["a.b_total"], v["a_b_n"], v["a_b_total"]) == (0, None, None, 1, None)


def test_types_outside_the_list_are_summed(frame):
    got = {r.entity: r.asDict() for r in feature_table(frame(ROWS, SCHEMA), "user", "kind", "at", "cost", ["c", "unseen"]).collect()}
    assert (got["u"]["c_n"], got["u"]["other_n"], got["u"]["unseen_n"]) == (2, 3, 0)
    assert got["v"]["other_n"] == 1


def test_empty_and_bad_lists(frame):
    assert feature_table(frame([], SCHEMA), "user", "kind", "at", "cost").count() == 0
    for types in (["A", "a"], ["other"]):
        with pytest.raises(ValueError):
            feature_table(frame(ROWS, SCHEMA), "user", "kind", "at", "cost", types)
    with pytest.raises(ValueError):
        event_types(frame(ROWS, SCHEMA), "kind", max_types=2)
