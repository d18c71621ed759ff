from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runloom.llm import bitmaps

SCHEMA = "day string, a string, b string, u string, r string, kind string, word long, bits long"


def rows(n=6000, users=3000):
    rng = random.Random(1)
    return [(rng.choice(["d1", "d2"]), rng.choice(["x", "x", "x", "y", None]), rng.choice(["p", "q"]), f"u{rng.randrange(users)}" if rng.random() > 0.05 else None, f"r{rng.randrange(200)}", "", 0, 0) for _ in range(n)]


def exact(data, keep):
    sets = {}
    for row in data:
        key = keep(row)
        if key is not None:
            users, runs = sets.setdefault(key, (set(), set()))
            if row[3] is not None:
                users.add(row[3])
            runs.add(row[4])
    return {k: (len(u), len(r)) for k, (u, r) in sets.items()}


BITS = bitmaps.bits_for(5000, 0.02)


def close(got, want):
    return all(abs(g - w) <= max(1, 0.02 * 4 * w) for g, w in zip(got, want))


def test_sizing():
    assert bitmaps.bits_for(1, 0.5) == 64
    for n in (10, 1000, 100_000, 4_000_000):
        bits = bitmaps.bits_for(n, 0.01)
        assert bitmaps.relative_error(n, bits) <= 0.01 and all(bitmaps.relative_error(m, bits) <= 0.01 for m in (1 + n // 100, 1 + n // 2))
    with pytest.raises(ValueError):
        bitmaps.bits_for(10**13, 0.01)


def test_estimates_within_the_bound(frame):
    data = rows()
    words = bitmaps.sketch(frame(data, SCHEMA), ["day", "a"], ["u", "r"], BITS)
    got = {(r.day, r.a): (r.users, r.runs) for r in bitmaps.estimate(words, ["day", "a"], ["users", "runs"], BITS).collect()}
    want = exact(data, lambda x: (x[0], x[1]))
    assert set(got) == set(want) and all(close(got[k], want[k]) for k in want)


def test_merging_equals_sketching_at_once(frame):
    df = frame(rows(), SCHEMA)
    fine = bitmaps.sketch(df, ["day", "a"], ["u", "r"], BITS)
    merged = bitmaps.merge(fine, ["a"])
    whole = bitmaps.sketch(df, ["a"], ["u", "r"], BITS)
    assert merged.exceptAll(whole).count() == 0 and whole.exceptAll(merged).count() == 0


def test_cube(frame):
    data = rows()
    words = bitmaps.cube(bitmaps.sketch(frame(data, SCHEMA), ["day", "a", "b"], ["u", "r"], BITS), ["day"], ["a", "b"])
    got = {(r.day, r.a, r.b, r.level): (r.users, r.runs) for r in bitmaps.estimate(words, ["day", "a", "b", "level"], ["users", "runs"], BITS).collect()}
    want = {}
    for level, keep in enumerate([lambda x: (x[0], x[1], x[2], 0), lambda x: (x[0], x[1], None, 1), lambda x: (x[0], None, x[2], 2), lambda x: (x[0], None, None, 3)]):
        want |= exact(data, keep)
    assert set(got) == set(want) and all(close(got[k], want[k]) for k in want)


def test_nulls_empty_and_full(frame):
    data = [("d", "x", "p", None, "r", "", 0, 0)] * 3
    one = bitmaps.estimate(bitmaps.sketch(frame(data, SCHEMA), ["day"], ["u", "r"], 64), ["day"], ["users", "runs"], 64).first()
    assert (one.users, one.users_error, one.runs) == (0, 0.0, 1)
    assert bitmaps.sketch(frame([], SCHEMA), ["day"], ["u", "r"], 64).count() == 0
    full = bitmaps.estimate(bitmaps.sketch(frame(rows(), SCHEMA), [], ["u"], 64).withColumn("g", F.lit(1)), ["g"], ["users"], 64).first()
    assert full.users is None and full.users_error is None


def test_keys_that_clash(frame):
    with pytest.raises(ValueError):
        bitmaps.sketch(frame(rows(10), SCHEMA), ["Kind"], ["u"], 64)


def test_a_group_of_nulls_has_a_row(frame):
    rows = frame([("d", "a", None), ("d", "a", None), ("d", "b", "x"), ("d", "b", None)], "day string, g string, u string")
    words = bitmaps.sketch(rows, ["day", "g"], ["u"], 64)
    got = {(r.g, r.level): (r.users, r.users_error) for r in bitmaps.estimate(bitmaps.cube(words, ["day"], ["g"]), ["day", "g", "level"], ["users"], 64).collect()}
    assert set(got) == {("a", 0), ("b", 0), (None, 1)}
    assert got["a", 0] == (0, 0.0) and got["b", 0][0] == got[None, 1][0] == 1


def test_bits_fit_the_table(spark):
    ids = spark.range(50_000).selectExpr("id as a", "id % 10 as b")
    assert bitmaps.bits_of(ids, ["a", "b"], 50_000, 0.01) == bitmaps.bits_for(50_000, 0.01)
    bits = bitmaps.bits_of(ids, ["a", "b"], 100, 0.01)
    assert bitmaps.relative_error(50_000, bits) <= 0.01 and bits <= 4 * bitmaps.bits_for(50_000, 0.01)
    got = bitmaps.estimate(bitmaps.sketch(ids.selectExpr("a", "b", "0 as k"), ["k"], ["a", "b"], bits), ["k"], ["na", "nb"], bits).first()
    assert abs(got.na - 50_000) <= 50_000 * got.na_error and abs(got.nb - 10) <= 1
