from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.llm import mixing
from runloom.llm.mixing import apportion, at_cap, mix, share_out

SCHEMA = "id long, src string, tokens long, source string, item string, shard long, uses long"


def test_apportionment():
    assert apportion([53, 24, 23], 7) == [3, 2, 2]
    assert apportion([0.5, 0.5], 3) == [2, 1]
    assert apportion([1, 1], 10, [2, 100]) == [2, 8]
    assert apportion([1, 1], 10, [2, 3]) == [2, 3]
    assert apportion([0, 0], 5) == [0, 0] and apportion([], 5) == [] and apportion([1], 0) == [0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=6), st.integers(0, 200))
def test_every_quotient_given_beats_every_one_refused(weights, seats):
    given_ = apportion(weights, seats)
    assert sum(given_) == seats
    last = min((w / (2 * a - 1) for w, a in zip(weights, given_) if a), default=1e9)
    assert all(w / (2 * a + 1) <= last + 1e-12 for w, a in zip(weights, given_))


def rows():
    rng = random.Random(4)
    names = {"big": ["big", " BIG ", "Big"], "mid": ["mid"], "few": ["few\t"], "void": [None]}
    out = []
    for name, n in (("big", 3000), ("mid", 900), ("few", 40), ("void", 60)):
        out += [(len(out) + i, rng.choice(names[name]), rng.randrange(1, 400), "x", "y", 1, 2) for i in range(n)]
    return out + [(10**6, "mid", None, "x", "y", 1, 2), (10**6 + 1, "mid", 0, "x", "y", 1, 2), (10**6 + 2, "", 50, "x", "y", 1, 2)]


TARGETS = [("m", "big", 0.5, 1), ("m", "mid", 0.4, 3), ("m", "few", 0.1, 2), ("n", "big", 0.2, 4), ("n", "absent", 0.8, 9)]


@pytest.mark.parametrize("shard_rows", [200, 10**6])
def test_shares_and_uses(frame, shard_rows):
    data = rows()
    uses, shares = mix(frame(data, SCHEMA), "id", "src", "tokens", TARGETS, shard_rows=shard_rows)
    total = sum(r[2] or 0 for r in data)
    tokens = {r[0]: r[2] for r in data}
    got = {(r.mix_id, r.source): r for r in shares.collect()}
    assert set(got) == {t[:2] for t in TARGETS}
    by = {}
    for r in uses.collect():
        assert r.uses >= 1 and tokens[r.id] == r.tokens > 0
        by.setdefault((r.mix_id, r.source), []).append(r)
    for m, s, share, repeats in TARGETS:
        r, used = got[m, s], by.get((m, s), [])
        assert len({u.id for u in used}) == len(used) and all(u.uses <= repeats for u in used)
        assert r.tokens_used == sum(u.tokens * u.uses for u in used)
        assert r.is_short == (r.tokens_available * repeats < share * total)
        if r.is_short:
            assert r.tokens_used == r.tokens_available * repeats
        else:
            assert abs(r.tokens_used - share * total) < 0.01 * total
    assert got["m", "few"].is_short and not got["m", "big"].is_short and got["n", "absent"].is_short
    again, _ = mix(frame(data, SCHEMA), "id", "src", "tokens", TARGETS, shard_rows=shard_rows)
    assert {tuple(r) for r in again.collect()} == {tuple(u) for v in by.values() for u in v}


def test_empty(frame):
    uses, shares = mix(frame([], SCHEMA), "id", "src", "tokens", TARGETS)
    assert uses.count() == 0 and [r.is_short for r in shares.collect()] == [False] * len(TARGETS)
    assert mix(frame(rows(), SCHEMA), "id", "src", "tokens", TARGETS[:1])[1].count() == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0.0001, 1), min_size=1, max_size=30), st.integers(1, 3000))
def test_every_short_source_runs_into_its_cap(weights, blocks):
    shares = [w / sum(weights) for w in weights]
    caps = [int(s * blocks * (1 - 1e-6)) for s in shares]  # just short
    assert all(at_cap(apportion(shares, blocks), caps))
    assert at_cap([4000, 6000], [4100, 5900]) == [False, True]


def test_the_apportionment_finds_the_short_sources(frame, monkeypatch):
    data = frame([(i, "a" if i < 10 else "b", 100, "", "", 0, 0) for i in range(100)], SCHEMA)
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)]
    short = lambda: {r.source: r.is_short for r in mix(data, "id", "src", "tokens", targets)[1].collect()}
    assert short() == {"a": True, "b": False}
    monkeypatch.setattr(mixing, "at_cap", lambda turns, caps: [False for _ in caps])
    assert short() == {"a": False, "b": False}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=12), st.integers(0, 10**7), st.booleans())
def test_many_seats_at_once_are_those_given_one_by_one(weights, seats, capped):
    caps = [w * seats // (2 * sum(weights)) + 1 for w in weights] if capped else None
    given_ = apportion(weights, seats, caps)
    assert sum(given_) == (min(seats, sum(caps)) if capped else seats)
    open_ = [i for i in range(len(weights)) if not capped or given_[i] < caps[i]]
    last = min((weights[i] / (2 * given_[i] - 1) for i in range(len(weights)) if given_[i]), default=1e9)
    assert all(weights[i] / (2 * given_[i] + 1) <= last * (1 + 1e-12) for i in open_)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**5), min_size=1, max_size=40), st.integers(1, 4), st.floats(0, 1.2))
def test_shards_hold_a_quota_to_the_token(held, repeats, share):
    quota = int(sum(held) * repeats * share)
    parts = share_out(quota, held, repeats)
    assert sum(parts) == min(quota, sum(held) * repeats)
    assert all(0 <= p <= h * repeats for p, h in zip(parts, held))


@pytest.mark.parametrize("blocks,shard_rows,share,repeats", [(10, 5, 0.3, 1), (10, 5, 0.3, 2), (10_000, 5, 0.3, 1), (10, 10**6, 0.3, 1)])
def test_a_target_that_is_not_short_is_met_within_a_block(frame, blocks, shard_rows, share, repeats):
    """Also with shards that hold less than a block, and with just a little more supply than is wanted."""
    rng = random.Random(6)
    data = [(i, "a" if i < 1240 // repeats else "b", rng.randrange(50, 60), "", "", 0, 0) for i in range(4000)]
    _, shares = mix(frame(data, SCHEMA), "id", "src", "tokens", [("m", "a", share, repeats), ("m", "b", 1 - share, 2)], blocks, shard_rows)
    for r in shares.collect():
        assert not r.is_short and r.tokens_off == r.tokens_used - r.tokens_target
        # and for each shard less than a document, either way and without a bias: three standard errors of half a document each
        shards = -(-sum(d[1] == r.source for d in data) // shard_rows)
        assert abs(r.tokens_off) <= r.block_tokens + 3 * 30 * shards**0.5
