from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import digests

PS = [0.0001, 0.25, 0.5, 0.95, 0.999]
SCHEMA = "g string, d int, v double, mean double, weight long"


def data(n=9000):
    rng = np.random.default_rng(2)
    values = np.round(np.exp(rng.normal(5, 1.5, n)), 2)
    groups = rng.choice(["hot", "cold", "tied"], n, p=[0.8, 0.15, 0.05])
    values[groups == "tied"] = np.round(values[groups == "tied"] / 400) * 400
    return [(str(g), int(d), float(v), 1.0, 2) for g, d, v in zip(groups, rng.integers(0, 5, n), values)] + [("one", 0, 3.5, 0.0, 0), ("two", 0, 1.0, 0.0, 0), ("two", 1, 2.0, 0.0, 0), ("none", 0, None, 0.0, 0), ("none", 0, float("nan"), 0.0, 0), (None, 0, 7.0, 0.0, 0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(data(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def truth():
    values = {}
    for g, _, v, *_ in data():
        if v is not None and v == v:
            values.setdefault(g, []).append(v)
    return {g: np.array(v) for g, v in values.items()}


@pytest.fixture(scope="module")
def daily(df):
    return digests.merge_digests(digests.partial_digests(df, ["g", "d"], "v", 60), ["g", "d"], 60).cache()


def test_sizes_are_bounded_and_weights_kept(daily, truth):
    whole = digests.merge_digests(daily, ["g"], 60)
    rows = {r.g: r for r in whole.groupBy("g").agg(F.count("*").alias("c"), F.sum("weight").alias("w"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    assert set(rows) == set(truth)
    for g, values in truth.items():
        assert rows[g].c <= 62 and (rows[g].w, rows[g].low, rows[g].high) == (len(values), values.min(), values.max())


def test_estimates_and_their_certified_error(df, daily, truth):
    found = digests.quantiles(digests.merge_digests(daily, ["g"], 60), ["g"], PS)
    for r in digests.certified(df, ["g"], "v", found).collect():
        values = np.sort(truth[r.g])
        under, upto, wanted = (values < r.estimate).sum(), (values <= r.estimate).sum(), r.p * (len(values) - 1)
        assert r.rank_error == pytest.approx(max(0, under - wanted, wanted - max(upto - 1, 0)) / len(values))
        assert r.rank_error <= 0.06 or len(values) < 50


def test_exact_values(df, daily, truth):
    found = digests.quantiles(digests.merge_digests(daily, ["g"], 60), ["g"], PS)
    rows = digests.exact(df, ["g"], "v", found).collect()
    assert len(rows) == len(truth) * len(PS)
    for r in rows:
        assert r.value == pytest.approx(np.quantile(truth[r.g], r.p), rel=1e-12) and r.n == len(truth[r.g])


def test_no_keys_and_empty(df, frame, truth):
    found = digests.quantiles(digests.merge_digests(digests.partial_digests(df.withColumn("all", F.lit(1)), ["all"], "v"), ["all"]), ["all"], [0.5])
    assert digests.exact(df.withColumn("all", F.lit(1)), ["all"], "v", found).first().value == pytest.approx(np.median(np.concatenate(list(truth.values()))))
    empty = frame([], SCHEMA)
    assert digests.merge_digests(digests.partial_digests(empty, ["g"], "v"), ["g"]).count() == 0
    assert digests.exact(empty, ["g"], "v", digests.quantiles(digests.partial_digests(empty, ["g"], "v"), ["g"], PS)).count() == 0


def test_blocks_are_carried_over(df, truth, monkeypatch):
    monkeypatch.setattr(digests, "BLOCK", 7)
    # the functions are sent by name, so workers see the module's own size; check the clustering itself
    frame = digests.pd.DataFrame({"g": ["a"] * 50, "mean": np.arange(50.0), "weight": 1, "low": np.arange(50.0), "high": np.arange(50.0)})
    out = digests._clustered(frame, ["g"], 20)
    assert out["weight"].sum() == 50 and len(out) < 50 and (out["low"].to_numpy()[1:] > out["high"].to_numpy()[:-1]).all()


def test_keys_that_clash(df):
    with pytest.raises(ValueError):
        digests.partial_digests(df, ["mean"], "v")
