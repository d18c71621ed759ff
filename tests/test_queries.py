"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from compare import canonical, connect
from runloom import queries as core

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")
NAMES = ["p2_found", "p2_rolling_cost", "p3_user_features", "p5_found", "p5_messages", "p7_found", "p7_sessions", "evt_error_rate_tool", "multi_key", "topk_failing_tools", "filter_in_empty", "runs_rollup", "traces_rollup", "list_traces_one_run", "trace_detail_events", "nl_runs_per_hour", "validate_partial_reject"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, name):
    got = core.QUERIES[name](spark, FOLDER).toPandas()
    want = connect(FOLDER).execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_registry(spark):
    assert set(core.SQL) <= set(core.QUERIES) and set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
