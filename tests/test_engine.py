"""A store of ten events with known answers."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from runloom.operators import explorer, rollups
from runloom.plans.compiler import compile_plan, to_rows
from runloom.plans.model import Plan
from runloom.schema import EVENTS
from runloom.sources.events import EventSource

WINDOW = {"from": "2026-05-07T00:00:00Z", "to": "2026-05-08T00:00:00Z"}
PROJECT = "dev_project"


def event(event_id, trace, run, agent, user, step, kind, clock, model=None, tool=None, status=None, latency=None, tokens=(None, None), cost=None, error=None):
    at = datetime.fromisoformat(f"2026-05-07T{clock}")
    return (event_id, trace, run, PROJECT, kind, at, agent, user, step, model, tool, status, error, latency, *tokens, None if cost is None else Decimal(cost), "{}")


R, C = ("trace_1", "run_1", "research-agent", "user_42"), ("trace_2", "run_2", "coder-agent", "user_7")
ROWS = [
    event("e1", *R, 0, "run_started", "09:00:00", status="running"),
    event("e2", *R, 1, "llm_call", "09:00:02", "gpt-5.2", status="success", latency=800.0, tokens=(1200, 300), cost="0.014"),
    event("e3", *R, 2, "tool_call", "09:00:04", tool="web_search", status="success", latency=1200.0),
    event("e4", *R, 3, "error", "09:00:07", tool="web_fetch", status="failed", latency=600.0, error="rate_limit"),
    event("e5", *R, 4, "retry", "09:00:08", tool="web_fetch", status="success", latency=900.0),
    event("e6", *R, 5, "run_completed", "09:00:12", status="success"),
    event("f1", *C, 0, "run_started", "10:00:00", status="running"),
    event("f2", *C, 1, "llm_call", "10:00:03", "claude-4.5", status="success", latency=1500.0, tokens=(2000, 500), cost="0.05"),
    event("f3", *C, 2, "tool_call", "10:00:05", tool="code_exec", status="failed", latency=400.0),
    event("f4", *C, 3, "run_completed", "10:00:09", status="failed"),
]


@pytest.fixture(scope="module")
def source(spark):
    """The ten events, each delivered three times."""
    once = spark.createDataFrame(ROWS, EVENTS)
    copies = [once.withColumns({"delivery_seq": F.monotonically_increasing_id() + i * 10**12}) for i in range(3)]
    return EventSource(copies[0].unionByName(copies[1]).unionByName(copies[2]))


def run(source, metric, dims=(), where=(), level="event", project=PROJECT, **rest):
    raw = {"level": level, "metric": metric, "dimensions": list(dims), "filters": [dict(zip(("field", "op", "value"), f)) for f in where], "timeRange": WINDOW, "chartHint": "table", **rest}
    rows = compile_plan(source, Plan.parse(raw), project).frame.collect()
    return {tuple(r)[:-1]: r["value"] for r in rows}


LATENCY = {"agg": "avg", "field": "latencyMs"}


def test_known_answers(source):
    failed = [{"field": "status", "op": "eq", "value": "failed"}]
    assert run(source, {"agg": "count"}) == {(): 10}
    assert run(source, {"agg": "count"}, ["toolName"], [("eventType", "eq", "tool_call")]) == {("web_search",): 1, ("code_exec",): 1}
    assert run(source, LATENCY, ["model"], [("eventType", "eq", "llm_call")]) == {("gpt-5.2",): 800.0, ("claude-4.5",): 1500.0}
    assert run(source, {"agg": "quantile", "field": "latencyMs", "p": 0.95})[()] == pytest.approx(1425.0)
    assert run(source, {"agg": "avg", "field": "costUsd"}, ["model"], level="run") == {("gpt-5.2",): pytest.approx(0.014), ("claude-4.5",): pytest.approx(0.05)}
    assert run(source, {"agg": "ratio", "ratio": {"numerator": failed}}, ["toolName"], [("eventType", "eq", "tool_call")]) == {("web_search",): 0.0, ("code_exec",): 1.0}
    assert run(source, {"agg": "count_distinct", "field": "runId"}, [{"time": "day"}]) == {(datetime(2026, 5, 7),): 2}


def test_nulls_empty_groups_and_tenants(source):
    assert run(source, {"agg": "count"}, ["model"]) == {(None,): 8, ("gpt-5.2",): 1, ("claude-4.5",): 1}
    assert run(source, {"agg": "count"}, where=[("model", "neq", "gpt-5.2")]) == {(): 1}
    assert run(source, LATENCY, where=[("model", "in", [])]) == {(): None}
    assert run(source, LATENCY, ["model"], [("model", "in", [])]) == {}
    assert run(source, {"agg": "count"}, project="another") == {(): 0}
    assert run(source, {"agg": "ratio", "ratio": {"numerator": [{"field": "status", "op": "eq", "value": "failed"}], "denominator": [{"field": "model", "op": "eq", "value": "none"}]}}) == {(): None}


def test_order_limit_and_rows(source):
    raw = {"level": "event", "metric": {"agg": "count"}, "dimensions": ["agentName", {"time": "hour"}], "filters": [], "timeRange": WINDOW, "sort": {"by": "metric", "dir": "desc"}, "chartHint": "line"}
    compiled = compile_plan(source, Plan.parse(raw), PROJECT, default_limit=1)
    assert to_rows(compiled) == [{"agentName": "research-agent", "bucket": "2026-05-07T09:00:00.000Z", "value": 6}]
    assert [(c.name, c.role) for c in compiled.columns] == [("agentName", "dimension"), ("bucket", "time"), ("value", "measure")]


def test_pushed_filters_and_pruned_columns(spark, source, tmp_path):
    source.rows.write.parquet(str(tmp_path / "e"))
    stored = EventSource(spark.read.parquet(str(tmp_path / "e")))
    raw = {"level": "event", "metric": LATENCY, "dimensions": ["model"], "filters": [{"field": "eventType", "op": "eq", "value": "llm_call"}], "timeRange": WINDOW, "chartHint": "bar"}
    plan = compile_plan(stored, Plan.parse(raw), PROJECT).frame._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") : plan.index("ReadSchema")]
    assert all(x in pushed for x in ("event_type", "project_id", "timestamp")) and "metadata" not in plan[plan.index("ReadSchema") :]


def test_traces_and_detail(source):
    rows = {r.trace_id: r for r in explorer.list_traces(source, PROJECT).collect()}
    one = rows["trace_1"]
    assert (one.outcome, one.run_count, one.duration_ms, one.cost_usd) == ("success", 1, 12_000, Decimal("0.014"))
    assert rows["trace_2"].outcome == "failed"
    assert [r.trace_id for r in explorer.list_traces(source, PROJECT, explorer.TraceFilter(agent="coder-agent")).collect()] == ["trace_2"]
    assert [r.trace_id for r in explorer.list_traces(source, PROJECT, explorer.TraceFilter(tool="web_fetch", model="gpt-5.2")).collect()] == ["trace_1"]
    assert explorer.list_traces(source, PROJECT, explorer.TraceFilter(tool="web_fetch", model="claude-4.5")).count() == 0
    assert [r.trace_id for r in explorer.list_traces(source, PROJECT, limit=1, offset=1).collect()] == ["trace_1"]
    detail = explorer.trace_detail(source, PROJECT, "trace_1")
    run_row = detail.runs.first()
    assert (run_row.primary_model, run_row.step_count, run_row.error_count, run_row.retry_count, run_row.compute_ms) == ("gpt-5.2", 6, 1, 1, 3500.0)
    assert [r.event_id for r in detail.events.collect()] == [f"e{i}" for i in range(1, 7)]
    with pytest.raises(ValueError, match="more than 2 events"):
        explorer.nested_detail(detail, 2)
    nested = explorer.nested_detail(detail).first()
    assert len(nested.runs) == 1 and [e.event_id for e in nested.events] == [f"e{i}" for i in range(1, 7)]
    assert explorer.trace_detail(source, PROJECT, "none").trace.count() == 0


def test_rollup_edge_cases(spark):
    """Two terminal events, none, and a last step without a model."""
    at = "09:00:00"
    rows = [
        event("1", "t", "both", "a", "u", 0, "run_completed", at, status="failed"),
        event("2", "t", "both", "a", "u", 1, "run_completed", at, status="success"),
        event("3", "t", "odd", "a", "u", 0, "run_completed", at, status="strange"),
        event("4", "t", "none", "a", "u", 0, "llm_call", at, model="first"),
        event("5", "t", "none", "a", "u", 7, "tool_call", "09:00:01"),
    ]
    got = {r.run_id: r for r in rollups.runs(spark.createDataFrame(rows, EVENTS)).collect()}
    assert (got["both"].outcome, got["odd"].outcome, got["none"].outcome) == ("success", "running", "running")
    assert (got["none"].primary_model, got["none"].step_count, got["none"].duration_ms, got["none"].compute_ms) == ("first", 8, 1000, 0.0)
    assert rollups.traces(rollups.runs(spark.createDataFrame([], EVENTS))).count() == 0


def test_series(source):
    raw = {"level": "event", "metric": {"agg": "count"}, "dimensions": ["agentName", {"time": "hour"}], "filters": [], "timeRange": WINDOW, "chartHint": "line"}
    rows = explorer.series(compile_plan(source, Plan.parse(raw)).frame, "agentName").collect()
    assert [(r["research-agent"], r["coder-agent"]) for r in rows] == [(6, None), (None, 4)]


def test_views(spark, source):
    from runloom.operators.views import create_views

    create_views(source, "t_")
    assert tuple(spark.sql("SELECT count(*), (SELECT count(*) FROM t_runs), (SELECT max(duration_ms) FROM t_traces) FROM t_events").first()) == (10, 2, 12_000)
