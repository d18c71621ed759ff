"""Stored rollups, and events from a JSON file."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from runloom.operators import rollups
from runloom.plans.compiler import compile_plan
from runloom.plans.model import Plan
from runloom.sources.fixtures import json_events
from runloom.sources.synthetic import synthetic_events
from runloom.streaming.store import EventStore, RollupStore


def test_rollups_are_kept_current(spark, tmp_path):
    events = synthetic_events(spark, 60, seed=3).withColumn("position", F.monotonically_increasing_id())
    store, kept = EventStore(spark, str(tmp_path)), RollupStore(spark, str(tmp_path), 4)
    assert kept.read().count() == 0
    # the second batch brings further events of runs that are already there, and new runs
    store.append(events.where("step_index < 3 and crc32(run_id) % 3 > 0"), "b1", "position")
    kept.refresh(store)
    store.append(events, "b2", "position")
    kept.refresh(store, "b2")
    want = rollups.runs(store.read())
    columns = [c for c in want.columns if c != "compute_ms"]
    assert kept.read().count() == want.count() and kept.read().select(columns).exceptAll(want.select(columns)).count() == 0
    raw = {"level": "trace", "metric": {"agg": "sum", "field": "costUsd"}, "dimensions": ["outcome"], "filters": [], "timeRange": {"from": "2026-06-01T00:00:00Z", "to": "2026-07-01T00:00:00Z"}, "chartHint": "bar"}
    answers = [{tuple(r) for r in compile_plan(s, Plan.parse(raw)).frame.collect()} for s in (store.source(), store.source(kept))]
    assert answers[0] == answers[1] and answers[0]


def test_json_events(spark, tmp_path):
    rows = [
        {"eventId": "e1", "traceId": "t", "runId": "r", "timestamp": "2026-05-07T09:12:30.123Z", "agentName": "a", "userId": "u", "eventType": "trace_started", "stepIndex": 0, "model": None, "latencyMs": None, "metadata": {"tags": ["x", "y"]}},
        {"eventId": "e2", "eventType": "llm_call", "timestamp": "2026-05-07T11:12:30+02:00", "costUsd": 0.0125, "inputTokens": 7, "latencyMs": 1.5, "metadata": None},
    ]
    (tmp_path / "events.json").write_text(json.dumps(rows, indent=2))
    first, second = json_events(spark, str(tmp_path / "events.json"), "p").orderBy("event_id").collect()
    assert str(first.timestamp) == "2026-05-07 09:12:30.123000" and json.loads(first.metadata) == {"tags": ["x", "y"]} and first.step_index == 0 and first.project_id == "p"
    assert str(second.timestamp) == "2026-05-07 09:12:30" and str(second.cost_usd) == "0.012500" and (second.input_tokens, second.latency_ms, second.metadata, second.run_id) == (7, 1.5, "{}", None)
