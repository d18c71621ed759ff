from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.plans import lexicon
from runloom.plans.model import Bucket, Filter, Plan, PlanError
from runloom.plans.planner import Answered, Rejected, plan_question
from runloom.plans.time_phrases import parse_window

NOW = datetime(2026, 6, 20, 12)
BASE = {"level": "event", "metric": {"agg": "count"}, "dimensions": ["toolName"], "filters": [], "timeRange": {"from": "2026-06-01T00:00:00Z", "to": "2026-06-20T00:00:00+02:00"}, "chartHint": "bar"}
FAILED = {"field": "status", "op": "eq", "value": "failed"}


def with_(**changes):
    return {**BASE, **changes}


GOOD = [
    BASE,
    with_(metric={"agg": "ratio", "ratio": {"numerator": [FAILED]}}),
    with_(metric={"agg": "quantile", "field": "latencyMs", "p": 0.95}),
    with_(metric={"agg": "count_distinct", "field": "userId"}),
    with_(level="run", metric={"agg": "avg", "field": "durationMs"}, dimensions=["outcome"]),
    with_(level="trace", metric={"agg": "max", "field": "costUsd"}, dimensions=[]),
    with_(metric={"agg": "sum", "field": "totalTokens"}, dimensions=["model", {"time": "week"}], sort={"by": "time", "dir": "asc"}),
    with_(filters=[{"field": "toolName", "op": "in", "value": ["a", "b"]}, {"field": "latencyMs", "op": "gt", "value": 5}], limit=10_000),
    with_(unknown="is dropped"),
    with_(metric={"agg": "count", "field": "latencyMs"}),
]
BAD = [
    None,
    [],
    with_(level="galaxy"),
    with_(metric={"agg": "ratio"}),
    with_(metric={"agg": "ratio", "ratio": {"numerator": []}}),
    with_(metric={"agg": "count", "ratio": {"numerator": [FAILED]}}),
    with_(metric={"agg": "avg"}),
    with_(metric={"agg": "quantile", "field": "latencyMs"}),
    with_(metric={"agg": "quantile", "field": "latencyMs", "p": 1}),
    with_(metric={"agg": "quantile", "field": "runId", "p": 0.5}),
    with_(metric={"agg": "sum", "field": "runId"}),
    with_(metric={"agg": "avg", "field": "latencyMs", "p": 0.5}),
    with_(metric={"agg": "count_distinct", "field": "latencyMs"}),
    with_(metric={"agg": "max", "field": "durationMs"}),
    with_(level="run", metric={"agg": "avg", "field": "latencyMs"}, dimensions=[]),
    with_(level="trace", metric={"agg": "avg", "field": "stepCount"}, dimensions=[]),
    with_(level="run", dimensions=["toolName"]),
    with_(dimensions=["outcome"]),
    with_(dimensions=["toolName", "toolName"]),
    with_(dimensions=[{"time": "century"}]),
    with_(level="trace", dimensions=[], filters=[FAILED]),
    with_(metric={"agg": "sum", "field": "DROP TABLE events; --"}),
    with_(filters=[{"field": "status", "op": "LIKE", "value": "%x%"}]),
    with_(filters=[{"field": "status", "op": "eq", "value": None}]),
    with_(filters=[{"field": "status", "op": "eq", "value": ["a"]}]),
    with_(filters=[{"field": "timestamp", "op": "gt", "value": "yesterday"}]),
    with_(timeRange={"from": "2026-06-01T00:00:00", "to": "2026-06-20T00:00:00Z"}),
    with_(timeRange=None),
    with_(limit=0),
    with_(limit=10_001),
    with_(limit=2.5),
    with_(limit=True),
    with_(sort={"by": "time", "dir": "asc"}),
    with_(sort={"by": "model", "dir": "asc"}),
    with_(sort={"by": "metric", "dir": "up"}),
    with_(chartHint="pie"),
]


@pytest.mark.parametrize("raw", GOOD)
def test_valid_plans(raw):
    assert Plan.parse(raw).end == datetime(2026, 6, 19, 22)


@pytest.mark.parametrize("raw", BAD)
def test_invalid_plans(raw):
    with pytest.raises(PlanError) as error:
        Plan.parse(raw)
    assert error.value.problems


json = st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=5) | st.sampled_from(["event", "count", "latencyMs", "toolName", "eq", "in", "bar"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["level", "metric", "agg", "field", "p", "ratio", "numerator", "dimensions", "time", "filters", "op", "value", "timeRange", "from", "to", "sort", "by", "dir", "limit", "chartHint"]), x, max_size=6))


@settings(max_examples=200, deadline=None)
@given(json, json)
def test_parsing_raises_nothing_else(raw, part):
    for candidate in (raw, with_(metric=part), with_(filters=part), with_(dimensions=part), with_(timeRange=part), with_(sort=part)):
        try:
            Plan.parse(candidate)
        except PlanError:
            pass


def plan(text, **kwargs) -> Plan:
    answer = plan_question(text, NOW, **kwargs)
    assert isinstance(answer, Answered), answer
    return answer.plan


LLM, CALLS = Filter("eventType", "eq", "llm_call"), Filter("eventType", "eq", "tool_call")
#: question -> level, aggregate, field, dimensions, filters, sort, limit, chart
QUESTIONS = {
    "Average LLM latency by model over time": ("event", "avg", "latencyMs", ("model", Bucket("hour")), (LLM,), ("time", "asc"), None, "line"),
    "p95 LLM latency by model": ("event", "quantile", "latencyMs", ("model",), (LLM,), ("metric", "desc"), None, "bar"),
    "median latency by tool": ("event", "quantile", "latencyMs", ("toolName",), (CALLS,), ("metric", "desc"), None, "bar"),
    "which tools fail the most?": ("event", "count", None, ("toolName",), (CALLS, Filter("status", "eq", "failed")), ("metric", "desc"), 10, "bar"),
    "top 3 failing tools": ("event", "count", None, ("toolName",), (CALLS, Filter("status", "eq", "failed")), ("metric", "desc"), 10, "bar"),
    "token usage by agent type": ("event", "sum", "totalTokens", ("agentName",), (), None, None, "bar"),
    "cost per successful run by model": ("run", "avg", "costUsd", ("model",), (Filter("outcome", "eq", "success"),), None, None, "bar"),
    "top 10 slowest traces": ("trace", "max", "durationMs", (), (), ("metric", "desc"), 10, "table"),
    "error rate by tool name": ("event", "ratio", None, ("toolName",), (CALLS,), None, None, "bar"),
    "number of runs per hour": ("event", "count_distinct", "runId", (Bucket("hour"),), (), ("time", "asc"), None, "line"),
    "average steps per run by outcome": ("run", "avg", "stepCount", ("outcome",), (), None, None, "bar"),
    "total cost by user": ("event", "sum", "costUsd", ("userId",), (), None, None, "bar"),
    "average latency by tool": ("event", "avg", "latencyMs", ("toolName",), (CALLS,), None, None, "bar"),
    "number of llm calls by model": ("event", "count", None, ("model",), (LLM,), None, None, "bar"),
    "errors by error type": ("event", "count", None, ("errorType",), (Filter("eventType", "eq", "error"),), None, None, "bar"),
    "average run duration by agent": ("run", "avg", "durationMs", ("agentName",), (), None, None, "bar"),
    "token usage by model over time": ("event", "sum", "totalTokens", ("model", Bucket("hour")), (LLM,), ("time", "asc"), None, "line"),
    "which models cost the most": ("event", "sum", "costUsd", ("model",), (LLM,), ("metric", "desc"), 10, "bar"),
    "bottom 5 tools by cost, the cheapest": ("event", "min", "costUsd", ("toolName",), (CALLS,), ("metric", "asc"), 5, "bar"),
    "how many users": ("event", "count_distinct", "userId", ("userId",), (), None, None, "bar"),
    "llm latency per minute by model": ("event", "min", "latencyMs", ("model", Bucket("minute")), (LLM,), ("time", "asc"), None, "line"),
    "failed runs: total cost per run": ("run", "sum", "costUsd", (), (Filter("outcome", "eq", "failed"),), None, None, "table"),
}


@pytest.mark.parametrize("text", QUESTIONS)
def test_questions(text):
    p = plan(text)
    sort = (p.sort.by, p.sort.direction) if p.sort else None
    assert (p.level, p.metric.agg, p.metric.field, p.dimensions, p.filters, sort, p.limit, p.chart) == QUESTIONS[text]
    assert (p.start, p.end) == (datetime(2026, 6, 13, 12), NOW)


@pytest.mark.parametrize("grain", ["second", "minute", "day", "week", "month", "hour"])
def test_grains(grain):
    assert Bucket(grain) in plan(f"average LLM latency by model per {grain}").dimensions


class Model:
    def __init__(self, answer, available=True):
        self.answer, self.there = answer, available

    def available(self):
        return self.there

    def plan(self, question, window):
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer


NOVEL = {"level": "event", "metric": {"agg": "avg", "field": "latencyMs"}, "dimensions": ["model"], "filters": [], "chartHint": "bar"}


def test_the_model_fills_in():
    answer = plan_question("show me the performance", NOW, model=Model(NOVEL))
    assert isinstance(answer, Answered) and answer.origin == "llm" and answer.plan.end == NOW
    kept = plan_question("show me the performance", NOW, model=Model({**NOVEL, "timeRange": BASE["timeRange"]}))
    assert kept.plan.start == datetime(2026, 6, 1)
    assert plan_question("which tools fail the most", NOW, model=Model(RuntimeError())).origin == "deterministic"


@pytest.mark.parametrize("model", [None, Model(None, False), Model(RuntimeError("down")), Model({"nonsense": True}), Model("text"), Model({**NOVEL, "metric": {"agg": "max", "field": "durationMs"}})])
def test_rejections(model):
    answer = plan_question("what's the weather?", NOW, model=model)
    assert isinstance(answer, Rejected) and answer.reason and len(answer.supported) == 8


@pytest.mark.parametrize("text", ["cost by outcome", "average run duration by tool", ""])
def test_questions_without_an_answer(text):
    assert isinstance(plan_question(text, NOW), Rejected)


def day(*args):
    return datetime(2026, *args)


WINDOWS = {
    "which tools fail the most on 18th June": (day(6, 18), day(6, 19)),
    "errors on June 18": (day(6, 18), day(6, 19)),
    "errors on 2026-06-18": (day(6, 18), day(6, 19)),
    "avg latency over the last 24 hours": (day(6, 19, 12), NOW),
    "last 2 months": (day(4, 21, 12), NOW),
    "in the past hour": (day(6, 20, 11), NOW),
    "today": (day(6, 20), NOW),
    "how many runs yesterday": (day(6, 19), day(6, 20)),
    "this week": (day(6, 15), NOW),
    "last week": (day(6, 8), day(6, 15)),
    "this month": (day(6, 1), NOW),
    "last month": (day(5, 1), day(6, 1)),
    "cost between June 1 and June 10": (day(6, 1), day(6, 11)),
    "from 1/6/2026 to 3/6/2026": (day(6, 1), day(6, 4)),
    "errors since June 15": (day(6, 15), NOW),
    "errors on 06/20/2026": (day(6, 20), day(6, 21)),
    "errors on 15/06/2026": (day(6, 15), day(6, 16)),
    "errors on 25 december": (datetime(2025, 12, 25), datetime(2025, 12, 26)),
    "cost 18th of june": (day(6, 18), day(6, 19)),
    "errors on 31 june": (datetime(2025, 7, 1), datetime(2025, 7, 2)),
    "top 10 tools june 18": None,
    "on friday 2026": None,
    "which tools fail the most": None,
    "number of runs per hour": None,
}


@pytest.mark.parametrize("text", WINDOWS)
def test_windows(text):
    assert parse_window(text, NOW) == WINDOWS[text]


WORDS = [w for table in (lexicon.MEASURES, lexicon.AGGREGATES, lexicon.CATEGORIES, lexicon.GRAINS, lexicon.RANKINGS) for phrases, _ in table for w in phrases]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*WORDS, "top 5", "p99", "failed", "run", "trace", "last 9999999 months", "on 99/99/9999", "2026-13-45"]) | st.text(max_size=8), max_size=8))
def test_any_question_is_answered_or_rejected(words):
    assert isinstance(plan_question(" ".join(words), NOW), (Answered, Rejected))
