"""Queries of the trace engine over the whole of agent_events: plans, rollups, explorer, ingestion.

Each plan is written in its wire form and runs through the same validation and compiler as a question.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.ids import uuid_key
from runloom.operators import explorer, rollups
from runloom.plans.compiler import compile_plan
from runloom.plans.model import Plan
from runloom.plans.planner import Answered, plan_question
from runloom.queries.messages import KEY, once_sql
from runloom.session import remove_path, scratch_path
from runloom.sources.events import EventSource
from runloom.sources.tables import table
from runloom.streaming import payloads, wire
from runloom.streaming.store import EventStore

#: The window of the tables, and the moment at which questions are asked.
WINDOW = {"from": "2026-03-01T00:00:00Z", "to": "2026-05-01T00:00:00Z"}
NOW, SPAN = datetime(2026, 5, 1), (datetime(2026, 3, 1), datetime(2026, 5, 1))
MODEL, TOOL, PROJECT = "aster-large", "kb_search", "proj_atlas"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_SOURCE = f"WITH e AS ({once_sql('agent_events')}) "
_RUNS = (
    _SOURCE
    + """, r AS (SELECT run_id, min(trace_id) AS trace_id, project_id, min(agent_name) AS agent_name, min(user_id) AS user_id,
  (max({'s': step_index, 't': timestamp, 'm': model}) FILTER (model IS NOT NULL)).m AS primary_model,
  coalesce(max(CASE WHEN event_type = 'run_completed' THEN CASE WHEN status IN ('success', 'failed') THEN status ELSE 'running' END END), 'running') AS outcome,
  min(timestamp) AS started_at, max(timestamp) AS ended_at, epoch_ms(max(timestamp)) - epoch_ms(min(timestamp)) AS duration_ms,
  coalesce(sum(latency_ms), 0) AS compute_ms, max(step_index) + 1 AS step_count, CAST(coalesce(sum(cost_usd), 0) AS DECIMAL(18,6)) AS cost_usd,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,
  CAST(coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0) AS BIGINT) AS total_tokens,
  count(*) FILTER (event_type = 'error') AS error_count, count(*) FILTER (event_type = 'retry') AS retry_count
  FROM e GROUP BY project_id, run_id),
t AS (SELECT trace_id, project_id, min(agent_name) AS agent_name, (max({'s': started_at, 'r': run_id, 'o': outcome})).o AS outcome, count(DISTINCT run_id) AS run_count,
  min(started_at) AS started_at, max(ended_at) AS ended_at, epoch_ms(max(ended_at)) - epoch_ms(min(started_at)) AS duration_ms,
  CAST(coalesce(sum(cost_usd), 0) AS DECIMAL(18,6)) AS cost_usd FROM r GROUP BY project_id, trace_id) """
)


def _source(spark: SparkSession, folder: str) -> EventSource:
    return EventSource(table(spark, folder, "agent_events", spread=True))


def _rounded(frame: DataFrame) -> DataFrame:
    """Sums of doubles depend on the order of the rows in their last digits."""
    return frame.withColumn("value", F.round("value", 6)) if dict(frame.dtypes)["value"] == "double" else frame


def plan(name: str, level: str, metric: dict[str, Any], sql: str, dims: list | None = None, where: list | None = None, window: dict | None = None, project: str | None = None, default_limit: int | None = None, **rest: Any) -> None:
    """Register a plan's query and its SQL, which reads ``e``, ``r`` or ``t``."""
    raw = {"level": level, "metric": metric, "dimensions": dims or [], "filters": [dict(zip(("field", "op", "value"), f)) for f in where or []], "timeRange": window or WINDOW, "chartHint": "table", **rest}

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _rounded(compile_plan(_source(spark, folder), Plan.parse(raw), project, default_limit).frame)

    query.__name__ = name
    QUERIES[name], SQL[name] = query, (_SOURCE if level == "event" else _RUNS) + sql


COUNT = {"agg": "count"}
LATENCY = {"agg": "avg", "field": "latencyMs"}
FAILURES = [{"field": "status", "op": "eq", "value": "failed"}]
CALLS, LLM = [("eventType", "eq", "tool_call")], [("eventType", "eq", "llm_call")]

# metrics
plan("evt_error_rate_tool", "event", {"agg": "ratio", "ratio": {"numerator": FAILURES}}, "SELECT tool_name AS \"toolName\", round(count(*) FILTER (status = 'failed') / count(*), 6) AS value FROM e WHERE event_type = 'tool_call' GROUP BY 1", ["toolName"], CALLS)
plan("evt_ratio_custom_denominator", "event", {"agg": "ratio", "ratio": {"numerator": [{"field": "eventType", "op": "eq", "value": "retry"}], "denominator": [{"field": "eventType", "op": "in", "value": ["tool_call", "error"]}]}}, "SELECT agent_name AS \"agentName\", round(count(*) FILTER (event_type = 'retry') / nullif(count(*) FILTER (event_type IN ('tool_call', 'error')), 0), 6) AS value FROM e GROUP BY 1", ["agentName"])
plan("evt_ratio_zero_denominator", "event", {"agg": "ratio", "ratio": {"numerator": FAILURES, "denominator": [{"field": "model", "op": "eq", "value": "no such model"}]}}, "SELECT event_type AS \"eventType\", CAST(NULL AS DOUBLE) AS value FROM e GROUP BY 1", ["eventType"])
plan("evt_count_by_tool", "event", COUNT, "SELECT tool_name AS \"toolName\", count(*) AS value FROM e GROUP BY 1", ["toolName"])
plan("evt_sum_tokens_agent", "event", {"agg": "sum", "field": "totalTokens"}, "SELECT agent_name AS \"agentName\", CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS value FROM e GROUP BY 1", ["agentName"])
plan("evt_sum_cost_user", "event", {"agg": "sum", "field": "costUsd"}, "SELECT user_id AS \"userId\", round(CAST(sum(cost_usd) AS DOUBLE), 6) AS value FROM e GROUP BY 1", ["userId"])
plan("evt_avg_latency_model_hour", "event", LATENCY, "SELECT model, date_trunc('hour', timestamp) AS bucket, round(avg(latency_ms), 6) AS value FROM e WHERE event_type = 'llm_call' GROUP BY 1, 2", ["model", {"time": "hour"}], LLM)
plan("evt_min_latency", "event", {"agg": "min", "field": "latencyMs"}, "SELECT event_type AS \"eventType\", min(latency_ms) AS value FROM e GROUP BY 1", ["eventType"])
plan("evt_max_latency", "event", {"agg": "max", "field": "latencyMs"}, "SELECT event_type AS \"eventType\", max(latency_ms) AS value FROM e GROUP BY 1", ["eventType"])
for _name, _p in (("evt_p50_latency_model", 0.5), ("evt_p95_latency_model", 0.95)):
    plan(_name, "event", {"agg": "quantile", "field": "latencyMs", "p": _p}, f"SELECT model, round(quantile_cont(latency_ms, {_p}), 6) AS value FROM e WHERE event_type = 'llm_call' GROUP BY 1", ["model"], LLM)
for _field, _column in (("runId", "run_id"), ("traceId", "trace_id"), ("userId", "user_id"), ("eventId", "event_id")):
    plan(f"evt_distinct_{_column.removesuffix('_id')}s", "event", {"agg": "count_distinct", "field": _field}, f"SELECT agent_name AS \"agentName\", count(DISTINCT {_column}) AS value FROM e GROUP BY 1", ["agentName"])

# grouping
for _grain in ("second", "minute", "hour", "day", "week", "month"):
    plan(f"bucket_{_grain}", "event", COUNT, f"SELECT CAST(date_trunc('{_grain}', timestamp) AS TIMESTAMP) AS bucket, count(*) AS value FROM e GROUP BY 1", [{"time": _grain}], sort={"by": "time", "dir": "asc"})
plan("multi_key", "event", COUNT, "SELECT agent_name AS \"agentName\", event_type AS \"eventType\", status, error_type AS \"errorType\", count(*) AS value FROM e GROUP BY 1, 2, 3, 4", ["agentName", "eventType", "status", "errorType"])
plan("global_agg", "event", {"agg": "sum", "field": "inputTokens"}, "SELECT CAST(sum(input_tokens) AS BIGINT) AS value FROM e")
plan("global_agg_empty", "event", LATENCY, "SELECT CAST(NULL AS DOUBLE) AS value", where=[("model", "eq", "no such model")])

# filters
for _op, _sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    plan(f"filter_{_op}", "event", COUNT, f"SELECT model, count(*) AS value FROM e WHERE latency_ms {_sign} 1200 AND cost_usd {_sign} 0.01 GROUP BY 1", ["model"], [("latencyMs", _op, 1200), ("costUsd", _op, 0.01)])
plan("filter_eq", "event", COUNT, f"SELECT status, count(*) AS value FROM e WHERE model = '{MODEL}' GROUP BY 1", ["status"], [("model", "eq", MODEL)])
plan("filter_neq", "event", COUNT, f"SELECT model, count(*) AS value FROM e WHERE model <> '{MODEL}' GROUP BY 1", ["model"], [("model", "neq", MODEL)])
plan("filter_in", "event", COUNT, "SELECT event_type AS \"eventType\", count(*) AS value FROM e WHERE event_type IN ('retry', 'error') GROUP BY 1", ["eventType"], [("eventType", "in", ["retry", "error"])])
plan("filter_in_scalar", "event", COUNT, f"SELECT tool_name AS \"toolName\", count(*) AS value FROM e WHERE tool_name = '{TOOL}' GROUP BY 1", ["toolName"], [("toolName", "in", TOOL)])
plan("filter_in_empty", "event", COUNT, "SELECT CAST(0 AS BIGINT) AS value", where=[("model", "in", [])])
plan("filter_timestamp", "event", COUNT, "SELECT event_type AS \"eventType\", count(*) AS value FROM e WHERE timestamp >= TIMESTAMP '2026-03-20 10:00:00' GROUP BY 1", ["eventType"], [("timestamp", "gte", "2026-03-20T12:00:00+02:00")])
plan("time_half_open", "event", COUNT, "SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS bucket, count(*) AS value FROM e WHERE timestamp >= TIMESTAMP '2026-03-10' AND timestamp < TIMESTAMP '2026-03-17' GROUP BY 1", [{"time": "day"}], window={"from": "2026-03-10T00:00:00Z", "to": "2026-03-17T00:00:00Z"})
plan("tenant_scope", "event", COUNT, f"SELECT event_type AS \"eventType\", count(*) AS value FROM e WHERE project_id = '{PROJECT}' GROUP BY 1", ["eventType"], project=PROJECT)

# order
plan("topk_failing_tools", "event", COUNT, "SELECT tool_name AS \"toolName\", count(*) AS value FROM e WHERE event_type = 'tool_call' AND status = 'failed' GROUP BY 1 ORDER BY value DESC, 1 LIMIT 10", ["toolName"], [*CALLS, ("status", "eq", "failed")], sort={"by": "metric", "dir": "desc"}, limit=10)
plan("sort_dim_asc", "event", COUNT, "SELECT model, count(*) AS value FROM e GROUP BY 1 ORDER BY 1 NULLS LAST LIMIT 5", ["model"], sort={"by": "model", "dir": "asc"}, limit=5)
plan("limit_of_caller", "event", COUNT, "SELECT user_id AS \"userId\", count(*) AS value FROM e GROUP BY 1 ORDER BY value DESC, 1 LIMIT 7", ["userId"], sort={"by": "metric", "dir": "desc"}, default_limit=7)

# rollups
plan("run_avg_cost_by_model_success", "run", {"agg": "avg", "field": "costUsd"}, "SELECT primary_model AS model, round(avg(cost_usd), 6) AS value FROM r WHERE outcome = 'success' GROUP BY 1", ["model"], [("outcome", "eq", "success")])
plan("run_avg_steps_by_outcome", "run", {"agg": "avg", "field": "stepCount"}, "SELECT outcome, round(avg(step_count), 6) AS value FROM r GROUP BY 1", ["outcome"])
plan("run_p90_duration_agent", "run", {"agg": "quantile", "field": "durationMs", "p": 0.9}, "SELECT agent_name AS \"agentName\", round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.9), 6) AS value FROM r GROUP BY 1", ["agentName"])
plan("run_sum_compute_user", "run", {"agg": "sum", "field": "computeMs"}, "SELECT user_id AS \"userId\", round(sum(compute_ms), 6) AS value FROM r GROUP BY 1", ["userId"])
plan("run_tokens_by_model", "run", {"agg": "max", "field": "totalTokens"}, "SELECT primary_model AS model, max(total_tokens) AS value FROM r WHERE total_input_tokens > 500 AND total_output_tokens >= 100 GROUP BY 1", ["model"], [("inputTokens", "gt", 500), ("outputTokens", "gte", 100)])
plan("run_started_week", "run", COUNT, "SELECT CAST(date_trunc('week', started_at) AS TIMESTAMP) AS bucket, count(*) AS value FROM r WHERE started_at >= TIMESTAMP '2026-03-05 12:00:00' GROUP BY 1", [{"time": "week"}], window={"from": "2026-03-05T12:00:00Z", "to": "2026-05-01T00:00:00Z"})
plan("run_distinct_traces_user", "run", {"agg": "count_distinct", "field": "traceId"}, "SELECT user_id AS \"userId\", count(DISTINCT trace_id) AS value FROM r GROUP BY 1", ["userId"])
plan("trace_max_duration", "trace", {"agg": "max", "field": "durationMs"}, "SELECT max(duration_ms) AS value FROM t", sort={"by": "metric", "dir": "desc"}, limit=10)
plan("trace_count_by_outcome", "trace", {"agg": "count_distinct", "field": "traceId"}, "SELECT outcome, count(DISTINCT trace_id) AS value FROM t GROUP BY 1", ["outcome"])
plan("trace_cost_by_agent", "trace", {"agg": "sum", "field": "costUsd"}, "SELECT agent_name AS \"agentName\", round(CAST(sum(cost_usd) AS DOUBLE), 6) AS value FROM t WHERE cost_usd > 0.001 GROUP BY 1", ["agentName"], [("costUsd", "gt", 0.001)])


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.runs(_source(spark, folder).read(rollups.RUN_INPUTS))


_RUN_SQL = "run_id, trace_id, project_id, agent_name, user_id, primary_model, outcome, started_at, ended_at, duration_ms, round(compute_ms, 6) AS compute_ms, step_count, cost_usd, total_input_tokens, total_output_tokens, total_tokens, error_count, retry_count"


@query("runs_rollup", _RUNS + f"SELECT {_RUN_SQL} FROM r")
def runs_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).withColumn("compute_ms", F.round("compute_ms", 6))


@query("runs_rollup_table", f"SELECT {_RUN_SQL.replace('primary_model, ', '')} FROM run_rollups")
def runs_rollup_table(spark: SparkSession, folder: str) -> DataFrame:
    """The rollup against the table of rollups; the last model is left out, as equal steps may differ in it."""
    return _runs(spark, folder).withColumn("compute_ms", F.round("compute_ms", 6)).drop("primary_model")


@query("traces_rollup", "SELECT trace_id, project_id, agent_name, outcome, run_count, started_at, ended_at, duration_ms, cost_usd FROM trace_rollups")
def traces_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.traces(_runs(spark, folder))


@query("slowest_traces", _RUNS + "SELECT trace_id, project_id, duration_ms FROM t ORDER BY duration_ms DESC, project_id, trace_id LIMIT 10")
def slowest_traces(spark: SparkSession, folder: str) -> DataFrame:
    """The list behind the question for the slowest traces."""
    return rollups.traces(_runs(spark, folder)).select("trace_id", "project_id", "duration_ms").orderBy(F.col("duration_ms").desc(), "project_id", "trace_id").limit(10)


def listing(name: str, wanted: explorer.TraceFilter, sql: str, tail: str = "", **page: int) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return explorer.list_traces(_source(spark, folder), PROJECT, wanted, **page)

    query(name, _RUNS + f"SELECT t.* FROM t WHERE project_id = '{PROJECT}' AND {sql} {tail}")(run)


listing("list_traces_all", explorer.TraceFilter(), "TRUE")
listing("list_traces_by_model", explorer.TraceFilter(model=MODEL), f"trace_id IN (SELECT trace_id FROM r WHERE project_id = '{PROJECT}' AND primary_model = '{MODEL}')")
listing("list_traces_by_tool", explorer.TraceFilter(tool=TOOL), f"trace_id IN (SELECT trace_id FROM e WHERE project_id = '{PROJECT}' AND tool_name = '{TOOL}')")
listing("list_traces_by_user", explorer.TraceFilter(user="user_0000032"), f"trace_id IN (SELECT trace_id FROM r WHERE project_id = '{PROJECT}' AND user_id = 'user_0000032')")
listing("list_traces_one_run", explorer.TraceFilter(model=MODEL, tool=TOOL), f"trace_id IN (SELECT trace_id FROM r WHERE project_id = '{PROJECT}' AND primary_model = '{MODEL}' AND run_id IN (SELECT run_id FROM e WHERE tool_name = '{TOOL}'))")
listing("list_traces_by_status", explorer.TraceFilter(status="failed", agent="ledger-helper"), "outcome = 'failed' AND agent_name = 'ledger-helper'")
listing("list_traces_by_window", explorer.TraceFilter(start=datetime(2026, 3, 10), end=datetime(2026, 3, 12)), "started_at >= TIMESTAMP '2026-03-10' AND started_at < TIMESTAMP '2026-03-12'")
listing("list_traces_page", explorer.TraceFilter(), "TRUE", "ORDER BY started_at DESC, trace_id LIMIT 20 OFFSET 40", limit=20, offset=40)

_BUSIEST = "(SELECT trace_id FROM t WHERE project_id = '" + PROJECT + "' ORDER BY run_count DESC, trace_id LIMIT 1)"


def _busiest(spark: SparkSession, folder: str) -> explorer.TraceDetail:
    source = _source(spark, folder)
    rows = rollups.traces(rollups.runs(source.read(rollups.RUN_INPUTS, F.col("project_id") == PROJECT)))
    first = rows.orderBy(F.col("run_count").desc(), "trace_id").select("trace_id").first()
    return explorer.trace_detail(source, PROJECT, first[0] if first else "")


@query("trace_detail_runs", _RUNS + f"SELECT {_RUN_SQL} FROM r WHERE trace_id = {_BUSIEST}")
def trace_detail_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _busiest(spark, folder).runs.withColumn("compute_ms", F.round("compute_ms", 6))


@query("trace_detail_events", _RUNS + f"SELECT e.* EXCLUDE (delivery_seq, batch_id, received_at) FROM e WHERE project_id = '{PROJECT}' AND trace_id = {_BUSIEST}")
def trace_detail_events(spark: SparkSession, folder: str) -> DataFrame:
    return _busiest(spark, folder).events


MODELS = ["aster-large", "aster-mini", "brook-2", "brook-2-lite", "cobalt-r1", "delta-chat"]


@query(
    "pivot_latency_model",
    _SOURCE + "SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS bucket, " + ", ".join(f"round(max(latency_ms) FILTER (model = '{m}'), 6) AS \"{m}\"" for m in MODELS) + " FROM e WHERE event_type = 'llm_call' GROUP BY 1",
)
def pivot_latency_model(spark: SparkSession, folder: str) -> DataFrame:
    """A line chart's table: a column for each of the models asked for."""
    raw = {"level": "event", "metric": {"agg": "max", "field": "latencyMs"}, "dimensions": ["model", {"time": "day"}], "filters": [{"field": "eventType", "op": "eq", "value": "llm_call"}], "timeRange": WINDOW, "chartHint": "line"}
    return explorer.series(_rounded(compile_plan(_source(spark, folder), Plan.parse(raw)).frame), "model", MODELS)


@query("anti_insert", f"SELECT delivery_seq FROM agent_events QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY delivery_seq) = 1 AND batch_id > 100")
def anti_insert(spark: SparkSession, folder: str) -> DataFrame:
    """What an append of the later batches adds to the messages of the first 100 batches."""
    rows = table(spark, folder, "agent_events").select("delivery_seq", "batch_id", "event_id")
    early = rows.where("batch_id <= 100").select(uuid_key(F.col("event_id")).alias("k"))
    late = rows.where("batch_id > 100").withColumn("k", uuid_key(F.col("event_id"))).groupBy("k").agg(F.min("delivery_seq").alias("delivery_seq"))
    return late.join(early, "k", "left_anti").select("delivery_seq")


@query(
    "append_idempotent",
    f"""WITH k AS (SELECT {KEY} AS k, batch_id FROM agent_events), n AS (SELECT count(*) AS n, count(DISTINCT k) AS d, count(*) FILTER (batch_id <= 100) AS early, count(DISTINCT k) FILTER (batch_id <= 100) AS early_d FROM k)
SELECT 'early' AS batch, early_d AS inserted, early - early_d AS duplicates FROM n UNION ALL SELECT 'late', d - early_d, (n - early) - (d - early_d) FROM n UNION ALL SELECT 'all again', 0, n FROM n UNION ALL SELECT 'stored', d, 0 FROM n""",
)
def append_idempotent(spark: SparkSession, folder: str) -> DataFrame:
    """Inserted messages and duplicates of three appends to a store: the first 100 batches, the others, and all once more."""
    rows, path = table(spark, folder, "agent_events"), scratch_path(spark, "append")
    store, found = EventStore(spark, path), []
    for name, part in (("early", rows.where("batch_id <= 100")), ("late", rows.where("batch_id > 100")), ("all again", rows)):
        done = store.append(part, name, "delivery_seq")
        found.append((name, done.inserted, done.duplicates))
    found.append(("stored", store.read().count(), 0))
    remove_path(spark, path)
    return spark.createDataFrame(found, "batch string, inserted long, duplicates long")


def _wire(spark: SparkSession, folder: str) -> DataFrame:
    """The rows as wire messages: what a client would have sent, with the fields that are missing missing."""
    kind = F.col("event_type")
    rows = table(spark, folder, "agent_events")
    fields = {
        "eventId": F.col("event_id"), "traceId": F.col("trace_id"), "runId": F.col("run_id"), "eventType": kind, "timestamp": F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")),
        "agentName": F.col("agent_name"), "userId": F.col("user_id"), "stepIndex": F.col("step_index"), "metadata": F.parse_json("metadata"), "model": F.col("model"), "toolName": F.col("tool_name"),
        "status": F.col("status"), "errorType": F.when(kind == "error", F.col("error_type")), "latencyMs": F.col("latency_ms"), "inputTokens": F.col("input_tokens"), "outputTokens": F.col("output_tokens"), "costUsd": F.col("cost_usd").cast("double"),
        "attempt": F.when(kind == "retry", 1), "input": F.when(kind == "run_started", F.col("metadata")),
    }
    return rows.select("delivery_seq", "project_id", "event_type", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("body"))


@query(
    "validate_partial_reject",
    """SELECT event_type, count(*) FILTER (good) AS accepted, count(*) FILTER (NOT good) AS rejected FROM (SELECT event_type, coalesce(CASE event_type
  WHEN 'llm_call' THEN model IS NOT NULL AND status IN ('success', 'failed') AND latency_ms >= 0 AND input_tokens >= 0 AND output_tokens >= 0 AND cost_usd >= 0
  WHEN 'tool_call' THEN tool_name IS NOT NULL AND status IN ('success', 'failed') AND latency_ms >= 0
  WHEN 'error' THEN error_type IS NOT NULL AND status = 'failed' WHEN 'run_started' THEN status = 'running' WHEN 'run_completed' THEN status IN ('success', 'failed')
  WHEN 'retry' THEN status IS NULL OR status IN ('success', 'failed') WHEN 'step_completed' THEN status IS NULL END, FALSE) AS good FROM agent_events) GROUP BY event_type""",
)
def validate_partial_reject(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and rejected wire messages by event type."""
    return wire.validate(_wire(spark, folder)).groupBy("event_type").agg(F.count_if(F.size("problems") == 0).alias("accepted"), F.count_if(F.size("problems") > 0).alias("rejected"))


@query(
    "payload_strip",
    "SELECT delivery_seq, 'local://' || substr(s, 1, 2) || '/' || project_id || '/' || s AS ref FROM (SELECT delivery_seq, project_id, regexp_replace(event_id, '[^a-zA-Z0-9_-]', '_', 'g') AS s FROM agent_events WHERE event_type = 'run_started')",
)
def payload_strip(spark: SparkSession, folder: str) -> DataFrame:
    """References of the texts that leave the event rows."""
    rows, _ = payloads.strip(wire.accepted(wire.validate(_wire(spark, folder).drop("event_type")).drop("body"), F.col("project_id")))
    return rows.select("delivery_seq", F.get_json_object("metadata", f"$.{payloads.REFERENCE}").alias("ref")).where("ref is not null")


QUESTIONS = {
    "nl_latency_by_model_over_time": ("Average LLM latency by model over time", "SELECT model, date_trunc('hour', timestamp) AS bucket, round(avg(latency_ms), 6) AS value FROM e WHERE event_type = 'llm_call' GROUP BY 1, 2"),
    "nl_failing_tools": ("Which tools fail the most", "SELECT tool_name AS \"toolName\", count(*) AS value FROM e WHERE event_type = 'tool_call' AND status = 'failed' GROUP BY 1 ORDER BY value DESC, 1 LIMIT 10"),
    "nl_tokens_by_agent": ("Token usage by agent type", "SELECT agent_name AS \"agentName\", CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS value FROM e GROUP BY 1"),
    "nl_cost_per_successful_run": ("Cost per successful run by model", "SELECT primary_model AS model, round(avg(cost_usd), 6) AS value FROM r WHERE outcome = 'success' GROUP BY 1"),
    "nl_slowest_traces": ("Top 10 slowest traces", "SELECT max(duration_ms) AS value FROM t"),
    "nl_error_rate_by_tool": ("Error rate by tool name", "SELECT tool_name AS \"toolName\", round(count(*) FILTER (status = 'failed') / count(*), 6) AS value FROM e WHERE event_type = 'tool_call' GROUP BY 1"),
    "nl_runs_per_hour": ("Number of runs per hour", "SELECT date_trunc('hour', timestamp) AS bucket, count(DISTINCT run_id) AS value FROM e GROUP BY 1"),
    "nl_steps_by_outcome": ("Average steps per run by outcome", "SELECT outcome, round(avg(step_count), 6) AS value FROM r GROUP BY 1"),
    "nl_p95_latency_by_model": ("p95 LLM latency by model", "SELECT model, round(quantile_cont(latency_ms, 0.95), 6) AS value FROM e WHERE event_type = 'llm_call' GROUP BY 1"),
    "nl_cost_by_user_in_march": ("total cost by user between 2026-03-05 and 2026-03-20", "SELECT user_id AS \"userId\", round(CAST(sum(cost_usd) AS DOUBLE), 6) AS value FROM e WHERE timestamp >= TIMESTAMP '2026-03-05' AND timestamp < TIMESTAMP '2026-03-21' GROUP BY 1"),
}


def answered(text: str, source: EventSource) -> DataFrame:
    """The answer to a question asked at NOW about SPAN."""
    answer = plan_question(text, NOW, SPAN)
    if not isinstance(answer, Answered):
        raise ValueError(answer.reason)
    return _rounded(compile_plan(source, answer.plan).frame)


def question(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return answered(text, _source(spark, folder))

    query(name, (_RUNS if " FROM r" in sql or " FROM t" in sql else _SOURCE) + sql)(run)


for _name, (_text, _sql) in QUESTIONS.items():
    question(_name, _text, _sql)
