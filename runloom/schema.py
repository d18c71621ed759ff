"""The event row, the rollup rows and the closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of event types, states, grains and columns, as events and rollups have them
EVENT_TYPES = ["run_started", "llm_call", "tool_call", "step_completed", "error", "retry", "run_completed"]
STATUSES = ["running", "success", "failed"]
OUTCOMES = ["success", "failed", "running"]
GRAINS = ["second", "minute", "hour", "day", "week", "month"]

MONEY = T.DecimalType(12, 6)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("trace_id", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("project_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("agent_name", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("step_index", T.IntegerType(), False),
        T.StructField("model", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cost_usd", MONEY),
        T.StructField("metadata", T.StringType()),
    ]
)

RUN_COLUMNS = [
    "run_id", "trace_id", "project_id", "agent_name", "user_id", "primary_model", "outcome", "started_at", "ended_at",
    "duration_ms", "compute_ms", "step_count", "cost_usd", "total_input_tokens", "total_output_tokens", "total_tokens",
    "error_count", "retry_count",
]
TRACE_COLUMNS = ["trace_id", "project_id", "agent_name", "outcome", "run_count", "started_at", "ended_at", "duration_ms", "cost_usd"]
