"""What a plan may name at each level: logical names, their columns and their uses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnknownField(ValueError):
    """A logical name that the level does not have."""


@dataclass(frozen=True)
class Level:
    """Logical name -> the columns it needs, by use."""

    name: str
    dimensions: dict[str, str]
    measures: dict[str, str]
    distinct: dict[str, str]
    comparisons: dict[str, str]
    time: str

    def column(self, logical: str) -> Column:
        """The expression of any name of this level."""
        if logical == "totalTokens" and self.name == "event":
            return F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0))
        return F.col(self.physical(logical))

    def physical(self, logical: str) -> str:
        for names in (self.dimensions, self.measures, self.distinct, self.comparisons, {"timestamp": self.time}):
            if logical in names:
                return names[logical]
        raise UnknownField(f"{logical} is not available at the level {self.name}")

    def inputs(self, logical: str) -> list[str]:
        return ["input_tokens", "output_tokens"] if logical == "totalTokens" and self.name == "event" else [self.physical(logical)]


# Logical names, their columns, aggregates, operators and charts, as plans write them
LEVELS = {
    "event": Level(
        "event",
        {"agentName": "agent_name", "model": "model", "toolName": "tool_name", "status": "status", "eventType": "event_type", "userId": "user_id", "errorType": "error_type"},
        {"latencyMs": "latency_ms", "inputTokens": "input_tokens", "outputTokens": "output_tokens", "totalTokens": "total_tokens", "costUsd": "cost_usd"},
        {"runId": "run_id", "traceId": "trace_id", "eventId": "event_id", "userId": "user_id"},
        {"latencyMs": "latency_ms", "costUsd": "cost_usd", "inputTokens": "input_tokens", "outputTokens": "output_tokens", "timestamp": "timestamp"},
        "timestamp",
    ),
    "run": Level(
        "run",
        {"agentName": "agent_name", "model": "primary_model", "userId": "user_id", "outcome": "outcome"},
        {"durationMs": "duration_ms", "computeMs": "compute_ms", "stepCount": "step_count", "costUsd": "cost_usd", "totalTokens": "total_tokens"},
        {"runId": "run_id", "traceId": "trace_id", "userId": "user_id"},
        {"costUsd": "cost_usd", "inputTokens": "total_input_tokens", "outputTokens": "total_output_tokens", "timestamp": "started_at"},
        "started_at",
    ),
    "trace": Level(
        "trace",
        {"agentName": "agent_name", "outcome": "outcome"},
        {"durationMs": "duration_ms", "costUsd": "cost_usd"},
        {"traceId": "trace_id"},
        {"costUsd": "cost_usd", "timestamp": "started_at"},
        "started_at",
    ),
}

#: All names a plan may use at some level.
DIMENSIONS = ["agentName", "model", "toolName", "status", "eventType", "userId", "errorType", "outcome"]
MEASURES = ["latencyMs", "inputTokens", "outputTokens", "totalTokens", "costUsd", "durationMs", "computeMs", "stepCount"]
IDENTIFIERS = ["runId", "traceId", "eventId", "userId"]
COMPARISONS = ["latencyMs", "costUsd", "inputTokens", "outputTokens", "timestamp"]
AGGREGATES = ["count", "count_distinct", "sum", "avg", "min", "max", "quantile", "ratio"]
OPERATORS = ["eq", "neq", "gt", "gte", "lt", "lte", "in"]
CHARTS = ["line", "bar", "table"]
