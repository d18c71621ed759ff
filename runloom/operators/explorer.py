"""The trace explorer: filtered trace lists, and one trace with its runs and events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import rollups
from runloom.schema import EVENTS
from runloom.sources.events import EventSource


#: Events of a trace that may be nested in one row.
MOST_NESTED = 10_000


@dataclass(frozen=True)
class TraceFilter:
    """All given conditions hold; ``model``, ``user`` and ``tool`` must hold on one run of the trace."""

    start: datetime | None = None
    end: datetime | None = None
    agent: str | None = None
    status: str | None = None
    model: str | None = None
    tool: str | None = None
    user: str | None = None


def list_traces(source: EventSource, project: str, wanted: TraceFilter = TraceFilter(), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Trace rollups of a project, the latest started first; equal starts by trace id."""
    tenant = F.col("project_id") == project
    run_rows = source.run_rows(tenant)
    found = rollups.traces(run_rows)
    for column, value, holds in (("started_at", wanted.start, "__ge__"), ("started_at", wanted.end, "__lt__"), ("agent_name", wanted.agent, "__eq__"), ("outcome", wanted.status, "__eq__")):
        if value is not None:
            literal = F.lit(value).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)
            found = found.where(getattr(F.col(column), holds)(literal))
    if wanted.model is not None or wanted.user is not None or wanted.tool is not None:
        having = run_rows
        if wanted.model is not None:
            having = having.where(F.col("primary_model") == wanted.model)
        if wanted.user is not None:
            having = having.where(F.col("user_id") == wanted.user)
        if wanted.tool is not None:
            # existence needs no de-duplication: a redelivered call is still a call
            calls = source.rows.where(tenant & (F.col("tool_name") == wanted.tool)).select("project_id", "run_id")
            having = having.join(calls, ["project_id", "run_id"], "left_semi")
        found = found.join(having.select("project_id", "trace_id"), ["project_id", "trace_id"], "left_semi")
    found = found.orderBy(F.col("started_at").desc(), "trace_id")
    if offset:
        found = found.offset(offset)
    return found if limit is None else found.limit(limit)


@dataclass(frozen=True)
class TraceDetail:
    trace: DataFrame
    runs: DataFrame
    events: DataFrame


def trace_detail(source: EventSource, project: str, trace_id: str) -> TraceDetail:
    """Three frames; an unknown trace gives empty ones. The key's filter reaches every scan."""
    here = (F.col("project_id") == project) & (F.col("trace_id") == trace_id)
    run_rows = source.run_rows(here)
    events = source.read([f.name for f in EVENTS], here)
    return TraceDetail(rollups.traces(run_rows), run_rows.orderBy("started_at", "run_id"), events.orderBy("step_index", "timestamp", "event_id"))


def nested_detail(detail: TraceDetail, most: int = MOST_NESTED) -> DataFrame:
    """The trace as one row with ``runs`` and ``events`` arrays; a trace of more than ``most`` events raises, as its row would have no bound (read the frames)."""
    if detail.events.limit(most + 1).count() > most:
        raise ValueError(f"the trace has more than {most} events")
    runs = detail.runs.agg(F.sort_array(F.collect_list(F.struct("started_at", "run_id", F.struct("*").alias("run")))).alias("r")).select(F.col("r.run").alias("runs"))
    events = detail.events.agg(F.sort_array(F.collect_list(F.struct("step_index", "timestamp", "event_id", F.struct("*").alias("event")))).alias("e")).select(F.col("e.event").alias("events"))
    return detail.trace.join(runs, how="inner").join(events, how="inner")  # one row each


def series(result: DataFrame, dimension: str, values: list[str] | None = None) -> DataFrame:
    """A line chart's table: one row per ``bucket``, one column per value of ``dimension``; absent points stay null."""
    pivot = result.groupBy("bucket").pivot(dimension, values) if values else result.groupBy("bucket").pivot(dimension)
    return pivot.agg(F.first("value")).orderBy("bucket")
