"""Run and trace rollups, derived from events on read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.schema import RUN_COLUMNS, TRACE_COLUMNS

RUN_INPUTS = ["project_id", "run_id", "trace_id", "agent_name", "user_id", "event_type", "timestamp", "step_index", "model", "status", "latency_ms", "input_tokens", "output_tokens", "cost_usd"]


def millis(column: Column) -> Column:
    """Epoch milliseconds of a UTC wall time."""
    return F.unix_millis(column.cast("timestamp"))


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def runs(events: DataFrame) -> DataFrame:
    """One row per (project, run). The project is a grouping key so that a tenant filter reaches the scan.

    ``primary_model`` is the model of the run's last step that has one; ``outcome`` the greatest, in
    the order failed < running < success, of its terminal events, and running without one; a run's
    attributes that should be constant are the smallest value.
    """
    terminal = F.col("event_type") == "run_completed"
    # the order of the words is that of the numbers; a number keeps the aggregate's buffer fixed-width
    rank = F.max(F.when(terminal, F.when(F.col("status") == "success", 3).when(F.col("status") == "failed", 1).otherwise(2)))
    last_model = F.max(F.when(F.col("model").isNotNull(), F.struct("step_index", "timestamp", "model")))
    grouped = events.groupBy("project_id", "run_id").agg(
        F.min("trace_id").alias("trace_id"),
        F.min("agent_name").alias("agent_name"),
        F.min("user_id").alias("user_id"),
        last_model.alias("last_model"),
        rank.alias("rank"),
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("compute_ms"),
        (F.max("step_index") + 1).alias("step_count"),
        _total("cost_usd").cast("decimal(18,6)").alias("cost_usd"),
        _total("input_tokens").alias("total_input_tokens"),
        _total("output_tokens").alias("total_output_tokens"),
        F.count_if(F.col("event_type") == "error").alias("error_count"),
        F.count_if(F.col("event_type") == "retry").alias("retry_count"),
    )
    return grouped.withColumns(
        {
            "primary_model": F.col("last_model.model"),
            "outcome": F.when(F.col("rank") == 3, "success").when(F.col("rank") == 1, "failed").otherwise("running"),
            "duration_ms": millis(F.col("ended_at")) - millis(F.col("started_at")),
            "total_tokens": F.col("total_input_tokens") + F.col("total_output_tokens"),
        }
    ).select(*RUN_COLUMNS)


def traces(run_rows: DataFrame) -> DataFrame:
    """One row per (project, trace) over ``runs``; the outcome is that of the run that started last."""
    grouped = run_rows.groupBy("project_id", "trace_id").agg(
        F.min("agent_name").alias("agent_name"),
        F.max(F.struct("started_at", "run_id", "outcome")).alias("latest"),
        F.count_distinct("run_id").alias("run_count"),
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        _total("cost_usd").cast("decimal(18,6)").alias("cost_usd"),
    )
    return grouped.withColumns({"outcome": F.col("latest.outcome"), "duration_ms": millis(F.col("ended_at")) - millis(F.col("started_at"))}).select(*TRACE_COLUMNS)
