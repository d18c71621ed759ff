"""From a valid plan to a DataFrame.

The plan stays one declarative aggregate, so that Catalyst prunes columns and pushes filters: at the
level of events all filters run below the de-duplication of deliveries and reach the scan; at the
levels of runs and traces only the tenant does, because a rollup needs all events of its runs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators import rollups
from runloom.plans.fields import LEVELS, Level
from runloom.plans.model import Bucket, Filter, Metric, Plan
from runloom.sources.events import EventSource


@dataclass(frozen=True)
class ResultColumn:
    name: str
    role: str


@dataclass(frozen=True)
class Compiled:
    """A lazy result with the roles of its columns."""

    frame: DataFrame
    columns: tuple[ResultColumn, ...]
    chart: str


def predicate(level: Level, f: Filter) -> Column:
    """SQL's comparison: rows with a null on the left never match. An empty list matches nothing."""
    column = level.column(f.field)
    if f.op == "in":
        values = list(f.value) if isinstance(f.value, tuple) else [f.value]
        return column.isin(values) if values else F.lit(False)
    value = F.lit(f.value)
    return {"eq": column == value, "neq": column != value, "gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[f.op]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def bucket(column: Column, grain: str) -> Column:
    """Start of the period (weeks start on Monday), as UTC wall time."""
    return F.date_trunc(grain, column).cast("timestamp_ntz")


def metric_column(level: Level, metric: Metric, exact: bool = True) -> Column:
    """The aggregate of a metric. ``exact`` False allows an approximate quantile (1/10000 of the rank)."""
    if metric.agg == "count":
        return F.count(F.lit(1))
    if metric.agg == "ratio":
        part, whole = (F.count_if(all_of([predicate(level, f) for f in fs])) if fs else F.count(F.lit(1)) for fs in (metric.numerator, metric.denominator))
        return part.cast("double") / F.nullif(whole, F.lit(0))
    column = level.column(metric.field)
    if metric.agg == "count_distinct":
        return F.count_distinct(column)
    if metric.agg == "quantile":
        return F.percentile(column, metric.p) if exact else F.percentile_approx(column, metric.p, 10_000)
    value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[metric.agg](column)
    return value.cast("double") if metric.agg == "avg" or metric.field == "costUsd" else value


def level_rows(source: EventSource, plan: Plan, project: str | None) -> DataFrame:
    """The rows of the plan's level that the metric sees."""
    level = LEVELS[plan.level]
    conditions = [predicate(level, f) for f in plan.filters]
    time = F.col(level.time)
    conditions += [time >= F.lit(plan.start).cast("timestamp_ntz"), time < F.lit(plan.end).cast("timestamp_ntz")]
    tenant = None if project is None else F.col("project_id") == project
    if plan.level == "event":
        used = [f.field for f in (*plan.metric.numerator, *plan.metric.denominator)]
        used += [d for d in plan.dimensions if isinstance(d, str)] + ([plan.metric.field] if plan.metric.field else [])
        columns = [c for name in used for c in level.inputs(name)] + ([level.time] if any(isinstance(d, Bucket) for d in plan.dimensions) else [])
        return source.read(columns, all_of(conditions + ([tenant] if tenant is not None else [])))
    rows = source.run_rows(tenant)
    return (rows if plan.level == "run" else rollups.traces(rows)).where(all_of(conditions))


def compile_plan(source: EventSource, plan: Plan, project: str | None = None, default_limit: int | None = None, exact: bool = True) -> Compiled:
    """The plan's result: its keys, named as in the plan (a time key is ``bucket``), and ``value``.

    Nulls are a key of their own and sort last. Equal values are ordered by the keys, so that a limit
    is deterministic. ``default_limit`` holds where the plan has none.
    """
    level = LEVELS[plan.level]
    keys = [bucket(F.col(level.time), d.grain).alias("bucket") if isinstance(d, Bucket) else level.column(d).alias(d) for d in plan.dimensions]
    names = ["bucket" if isinstance(d, Bucket) else d for d in plan.dimensions]
    rows, value = level_rows(source, plan, project), metric_column(level, plan.metric, exact).alias("value")
    frame = rows.groupBy(*keys).agg(value) if keys else rows.agg(value)
    if plan.sort:
        by = {"metric": "value", "time": "bucket"}.get(plan.sort.by, plan.sort.by)
        first = F.col(by).asc_nulls_last() if plan.sort.direction == "asc" else F.col(by).desc_nulls_last()
        frame = frame.orderBy(first, *[F.col(n).asc_nulls_last() for n in names if n != by])
    limit = plan.limit if plan.limit is not None else default_limit
    if limit is not None:
        frame = frame.limit(limit)
    roles = [ResultColumn(n, "time" if n == "bucket" else "dimension") for n in names] + [ResultColumn("value", "measure")]
    return Compiled(frame, tuple(roles), plan.chart)


def to_rows(compiled: Compiled) -> list[dict]:
    """The result as JSON-ready rows, for an API's edge only: times as ISO text, decimals as numbers."""
    rows = []
    for row in compiled.frame.collect():
        values = row.asDict()
        for name, value in values.items():
            if hasattr(value, "isoformat"):
                values[name] = value.isoformat(timespec="milliseconds") + "Z"
            elif value is not None and not isinstance(value, (str, int, float, bool)):
                values[name] = float(value)
            elif isinstance(value, float) and value != value:
                values[name] = None
        rows.append(values)
    return rows
