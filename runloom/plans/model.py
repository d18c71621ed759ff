"""Query plans: one metric, keys, filters and a time range over events, runs or traces.

``Plan.parse`` is the safety boundary: whatever a planner or a caller proposes is checked against the
closed vocabularies, and all problems are reported together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from runloom.plans import fields as X
from runloom.schema import GRAINS

MAX_LIMIT = 10_000


class PlanError(ValueError):
    """A plan that is not valid; ``problems`` lists why."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class Bucket:
    """A time key."""

    grain: str


@dataclass(frozen=True)
class Metric:
    agg: str
    field: str | None = None
    p: float | None = None
    numerator: tuple[Filter, ...] = ()
    denominator: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Sort:
    by: str
    direction: str


@dataclass(frozen=True)
class Plan:
    level: str
    metric: Metric
    start: datetime
    end: datetime
    dimensions: tuple[str | Bucket, ...] = ()
    filters: tuple[Filter, ...] = ()
    sort: Sort | None = None
    limit: int | None = None
    chart: str = "table"

    @staticmethod
    def parse(raw: Any) -> Plan:
        """A valid plan from its wire form, or PlanError. Unknown keys of the plan itself are dropped."""
        return _Reader().plan(raw)


def parse_instant(text: Any) -> datetime:
    """UTC wall time, to the millisecond, of an ISO-8601 instant with an offset."""
    if not isinstance(text, str) or len(text) < 20 or text[10] not in "Tt":
        raise ValueError("not an instant")
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError("an instant needs an offset")
    at = at.astimezone(timezone.utc).replace(tzinfo=None)
    return at.replace(microsecond=at.microsecond // 1000 * 1000)


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


class _Reader:
    """Collects problems; a part with a problem is left out of what it returns."""

    def __init__(self) -> None:
        self.problems: list[str] = []

    def fail(self, where: str, what: str) -> None:
        self.problems.append(f"{where}: {what}")

    def one_of(self, where: str, value: Any, allowed: list[str]) -> str | None:
        if isinstance(value, str) and value in allowed:
            return value
        self.fail(where, f"must be one of {', '.join(allowed)}")
        return None

    def filters(self, where: str, raw: Any, least: int = 0) -> tuple[Filter, ...]:
        if not isinstance(raw, list) or len(raw) < least:
            self.fail(where, f"must be a list of at least {least}")
            return ()
        found = []
        for i, item in enumerate(raw):
            at = f"{where}.{i}"
            if not isinstance(item, dict):
                self.fail(at, "must be an object")
                continue
            name, op, value = self.one_of(f"{at}.field", item.get("field"), X.DIMENSIONS + X.COMPARISONS), self.one_of(f"{at}.op", item.get("op"), X.OPERATORS), item.get("value")
            listed = isinstance(value, list) and (all(isinstance(v, str) for v in value) or all(_is_number(v) for v in value))
            if not (isinstance(value, (str, bool)) or _is_number(value) or listed):
                self.fail(f"{at}.value", "must be text, a number, a boolean, or a list of texts or numbers")
                continue
            if listed and op not in (None, "in"):
                self.fail(f"{at}.value", "only 'in' takes a list")
                continue
            if name == "timestamp":
                try:
                    value = [parse_instant(v) for v in value] if listed else parse_instant(value)
                except ValueError:
                    self.fail(f"{at}.value", "must be an instant with an offset")
                    continue
            if name and op:
                found.append(Filter(name, op, tuple(value) if isinstance(value, list) else value))
        return tuple(found)

    def metric(self, raw: Any) -> Metric | None:
        if not isinstance(raw, dict):
            self.fail("metric", "must be an object")
            return None
        agg, name, p, ratio = self.one_of("metric.agg", raw.get("agg"), X.AGGREGATES), raw.get("field"), raw.get("p"), raw.get("ratio")
        if name is not None:
            name = self.one_of("metric.field", name, X.MEASURES + X.IDENTIFIERS)
        top: tuple[Filter, ...] = ()
        bottom: tuple[Filter, ...] = ()
        if agg == "ratio":
            if isinstance(ratio, dict):
                top, bottom = self.filters("metric.ratio.numerator", ratio.get("numerator"), 1), self.filters("metric.ratio.denominator", ratio.get("denominator", []))
            else:
                self.fail("metric.ratio", "is required for a ratio")
        elif ratio is not None:
            self.fail("metric.ratio", "belongs to a ratio only")
        if agg not in (None, "count", "ratio") and raw.get("field") is None:
            self.fail("metric.field", f"is required for {agg}")
        if agg == "quantile":
            if not _is_number(p) or not 0 < p < 1:
                self.fail("metric.p", "must lie between 0 and 1")
        elif p is not None:
            self.fail("metric.p", "belongs to a quantile only")
        if agg == "count_distinct" and name is not None and name not in X.IDENTIFIERS:
            self.fail("metric.field", "must be an identifier for count_distinct")
        if agg in ("sum", "avg", "min", "max", "quantile") and name in X.IDENTIFIERS:
            self.fail("metric.field", f"an identifier has no {agg}")
        return Metric(agg or "", name, p, top, bottom)

    def dimensions(self, raw: Any) -> tuple[str | Bucket, ...]:
        if not isinstance(raw, list):
            self.fail("dimensions", "must be a list")
            return ()
        found: list[str | Bucket] = []
        for i, item in enumerate(raw):
            if isinstance(item, dict) and set(item) == {"time"}:
                if grain := self.one_of(f"dimensions.{i}.time", item["time"], GRAINS):
                    found.append(Bucket(grain))
            elif name := self.one_of(f"dimensions.{i}", item, X.DIMENSIONS):
                found.append(name)
        keys = ["time" if isinstance(d, Bucket) else d for d in found]
        if len(set(keys)) < len(keys):
            self.fail("dimensions", "a key may occur once")
        return tuple(found)

    def plan(self, raw: Any) -> Plan:
        if not isinstance(raw, dict):
            raise PlanError(["plan: must be an object"])
        level = self.one_of("level", raw.get("level"), list(X.LEVELS))
        metric = self.metric(raw.get("metric"))
        keys, where = self.dimensions(raw.get("dimensions", [])), self.filters("filters", raw.get("filters", []))
        window = raw.get("timeRange")
        start = end = datetime.min
        try:
            start, end = parse_instant(window["from"]), parse_instant(window["to"])
        except (TypeError, KeyError, ValueError):
            self.fail("timeRange", "needs the instants from and to, with offsets")
        sort = None
        if (order := raw.get("sort")) is not None:
            if isinstance(order, dict):
                by, way = self.one_of("sort.by", order.get("by"), ["metric", "time", *X.DIMENSIONS]), self.one_of("sort.dir", order.get("dir"), ["asc", "desc"])
                if by and way:
                    sort = Sort(by, way)
                if by == "time" and not any(isinstance(d, Bucket) for d in keys) or by in X.DIMENSIONS and by not in keys:
                    self.fail("sort.by", "must be the metric or one of the dimensions")
            else:
                self.fail("sort", "must be an object")
        limit = raw.get("limit")
        if limit is not None and not (isinstance(limit, int) and not isinstance(limit, bool) and 1 <= limit <= MAX_LIMIT):
            self.fail("limit", f"must be a whole number from 1 to {MAX_LIMIT}")
        chart = self.one_of("chartHint", raw.get("chartHint"), X.CHARTS)
        if level and metric:
            self._available(X.LEVELS[level], metric, keys, where)
        if self.problems:
            raise PlanError(self.problems)
        return Plan(level, metric, start, end, keys, where, sort, limit, chart)

    def _available(self, level: X.Level, metric: Metric, keys: tuple[str | Bucket, ...], where: tuple[Filter, ...]) -> None:
        """Names that exist at some level but not at this one."""
        if metric.field and metric.agg == "count_distinct" and metric.field not in level.distinct:
            self.fail("metric.field", f"{metric.field} cannot be counted at the level {level.name}")
        if metric.field in X.MEASURES and metric.field not in level.measures:
            self.fail("metric.field", f"{metric.field} is not a measure of the level {level.name}")
        for key in keys:
            if isinstance(key, str) and key not in level.dimensions:
                self.fail("dimensions", f"{key} is not a dimension of the level {level.name}")
        for f in (*where, *metric.numerator, *metric.denominator):
            if f.field not in level.dimensions and f.field not in level.comparisons:
                self.fail("filters", f"{f.field} cannot be filtered at the level {level.name}")
