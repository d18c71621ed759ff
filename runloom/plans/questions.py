"""From a question to a proposed plan: the catalogue first, then slots of a free question.

Both are read from the tables of ``lexicon``. A proposal is in the plan's wire form and holds no time
range; the planner adds it and validates.
"""

from __future__ import annotations

import re
from typing import Any

from runloom.plans import lexicon as L


def normalise(question: str) -> str:
    """Lower case; letters a-z, digits and % only; single blanks."""
    return " ".join(re.sub(r"[^a-z0-9%\s]", " ", question.lower()).split())


def mentions(text: str, phrases: tuple[str, ...]) -> bool:
    return any(p in text for p in phrases)


def lookup(text: str, entries: list[tuple[tuple[str, ...], str]]) -> str | None:
    """The value of the first entry of which a phrase occurs."""
    return next((value for phrases, value in entries if mentions(text, phrases)), None)


def percentile(text: str, endings: tuple[str, ...]) -> tuple[bool, float | None]:
    """Whether a percentile of two or three digits is written, as p95 or before the word, and its share if it lies within 1 to 99."""
    words = text.split()
    digits = [w[1:] for w in words if w[0] == "p"]
    for word, after in zip(words, words[1:]):
        if after.startswith("percentile"):
            digits += [word.removesuffix(e) for e in endings if word.endswith(e)]
    for number in digits:
        if number.isdecimal() and 2 <= len(number) <= 3:
            return True, int(number) / 100 if 0 < int(number) < 100 else None
    return False, None


def equals(field: str, value: str) -> dict[str, Any]:
    return {"field": field, "op": "eq", "value": value}


def propose(question: str) -> dict[str, Any] | None:
    """A proposed plan, or None if the question is not understood."""
    text = normalise(question)
    if not text:
        return None
    return _latency_percentile(text) or _catalogued(text) or _free(text)


def _latency_percentile(text: str) -> dict[str, Any] | None:
    if not mentions(text, L.LATENCY):
        return None
    written, p = percentile(text, L.LATENCY_PERCENTILE_ENDINGS)
    if not written:
        p = 0.5 if L.MEDIAN in text else 0.95 if "percentile" in text else None
    if p is None:
        return None
    grain = lookup(text, L.GRAINS)
    keys = [name for word, name in (("model", "model"), ("tool", "toolName")) if word in text]
    return {
        "level": "event",
        "metric": {"agg": "quantile", "field": "latencyMs", "p": p},
        "dimensions": [*keys, *([{"time": grain}] if grain else [])],
        "filters": [equals("eventType", "tool_call" if keys == ["toolName"] else "llm_call")],
        "sort": {"by": "time", "dir": "asc"} if grain else {"by": "metric", "dir": "desc"},
        "chartHint": "line" if grain else "bar",
    }


def _catalogued(text: str) -> dict[str, Any] | None:
    grain = lookup(text, L.GRAINS)
    for _, needed, barred, entry in L.CATALOGUE:
        asks_grain = "$grain" in entry["dimensions"]
        if not all(mentions(text, group) for group in needed) or mentions(text, barred) or asks_grain and not grain:
            continue
        metric = dict(entry["metric"])
        if metric.pop("failed", False):
            metric["ratio"] = {"numerator": [equals("status", "failed")], "denominator": []}
        plan = {**entry, "metric": metric, "dimensions": [{"time": grain} if d == "$grain" else d for d in entry["dimensions"]], "filters": [equals(*f) for f in entry["filters"]]}
        if "sort" in plan:
            plan["sort"] = dict(zip(("by", "dir"), plan["sort"]))
        return plan
    return None


def _aggregate(text: str, measure: str) -> dict[str, Any]:
    _, p = percentile(text, L.PERCENTILE_ENDINGS)
    if p is None and L.MEDIAN in text:
        p = 0.5
    if p is not None:
        return {"agg": "quantile", "field": measure, "p": p}
    usual = "sum" if measure in L.SUMMED_MEASURES else "avg"
    return {"agg": lookup(text, L.AGGREGATES) or usual, "field": measure}


def _count(text: str) -> tuple[dict[str, Any], str | None]:
    """What is counted, and the event type it is restricted to."""
    entity = next((field for names, field in L.COUNTED_ENTITIES if set(names) & set(text.split())), None)
    return ({"agg": "count_distinct", "field": entity} if entity else {"agg": "count"}), lookup(text, L.COUNTED_TYPES)


def _measured_type(text: str, measure: str, category: str | None) -> str | None:
    """The event type that carries the key or the measure, so that other events form no null group."""
    if category in L.CARRIERS:
        return L.CARRIERS[category]
    if measure == "totalTokens":
        return "llm_call"
    by_latency = lookup(text, L.LATENCY_TYPES) if measure == "latencyMs" else None
    return by_latency or lookup(text, L.CALL_TYPES)


def _free(text: str) -> dict[str, Any] | None:
    measure, category, grain = lookup(text, L.MEASURES), lookup(text, L.CATEGORIES), lookup(text, L.GRAINS)
    if not measure and not mentions(text, L.COUNTING + L.COUNTED_NOUNS):
        return None
    level = "event"
    if measure in L.ROLLUP_MEASURES:
        level = "trace" if "trace" in text else "run"
    elif measure in L.SUMMED_MEASURES and mentions(text, L.PER_RUN):
        level = "run"
    if measure:
        metric, kind = _aggregate(text, measure), _measured_type(text, measure, category) if level == "event" else None
    else:
        metric, kind = _count(text)
    filters = [equals("eventType", kind)] if kind else []
    failed, succeeded = mentions(text, L.FAILED), mentions(text, L.SUCCEEDED)
    if failed != succeeded:
        filters.append(equals("status" if level == "event" else "outcome", "failed" if failed else "success"))
    plan: dict[str, Any] = {
        "level": level,
        "metric": metric,
        "dimensions": [*([category] if category else []), *([{"time": grain}] if grain else [])],
        "filters": filters,
        "chartHint": "line" if grain else "bar" if category else "table",
    }
    direction = lookup(text, L.RANKINGS)
    if grain:
        plan["sort"] = {"by": "time", "dir": "asc"}
    elif category and direction:
        words = text.split()
        size = next((int(n) for opener, n in zip(words, words[1:]) if opener in L.RANKING_OPENERS and n.isdecimal()), L.DEFAULT_RANKING)
        plan |= {"sort": {"by": "metric", "dir": direction}, "limit": size}
    return plan
