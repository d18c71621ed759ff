"""Wire events: validation, partial acceptance and projection to stored rows.

Everything stays in the JVM: a message is parsed once as a variant, each field is taken from it once,
each rule is a column that is null or an error text, and the rules of all event types are one table.
``check`` reads the same table for the few events of one request, without a job.
"""

from __future__ import annotations

import re
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.schema import EVENT_TYPES, EVENTS, MONEY

# The fields of a wire event, by kind. "?" marks an optional field.
ENVELOPE = {"eventId": "id", "traceId": "id", "runId": "id", "timestamp": "instant", "agentName": "id", "userId": "id", "stepIndex": "count", "metadata": "object?"}
VARIANTS = {
    "run_started": {"status": "running", "input": "text"},
    "llm_call": {"model": "id", "status": "result", "latencyMs": "amount", "inputTokens": "count", "outputTokens": "count", "costUsd": "amount"},
    "tool_call": {"toolName": "id", "status": "result", "latencyMs": "amount", "costUsd": "amount?"},
    "step_completed": {"latencyMs": "amount?"},
    "error": {"status": "failed", "errorType": "id", "toolName": "id?", "message": "text?", "latencyMs": "amount?"},
    "retry": {"attempt": "positive", "toolName": "id?", "status": "result?", "latencyMs": "amount?"},
    "run_completed": {"status": "result", "output": "text?"},
}
WORDS = {"running": ["running"], "failed": ["failed"], "result": ["success", "failed"]}
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$"


FIELDS = sorted({*ENVELOPE, *(f for own in VARIANTS.values() for f in own)})
NUMBERS = ["attempt", "costUsd", "inputTokens", "latencyMs", "outputTokens", "stepIndex"]


def _instant(column: Column) -> Column:
    """UTC wall time to the millisecond of an ISO text with offset."""
    return F.date_trunc("millisecond", F.try_to_timestamp(column)).cast("timestamp_ntz")


def _part(name: str) -> Column:
    """Of a number its value (null if it is none) and whether it is there; else type (null if absent) and text."""
    field = F.col(f"fields.{name}")
    if name in NUMBERS:
        return F.struct(field.alias("number"), F.array_contains("keys", name).alias("given")).alias(name)
    return F.struct(F.schema_of_variant(field).alias("type"), F.try_variant_get(field, "$", "string").alias("text")).alias(name)


def _good(name: str, base: str) -> tuple[Column, str]:
    """Whether a field that is there has its kind, and the kind's description."""
    if name in NUMBERS:
        value = F.col(f"parts.{name}.number")
        whole = value == F.floor(value)
        return {
            "count": (whole & (value >= 0), "a whole number of at least 0"),
            "positive": (whole & (value > 0), "a whole number of at least 1"),
            "amount": (value >= 0, "a number of at least 0"),
        }[base]
    kind, text = F.col(f"parts.{name}.type"), F.col(f"parts.{name}.text")
    if base in WORDS:
        return (kind == "STRING") & text.isin(WORDS[base]), f"one of {', '.join(WORDS[base])}"
    return {
        "id": ((kind == "STRING") & (F.length(text) > 0), "a non-empty text"),
        "text": (kind == "STRING", "a text"),
        "instant": ((kind == "STRING") & text.rlike(INSTANT) & _instant(text).isNotNull(), "an ISO-8601 instant with offset"),
        "object": (kind.startswith("OBJECT"), "an object"),
    }[base]


def _problem(name: str) -> Column:
    """Null, or what is wrong with a field, given the event type."""
    kind, absent = F.col("kind"), ~F.col(f"parts.{name}.given") if name in NUMBERS else F.col(f"parts.{name}.type").isNull()
    uses: dict[str, list[str]] = {}
    for variant, own in VARIANTS.items():
        if rule := {**ENVELOPE, **own}.get(name):
            uses.setdefault(rule, []).append(variant)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    if required := [v for rule, variants in uses.items() if not rule.endswith("?") for v in variants]:
        out = out.when(absent & kind.isin(required), F.lit(f"{name}: required"))
    by_base: dict[str, list[str]] = {}
    for rule, variants in uses.items():
        by_base.setdefault(rule.rstrip("?"), []).extend(variants)
    for base, variants in by_base.items():
        good, what = _good(name, base)
        out = out.when(~absent & kind.isin(variants) & ~F.coalesce(good, F.lit(False)), F.lit(f"{name}: expected {what}"))
    return out


def validate(messages: DataFrame, body: str = "body") -> DataFrame:
    """``messages`` with ``kind``, ``parts`` (of each field) and ``problems`` (empty if accepted).

    Unknown fields are problems, as are fields of another event type. Null and empty bodies are no JSON.
    """
    others = [c for c in messages.columns if c not in ("kind", "parts", "problems", "fields", "keys", "broken")]
    # one parse of the text; a field of another type than double is null, and so is the whole of broken JSON
    schema = ", ".join(f"{f} {'double' if f in NUMBERS else 'variant'}" for f in ("eventType", *FIELDS))
    parsed = messages.select(*others, F.from_json(body, schema).alias("fields"), F.json_object_keys(body).alias("keys"))
    broken = F.col("keys").isNull() | F.col("fields").isNull()
    # the explode of one element keeps the optimiser from copying the parts into every rule that reads them
    named = parsed.select(*others, broken.alias("broken"), F.try_variant_get("fields.eventType", "$", "string").alias("kind"), F.explode(F.array(F.struct(*[_part(f) for f in FIELDS]))).alias("parts"), "keys")
    allowed = F.when(F.lit(False), F.array().cast("array<string>"))
    for variant, own in VARIANTS.items():
        allowed = allowed.when(F.col("kind") == variant, F.array(*[F.lit(f) for f in ("eventType", *ENVELOPE, *own)]))
    unknown = F.array_sort(F.array_except("keys", allowed))
    rules = [_problem(f) for f in FIELDS] + [F.when(F.size(unknown) > 0, F.concat(F.lit("unrecognised: "), F.array_join(unknown, ", ")))]
    problems = (
        F.when(F.col("broken"), F.array(F.lit("body: not a JSON object")))
        .when(~F.coalesce(F.col("kind").isin(EVENT_TYPES), F.lit(False)), F.array(F.lit(f"eventType: expected one of {', '.join(EVENT_TYPES)}")))
        .otherwise(F.filter(F.array(*rules), lambda x: x.isNotNull()))
    )
    return named.select(*others, "kind", "parts", F.explode(F.array(problems)).alias("problems"))


def _is_instant(text: str) -> bool:
    if not re.fullmatch(INSTANT[1:-1], text, re.ASCII):
        return False
    whole, fraction, offset = re.fullmatch(r"(.{19})(\.\d+)?(.+)", text).groups()
    try:
        datetime.fromisoformat(f"{whole.upper()}{(fraction or '')[:7]}{'+00:00' if offset in 'Zz' else offset}")
    except ValueError:
        return False
    return True


def _fault(base: str, value: Any) -> str | None:
    """What a value that is there should have been, or None."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool) and value == value
    whole = number and value == value // 1
    text = isinstance(value, str)
    good, what = {
        "count": (whole and value >= 0, "a whole number of at least 0"),
        "positive": (whole and value > 0, "a whole number of at least 1"),
        "amount": (number and value >= 0, "a number of at least 0"),
        "id": (text and value != "", "a non-empty text"),
        "text": (text, "a text"),
        "instant": (text and _is_instant(value), "an ISO-8601 instant with offset"),
        "object": (isinstance(value, dict), "an object"),
        **{word: (text and value in allowed, f"one of {', '.join(allowed)}") for word, allowed in WORDS.items()},
    }[base]
    return None if good else f"expected {what}"


def check(event: Any) -> list[str]:
    """The problems that ``validate`` finds in one message, in the same words; empty if it is accepted."""
    if not isinstance(event, dict):
        return ["body: not a JSON object"]
    kind = event.get("eventType")
    if kind not in EVENT_TYPES:
        return [f"eventType: expected one of {', '.join(EVENT_TYPES)}"]
    rules = {**ENVELOPE, **VARIANTS[kind]}
    problems = []
    for name in sorted(rules):
        if name in event:
            fault = _fault(rules[name].rstrip("?"), event[name])
            problems += [f"{name}: {fault}"] if fault else []
        elif not rules[name].endswith("?"):
            problems.append(f"{name}: required")
    unknown = sorted(set(event) - set(rules) - {"eventType"})
    return problems + ([f"unrecognised: {', '.join(unknown)}"] if unknown else [])


def accepted(validated: DataFrame, project: Column) -> DataFrame:
    """Stored rows of the accepted messages, with all other columns of ``validated``."""
    text, number = (lambda f: F.col(f"parts.{f}.text")), (lambda f: F.col(f"parts.{f}.number"))
    values = {
        "event_id": text("eventId"),
        "trace_id": text("traceId"),
        "run_id": text("runId"),
        "project_id": project,
        "event_type": F.col("kind"),
        "timestamp": _instant(text("timestamp")),
        "agent_name": text("agentName"),
        "user_id": text("userId"),
        "step_index": number("stepIndex").cast("int"),
        "model": text("model"),
        "tool_name": text("toolName"),
        "status": text("status"),
        "error_type": text("errorType"),
        "latency_ms": number("latencyMs"),
        "input_tokens": number("inputTokens").cast("long"),
        "output_tokens": number("outputTokens").cast("long"),
        "cost_usd": F.round(number("costUsd"), MONEY.scale).cast(MONEY),
        "metadata": F.coalesce(text("metadata"), F.lit("{}")),
    }
    others = [c for c in validated.columns if c not in values and c not in ("kind", "parts", "problems", "input", "output")]
    rows = validated.where(F.size("problems") == 0)
    return rows.select(*[values[f.name].alias(f.name) for f in EVENTS], *others, text("input").alias("input"), text("output").alias("output"))


def rejected(validated: DataFrame, position: str) -> DataFrame:
    """``(event_id, error)`` of the rejected messages; without an id, ``index:<position>``."""
    name = F.coalesce(F.nullif(F.col("parts.eventId.text"), F.lit("")), F.concat(F.lit("index:"), F.col(position)))
    return validated.where(F.size("problems") > 0).select(name.alias("event_id"), F.array_join("problems", "; ").alias("error"))


def summary(validated: DataFrame) -> DataFrame:
    """One row ``(accepted, duplicates, rejected)``; duplicates are found later, at the store."""
    return validated.agg(F.count_if(F.size("problems") == 0).alias("accepted"), F.lit(0).cast("long").alias("duplicates"), F.count_if(F.size("problems") > 0).alias("rejected"))


def flat_to_wire(flat: DataFrame) -> DataFrame:
    """Wire bodies from the flat binary transport's columns: ``body`` and all other columns.

    Fields that the event type lacks are dropped. Missing values default as that transport's do:
    step 0, status success, and for calls latency, tokens and cost 0; attempt 1; bad metadata {}.
    """
    names = {
        "event_id": "string", "trace_id": "string", "run_id": "string", "event_type": "string", "timestamp": "string", "agent_name": "string", "user_id": "string", "step_index": "long",
        "model": "string", "tool_name": "string", "status": "string", "error_type": "string", "latency_ms": "double", "input_tokens": "long", "output_tokens": "long", "cost_usd": "double",
        "attempt": "long", "message": "string", "input": "string", "output": "string", "metadata_json": "string",
    }
    have = {c.lower() for c in flat.columns}
    col = {n: (F.col(n) if n in have else F.lit(None)).cast(t) for n, t in names.items()}
    kind = F.lower(col["event_type"])
    text = lambda n: F.coalesce(col[n], F.lit(""))
    given = lambda n: F.nullif(col[n], F.lit(""))
    calls = kind.isin("llm_call", "tool_call")
    only = lambda *kinds: kind.isin(*kinds)
    tags = F.try_parse_json(col["metadata_json"])
    fields = {
        "eventId": text("event_id"),
        "traceId": text("trace_id"),
        "runId": text("run_id"),
        "timestamp": text("timestamp"),
        "agentName": text("agent_name"),
        "userId": text("user_id"),
        "stepIndex": F.coalesce(col["step_index"], F.lit(0)),
        "eventType": kind,
        "metadata": F.coalesce(F.when(F.schema_of_variant(tags).startswith("OBJECT"), tags), F.parse_json(F.lit("{}"))),
        "model": F.when(only("llm_call"), text("model")),
        "toolName": F.when(only("tool_call"), text("tool_name")).when(only("error", "retry"), given("tool_name")),
        "status": F.when(only("run_started"), "running").when(only("error"), "failed").when(only("llm_call", "tool_call", "run_completed"), F.coalesce(given("status"), F.lit("success"))).when(only("retry"), given("status")),
        "errorType": F.when(only("error"), text("error_type")),
        "latencyMs": F.when(calls, F.coalesce(col["latency_ms"], F.lit(0.0))).when(only("step_completed", "error", "retry"), col["latency_ms"]),
        "inputTokens": F.when(only("llm_call"), F.coalesce(col["input_tokens"], F.lit(0))),
        "outputTokens": F.when(only("llm_call"), F.coalesce(col["output_tokens"], F.lit(0))),
        "costUsd": F.when(only("llm_call"), F.coalesce(col["cost_usd"], F.lit(0.0))).when(only("tool_call"), col["cost_usd"]),
        "attempt": F.when(only("retry"), F.coalesce(col["attempt"], F.lit(1))),
        "message": F.when(only("error"), given("message")),
        "input": F.when(only("run_started"), text("input")),
        "output": F.when(only("run_completed"), given("output")),
    }
    others = [c for c in flat.columns if c.lower() not in names]
    return flat.select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("body"), *others)
