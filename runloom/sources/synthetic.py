"""Seeded synthetic traces, made in parallel: each trace depends on the seed and its number only."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta
from uuid import UUID

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from runloom.schema import EVENTS

MODELS = {"nimbus-l": (1400.0, 12e-6), "nimbus-s": (600.0, 2e-6), "strata-2": (900.0, 6e-6), "quill": (400.0, 1e-6)}
TOOLS = ["search", "fetch", "run_code", "query_db", "send_mail"]
AGENTS = {"researcher": 0.15, "coder": 0.25, "support": 0.1, "analyst": 0.2}
ERRORS = ["rate_limit", "timeout", "bad_input", "auth", "not_found", "internal"]


def trace_events(seed: int, number: int, start: datetime, days: int, users: int = 200) -> list[dict]:
    """The events of one trace: one run, and a second one for most failed first runs."""
    rng = np.random.default_rng([seed, number])
    agent = str(rng.choice(list(AGENTS)))
    at = start + timedelta(seconds=float(rng.uniform(0, days * 86_400)))
    user = f"user_{int(users * rng.uniform() ** 2):04d}"
    rows: list[dict] = []
    for attempt in range(2):
        failed = rng.uniform() < AGENTS[agent]
        step = 0

        def emit(kind: str, **fields: object) -> None:
            nonlocal step, at
            at += timedelta(milliseconds=float(fields.get("latency_ms") or rng.uniform(5, 60)))
            rows.append(
                {
                    "event_id": str(UUID(bytes=rng.bytes(16))), "trace_id": f"trace_{seed}_{number}", "run_id": f"run_{seed}_{number}_{attempt}", "project_id": "proj_dev", "event_type": kind,
                    "timestamp": at.replace(microsecond=at.microsecond // 1000 * 1000), "agent_name": agent, "user_id": user, "step_index": step, "metadata": json.dumps({"attempt": attempt}), **fields,
                }
            )
            step += 1

        emit("run_started", status="running")
        turns = int(rng.integers(1, 6))
        fatal = int(rng.integers(0, turns)) if failed else -1
        for turn in range(turns):
            model = str(rng.choice(list(MODELS)))
            usual, price = MODELS[model]
            tokens = (int(rng.integers(100, 3000)), int(rng.integers(20, 800)))
            emit("llm_call", model=model, status="success", latency_ms=round(float(rng.gamma(2.0, usual / 2)), 2), input_tokens=tokens[0], output_tokens=tokens[1], cost_usd=round(sum(tokens) * price, 6))
            if rng.uniform() < 0.7:
                tool = str(rng.choice(TOOLS))
                for _ in range(int(rng.integers(1, 4)) if rng.uniform() < 0.1 else 0):
                    emit("retry", tool_name=tool, status="failed", latency_ms=round(float(rng.uniform(20, 400)), 2))
                emit("tool_call", tool_name=tool, status="failed" if turn == fatal else "success", latency_ms=round(float(rng.gamma(2.0, 300.0)), 2))
            if turn == fatal:
                emit("error", status="failed", error_type=str(rng.choice(ERRORS)))
                break
            if rng.uniform() < 0.4:
                emit("step_completed")
        emit("run_completed", status="failed" if failed else "success")
        if not failed or rng.uniform() > 0.6:
            break
    return rows


def synthetic_events(spark: SparkSession, traces: int, seed: int = 1, start: datetime = datetime(2026, 6, 1), days: int = 7, partitions: int | None = None) -> DataFrame:
    """Stored event rows of ``traces`` traces; the same seed gives the same rows on any cluster."""
    names = [f.name for f in EVENTS]

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for frame in frames:
            for part in range(0, len(frame), 500):
                rows = [e for number in frame["id"].iloc[part : part + 500] for e in trace_events(seed, int(number), start, days)]
                out = pd.DataFrame(rows).reindex(columns=names)
                for name in ("input_tokens", "output_tokens"):
                    out[name] = out[name].astype("Int64")
                out["cost_usd"] = [None if x != x or x is None else Decimal(str(x)) for x in out["cost_usd"]]
                yield out.astype(object).where(out.notna(), None)

    return spark.range(0, traces, 1, partitions or max(1, min(traces // 2000 + 1, 10_000))).mapInPandas(make, EVENTS)
