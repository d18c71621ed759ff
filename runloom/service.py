"""The engine behind one object, and a thin HTTP front of the standard library.

``GET /health``, ``POST /capture`` (header x-api-key), ``POST /query``, ``GET /traces``, ``GET /traces/<id>``.
"""

from __future__ import annotations

import json
from dataclasses import asdict, replace
from datetime import datetime
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession

from runloom.operators import explorer
from runloom.plans.compiler import compile_plan, to_rows
from runloom.plans.model import parse_instant
from runloom.plans.planner import ModelPlanner, Rejected, plan_question
from runloom.streaming import wire
from runloom.streaming.ingest import Backpressure, Ingestor, Landing
from runloom.streaming.payloads import hydrate

DEFAULT_PROJECT = "proj_dev"
Answer = tuple[int, Any]


#: Traces on a page, and rows of an answer, at most.
MAX_PAGE = 500
MAX_ROWS = 10_000


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def _wire(value: Any) -> Any:
    if isinstance(value, datetime):
        return value.isoformat(timespec="milliseconds") + "Z"
    return float(value) if isinstance(value, Decimal) else value


def _json(frame: DataFrame) -> list[dict]:
    """Rows in the form of the wire: camel case, ISO times, numbers, metadata as an object. For bounded frames: a page, a trace."""
    rows = []
    for row in frame.collect():
        out = {_camel(k): _wire(v) for k, v in row.asDict().items()}
        if "metadata" in out:
            out["metadata"] = json.loads(out["metadata"] or "{}")
        rows.append(out)
    return rows


class Service:
    """``keys``: API key -> project."""

    def __init__(self, spark: SparkSession, ingestor: Ingestor, landing: Landing, keys: dict[str, str], model: ModelPlanner | None = None, project: str = DEFAULT_PROJECT):
        self.spark, self.ingestor, self.landing, self.keys, self.model, self.project = spark, ingestor, landing, keys, model, project

    def capture(self, key: str | None, body: Any) -> Answer:
        """202 with counts and the rejected events; valid ones are queued. No job runs."""
        project = self.keys.get(key or "")
        if project is None:
            return 401, {"error": "unknown API key"}
        events = body.get("events") if isinstance(body, dict) else None
        if not isinstance(events, list):
            return 400, {"error": "events must be a list"}
        problems = [wire.check(e) for e in events]
        bad = [{"eventId": (e.get("eventId") if isinstance(e, dict) else None) or f"index:{i}", "status": "rejected", "error": "; ".join(p)} for i, (e, p) in enumerate(zip(events, problems)) if p]
        good = [json.dumps(e) for e, p in zip(events, problems) if not p]
        try:
            self.landing.put(project, good)
        except Backpressure:
            return 429, {"error": "too many events wait", "retryAfter": 1}
        return 202, {"accepted": len(good), "duplicates": 0, "rejected": len(bad), "results": bad}

    def query(self, body: Any) -> Answer:
        if not isinstance(body, dict) or not isinstance(body.get("q"), str) or not body["q"].strip():
            return 400, {"error": "q is required"}
        window = None
        if body.get("timeRange"):
            try:
                window = parse_instant(body["timeRange"]["from"]), parse_instant(body["timeRange"]["to"])
            except (TypeError, KeyError, ValueError):
                return 400, {"error": "timeRange needs from and to"}
        answer = plan_question(body["q"], window=window, model=self.model)
        if isinstance(answer, Rejected):
            return 400, {"ok": False, "reason": answer.reason, "supported": list(answer.supported)}
        limit = body.get("limit")
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
            return 400, {"error": "limit must be a positive whole number"}
        compiled = compile_plan(self.ingestor.store.source(), answer.plan, self.project, limit)
        rows = to_rows(replace(compiled, frame=compiled.frame.limit(MAX_ROWS + 1)))
        return 200, {"ok": True, "source": answer.origin, "result": {"columns": [asdict(c) for c in compiled.columns], "rows": rows[:MAX_ROWS], "truncated": len(rows) > MAX_ROWS, "chartHint": compiled.chart}}

    def traces(self, params: dict[str, str]) -> Answer:
        try:
            when = {k: parse_instant(params[k]) if k in params else None for k in ("from", "to")}
            limit, offset = int(params.get("limit", 50)), int(params.get("offset", 0))
        except (TypeError, ValueError):
            return 400, {"error": "from and to must be instants, limit and offset whole numbers"}
        if not 1 <= limit <= MAX_PAGE or offset < 0:
            return 400, {"error": f"limit must lie within 1 and {MAX_PAGE}, and offset not be negative"}
        wanted = explorer.TraceFilter(when["from"], when["to"], *(params.get(k) for k in ("agentName", "status", "model", "toolName", "userId")))
        return 200, _json(explorer.list_traces(self.ingestor.store.source(), self.project, wanted, limit, offset))

    def trace(self, trace_id: str) -> Answer:
        detail = explorer.trace_detail(self.ingestor.store.source(), self.project, trace_id)
        found = _json(detail.trace)
        if not found:
            return 404, {"error": "no such trace"}
        # the lookup of the texts does not keep the order
        events = hydrate(detail.events, self.ingestor.payloads()).orderBy("step_index", "timestamp", "event_id")
        return 200, {**found[0], "runs": _json(detail.runs), "events": _json(events)}

    def handle(self, method: str, target: str, headers: dict[str, str], body: bytes) -> Answer:
        url = urlparse(target)
        params = {k: v[-1] for k, v in parse_qs(url.query).items()}
        try:
            parsed = json.loads(body) if body else None
        except ValueError:
            return 400, {"error": "the body is not JSON"}
        if (method, url.path) == ("GET", "/health"):
            return 200, {"ok": True}
        if (method, url.path) == ("POST", "/capture"):
            return self.capture(headers.get("x-api-key"), parsed)
        if (method, url.path) == ("POST", "/query"):
            return self.query(parsed)
        if (method, url.path) == ("GET", "/traces"):
            return self.traces(params)
        if method == "GET" and url.path.startswith("/traces/"):
            return self.trace(url.path.removeprefix("/traces/"))
        return 404, {"error": "no such path"}


def serve(service: Service, port: int = 8080) -> ThreadingHTTPServer:
    """A server for one machine; run ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            length = int(self.headers.get("content-length") or 0)
            status, answer = service.handle(self.command, self.path, {k.lower(): v for k, v in self.headers.items()}, self.rfile.read(length))
            data = json.dumps(answer, default=str).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            if status == 429:
                self.send_header("retry-after", "1")
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
