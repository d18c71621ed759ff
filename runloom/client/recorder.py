"""Client for applications: traces, runs and events, sent in batches with retries."""

from __future__ import annotations

import json
import random
import threading
import time
import urllib.error
import urllib.request
import uuid
from collections import deque
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

#: Sends one batch; returns the HTTP status. Raising means the network failed.
Send = Callable[[list[dict]], int]


def http_sender(endpoint: str, api_key: str, timeout: float = 10.0) -> Send:
    def send(events: list[dict]) -> int:
        request = urllib.request.Request(f"{endpoint.rstrip('/')}/capture", json.dumps({"events": events}).encode(), {"content-type": "application/json", "x-api-key": api_key})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status
        except urllib.error.HTTPError as error:
            return error.code

    return send


class Recorder:
    """Queues events and sends them ``flush_at`` at a time or every ``interval`` seconds.

    A full queue drops the newest event. Network failures, 429 and 5xx are retried with growing,
    jittered pauses; other 4xx are not. What is lost is reported to ``on_error``.
    """

    def __init__(self, send: Send, flush_at: int = 50, interval: float = 5.0, max_batch: int = 500, max_queue: int = 100_000, retries: int = 3, pause: float = 0.2, on_error: Callable[[Exception], None] | None = None, sleep: Callable[[float], None] = time.sleep, start_timer: bool = True):
        self._send, self._flush_at, self._interval, self._max_batch, self._max_queue = send, flush_at, interval, max_batch, max_queue
        self._retries, self._pause, self._on_error, self._sleep = retries, pause, on_error or (lambda error: None), sleep
        self._queue: deque[dict] = deque()
        self._sending = threading.Lock()
        self._stop = threading.Event()
        if start_timer:
            threading.Thread(target=self._tick, daemon=True).start()

    def _tick(self) -> None:
        while not self._stop.wait(self._interval):
            self.flush()

    def record(self, event: dict) -> None:
        if len(self._queue) >= self._max_queue:
            self._on_error(OverflowError("the queue is full; the event is dropped"))
            return
        self._queue.append(event)
        if len(self._queue) >= self._flush_at:
            self.flush()

    def flush(self) -> None:
        """Send all that is queued; one sender at a time."""
        with self._sending:
            while self._queue:
                batch = [self._queue.popleft() for _ in range(min(self._max_batch, len(self._queue)))]
                try:
                    self._deliver(batch)
                except Exception as error:  # noqa: BLE001 - an application must not fail for its telemetry
                    self._on_error(error)

    def _deliver(self, batch: list[dict]) -> None:
        for attempt in range(self._retries + 1):
            try:
                status: int | None = self._send(batch)
            except OSError:
                status = None
            if status is not None and 200 <= status < 300:
                return
            if status is not None and status != 429 and status < 500:
                raise RuntimeError(f"the server refused {len(batch)} events with status {status}")
            if attempt < self._retries:
                self._sleep(self._pause * 2**attempt + random.uniform(0, self._pause))
        raise RuntimeError(f"{len(batch)} events could not be sent")

    def shutdown(self) -> None:
        self._stop.set()
        self.flush()

    def start_trace(self, agent: str, user: str, metadata: dict[str, Any] | None = None) -> Trace:
        return Trace(self, agent, user, metadata or {})

    def start_run(self, agent: str, user: str, prompt: str = "", metadata: dict[str, Any] | None = None) -> Run:
        """A run in a trace of its own."""
        return self.start_trace(agent, user, metadata).start_run(prompt)


class Trace:
    def __init__(self, recorder: Recorder, agent: str, user: str, metadata: dict[str, Any]):
        self.recorder, self.agent, self.user, self.metadata = recorder, agent, user, metadata
        self.trace_id = str(uuid.uuid4())

    def start_run(self, prompt: str = "") -> Run:
        return Run(self, prompt)

    def end(self) -> None:
        """A trace ends with its last run; nothing is sent."""


class Run:
    """Events of one run, numbered from 0 in the order of their capture."""

    def __init__(self, trace: Trace, prompt: str):
        self.trace, self.run_id, self._step, self._ended = trace, str(uuid.uuid4()), 0, False
        self._emit("run_started", status="running", input=prompt)

    def _emit(self, kind: str, metadata: dict[str, Any] | None = None, **fields: Any) -> None:
        now = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        envelope = {
            "eventId": str(uuid.uuid4()), "traceId": self.trace.trace_id, "runId": self.run_id, "eventType": kind, "timestamp": now, "agentName": self.trace.agent, "userId": self.trace.user,
            "stepIndex": self._step, "metadata": {**self.trace.metadata, **(metadata or {})},
        }
        self._step += 1
        self.trace.recorder.record(envelope | {k: v for k, v in fields.items() if v is not None})

    def llm_call(self, model: str, latency_ms: float, input_tokens: int, output_tokens: int, cost_usd: float, status: str = "success", metadata: dict | None = None) -> None:
        self._emit("llm_call", metadata, model=model, status=status, latencyMs=latency_ms, inputTokens=input_tokens, outputTokens=output_tokens, costUsd=cost_usd)

    def tool_call(self, tool: str, latency_ms: float, status: str = "success", cost_usd: float | None = None, metadata: dict | None = None) -> None:
        self._emit("tool_call", metadata, toolName=tool, status=status, latencyMs=latency_ms, costUsd=cost_usd)

    def step(self, latency_ms: float | None = None, metadata: dict | None = None) -> None:
        self._emit("step_completed", metadata, latencyMs=latency_ms)

    def error(self, error_type: str, tool: str | None = None, message: str | None = None, latency_ms: float | None = None, metadata: dict | None = None) -> None:
        self._emit("error", metadata, status="failed", errorType=error_type, toolName=tool, message=message, latencyMs=latency_ms)

    def retry(self, attempt: int, tool: str | None = None, status: str | None = None, latency_ms: float | None = None, metadata: dict | None = None) -> None:
        self._emit("retry", metadata, attempt=attempt, toolName=tool, status=status, latencyMs=latency_ms)

    def end(self, status: str = "success", output: str | None = None) -> None:
        """The terminal event; later calls do nothing."""
        if not self._ended:
            self._ended = True
            self._emit("run_completed", status=status, output=output)
