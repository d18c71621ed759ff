"""Questions to validated plans: tables first, an injected model only for what they do not cover."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any, Protocol

from runloom.plans import lexicon as L
from runloom.plans.model import Plan, PlanError
from runloom.plans.questions import propose
from runloom.plans.time_phrases import Window, parse_window


class ModelPlanner(Protocol):
    """Port for a language model that proposes plans. Its output is untrusted. None ships with the library."""

    def available(self) -> bool: ...

    def plan(self, question: str, window: Window) -> Any: ...


@dataclass(frozen=True)
class Answered:
    plan: Plan
    origin: str


@dataclass(frozen=True)
class Rejected:
    reason: str
    supported: tuple[str, ...] = tuple(L.SUPPORTED)


def _wire(window: Window) -> dict[str, str]:
    start, end = (t.isoformat(timespec="milliseconds") + "+00:00" for t in window)
    return {"from": start, "to": end}


def plan_question(question: str, now: datetime | None = None, window: Window | None = None, model: ModelPlanner | None = None, days: int = L.DEFAULT_DAYS) -> Answered | Rejected:
    """Never raises on what a question or a model says.

    The window is the question's own, else ``window``, else the last ``days``. Times are UTC wall time.
    """
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    chosen = parse_window(question, now) or window or (now - timedelta(days=days), now)
    proposal, origin = propose(question), "deterministic"
    if proposal is None:
        if model is None or not model.available():
            return Rejected("The question is not understood, and no language model is available.")
        try:
            proposal, origin = model.plan(question, chosen), "llm"
        except Exception:  # noqa: BLE001 - whatever a model's client raises
            return Rejected("The question is not understood: the language model failed.")
    if isinstance(proposal, dict) and proposal.get("timeRange") is None:
        proposal = {**proposal, "timeRange": _wire(chosen)}
    try:
        return Answered(Plan.parse(proposal), origin)
    except PlanError as error:
        return Rejected(f"The question maps to no supported query: {error}")
