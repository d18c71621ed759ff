"""The three sources as temporary views, for Spark SQL."""

from __future__ import annotations

from runloom.operators import rollups
from runloom.schema import EVENTS
from runloom.sources.events import EventSource


def create_views(source: EventSource, prefix: str = "") -> list[str]:
    """``events``, ``runs`` and ``traces`` (with ``prefix``), one row per message, run and trace; replaces views of these names."""
    run_rows = source.run_rows()
    frames = {"events": source.read([f.name for f in EVENTS]), "runs": run_rows, "traces": rollups.traces(run_rows)}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in frames]
