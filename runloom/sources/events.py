"""The event store as a source: one copy of each message, reading only what a query needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from runloom.functions.ids import one_per_message
from runloom.operators import rollups

#: Copies of a message may differ in these, so filters on them cannot run before copies collapse.
COPY_COLUMNS = {"event_id", "metadata", "delivery_seq", "batch_id", "received_at"}


@dataclass
class EventSource:
    """``rows`` as delivered, or, with ``order_column`` None, already one row per message.

    ``runs``: their stored rollups, if there are any (``RollupStore``); else they are made on read.
    """

    rows: DataFrame
    id_column: str = "event_id"
    order_column: str | None = "delivery_seq"
    runs: DataFrame | None = None

    def run_rows(self, where: Column | None = None) -> DataFrame:
        """Run rollups; ``where`` may use project, run and trace."""
        if self.runs is not None:
            return self.runs if where is None else self.runs.where(where)
        return rollups.runs(self.read(rollups.RUN_INPUTS, where))

    def read(self, columns: list[str], where: Column | None = None) -> DataFrame:
        """``columns`` of the first delivered copy of each message that satisfies ``where``.

        ``where`` must not use COPY_COLUMNS: it runs below the de-duplication, where it reaches the
        scan. Only ``columns`` and the two keys are read.
        """
        rows = self.rows if where is None else self.rows.where(where)
        wanted = list(dict.fromkeys(columns)) or [self.id_column]
        if self.order_column is None:
            return rows.select(*wanted)
        return one_per_message(rows, wanted, self.id_column, self.order_column)
