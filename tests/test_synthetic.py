from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import rollups
from runloom.schema import EVENT_TYPES, EVENTS
from runloom.sources.synthetic import synthetic_events


def test_seeded_traces(spark):
    rows = synthetic_events(spark, 60, seed=3, partitions=3)
    assert rows.schema == EVENTS
    again = synthetic_events(spark, 60, seed=3, partitions=7)
    assert rows.exceptAll(again).count() == 0 and again.exceptAll(rows).count() == 0
    assert synthetic_events(spark, 60, seed=4).exceptAll(rows).count() > 0
    assert {r[0] for r in rows.select("event_type").distinct().collect()} == set(EVENT_TYPES)
    runs = rollups.runs(rows)
    assert {r[0] for r in runs.select("outcome").distinct().collect()} == {"success", "failed"}
    assert runs.groupBy("trace_id").count().where("count > 1").count() > 0
    assert rows.groupBy("run_id").agg((F.max("step_index") + 1 - F.count("*")).alias("gap")).where("gap <> 0").count() == 0
