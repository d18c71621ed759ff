"""Queries on agent_events by problem: P2, P3, P5 and P7, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.ids import one_per_message
from runloom.operators import features, messages, rolling, sessions
from runloom.schema import EVENT_TYPES
from runloom.sources.tables import table

# The event types of the tables, the closed seven and those of the SDK's extensions, each a subject and an action
SUBJECTS = ["budget", "cache", "claim", "consent", "draft", "export", "goal", "guard", "handoff", "memory", "plan", "prompt", "quota", "replay", "review", "route", "skill", "thread", "vote", "widget"]
ACTIONS = ["closed", "copied", "dropped", "expired", "flagged", "merged", "opened", "paused", "pinned", "queued", "renamed", "resumed", "revised", "scored", "shared", "split"]
TYPES = [*EVENT_TYPES, *[f"{subject}.{action}" for subject in SUBJECTS for action in ACTIONS]]

FEATURE_COLUMNS = ["user_id", "event_type", "timestamp", "cost_usd"]
WINDOWS = (7, 30)


def _rolling(spark: SparkSession, folder: str) -> DataFrame:
    events = one_per_message(table(spark, folder, "agent_events", spread=True), ["agent_name", "timestamp", "cost_usd"])
    return rolling.trailing_totals(events, "agent_name", "timestamp", "cost_usd", WINDOWS)


def p2_rolling_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Total and means of cost over the trailing 7 and 30 days, per agent and day."""
    rows = _rolling(spark, folder).withColumnRenamed("entity", "agent_name")
    return rows.select(
        "agent_name",
        F.date_format("day", "yyyy-MM-dd").alias("activity_day"),
        "n_day",
        *[c for w in WINDOWS for c in (F.col(f"total_{w}").cast("decimal(18,6)").alias(f"total_{w}"), F.col(f"n_{w}"), F.col(f"mean_{w}"), F.col(f"per_day_{w}"))],
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days between an agent's first and last day without a message."""
    rows = _rolling(spark, folder).where("n_day = 0")
    return rows.select(F.col("entity").alias("agent_name"), F.date_format("day", "yyyy-MM-dd").alias("activity_day"))


def p3_user_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user with count, latest time and cost of every event type of both event tables; types not in TYPES are ``other``."""
    tables = [table(spark, folder, name) for name in ("agent_events", "extension_events")]
    once = [one_per_message(t, FEATURE_COLUMNS) for t in tables]
    rows = features.feature_table(once[0].unionByName(once[1]), "user_id", "event_type", "timestamp", "cost_usd", TYPES)
    totals = {f"{name}_total": F.col(f"`{name}_total`").cast("decimal(18,6)") for name in [*TYPES, features.REST]}
    return rows.withColumns(totals).withColumnRenamed("entity", "user_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose message came before."""
    return messages.redelivered(table(spark, folder, "agent_events"))


def p5_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivered copy of every message, all columns: all rows but those that the store finds redelivered."""
    return messages.first_copies(table(spark, folder, "agent_events"))


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    events = one_per_message(table(spark, folder, "agent_events", spread=True), ["user_id", "timestamp"])
    return sessions.sessions(events, "user_id", "timestamp").withColumnRenamed("entity", "user_id")


def p7_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user with start, end, duration and message count."""
    return _sessions(spark, folder)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """User and start of every session."""
    return _sessions(spark, folder).select("user_id", "start_ms")


QUERIES = {f.__name__: f for f in (p2_found, p2_rolling_cost, p3_user_features, p5_found, p5_messages, p7_found, p7_sessions)}

KEY = "lower(replace(trim(event_id, ' ' || chr(9) || chr(10) || chr(13)), '-', ''))"


def once_sql(name: str, columns: str = "*") -> str:
    """SQL of the first delivered copy of each message."""
    return f"SELECT {columns} FROM {name} QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY delivery_seq) = 1"


_DAYS = f"""
WITH m AS ({once_sql("agent_events", "agent_name, timestamp, cost_usd")}),
cells AS (SELECT agent_name, CAST(timestamp AS DATE) AS d, count(*) AS n, count(cost_usd) AS c, coalesce(sum(cost_usd), 0) AS v FROM m GROUP BY ALL),
days AS (SELECT agent_name, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM cells GROUP BY agent_name),
filled AS (SELECT agent_name, d, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(v, 0) AS v FROM days LEFT JOIN cells USING (agent_name, d))
"""


def _window_sql(w: int) -> str:
    over = f"OVER (PARTITION BY agent_name ORDER BY d ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CAST(sum(v) {over} AS DECIMAL(18,6)) AS total_{w}, CAST(sum(c) {over} AS BIGINT) AS n_{w}, "
        f"CAST(sum(v) {over} AS DOUBLE) / nullif(sum(c) {over}, 0) AS mean_{w}, CAST(sum(v) {over} AS DOUBLE) / {w} AS per_day_{w}"
    )


def _slot_sql(name: str, where: str) -> str:
    return f'count(*) FILTER ({where}) AS "{name}_n", max(timestamp) FILTER ({where}) AS "{name}_last", CAST(sum(cost_usd) FILTER ({where}) AS DECIMAL(18,6)) AS "{name}_total"'


_SESSIONS = f"""
WITH m AS ({once_sql("agent_events", "user_id, timestamp")}),
s AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM m),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS no FROM s),
x AS (SELECT user_id, epoch_ms(min(timestamp)) AS start_ms, epoch_ms(max(timestamp)) AS end_ms, epoch_ms(max(timestamp)) - epoch_ms(min(timestamp)) AS duration_ms, count(*) AS n_events FROM g GROUP BY user_id, no)
"""

SQL = {
    "p2_rolling_cost": _DAYS + f"SELECT agent_name, strftime(d, '%Y-%m-%d') AS activity_day, n AS n_day, {', '.join(map(_window_sql, WINDOWS))} FROM filled",
    "p2_found": _DAYS + "SELECT agent_name, strftime(d, '%Y-%m-%d') AS activity_day FROM filled WHERE n = 0",
    "p3_user_features": f"""
WITH m AS (SELECT user_id, event_type, timestamp, cost_usd FROM ({once_sql("agent_events")})
  UNION ALL SELECT user_id, event_type, timestamp, cost_usd FROM ({once_sql("extension_events")}))
SELECT user_id, {", ".join(_slot_sql(name, f"event_type = '{name}'") for name in TYPES)},
  {_slot_sql(features.REST, "event_type IS NULL OR event_type NOT IN (" + ", ".join(f"'{name}'" for name in TYPES) + ")")} FROM m WHERE user_id IS NOT NULL GROUP BY user_id""",
    "p5_found": f"SELECT delivery_seq FROM agent_events QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY delivery_seq) > 1",
    "p5_messages": once_sql("agent_events"),
    "p7_found": _SESSIONS + "SELECT user_id, start_ms FROM x",
    "p7_sessions": _SESSIONS + "SELECT user_id, start_ms, end_ms, duration_ms, n_events FROM x",
}
