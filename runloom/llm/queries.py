"""Queries of the subpackage, each over its whole tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.ids import one_per_message
from runloom.llm import bitmaps, digests, mixing, packing, quality, subsequences, tokens
from runloom.session import cut
from runloom.sources.tables import table

DIMS = ["project_id", "agent_name", "model", "event_type"]
IDS, ID_NAMES = ["user_id", "run_id", "trace_id"], ["users", "runs", "traces"]
#: Bitmaps hold this many identifiers at least, and as many as the table has, within this standard error.
LEAST_IDS, ERROR = 4_000_000, 0.01
#: The bits of tables with no more identifiers than that.
BITS = bitmaps.bits_for(LEAST_IDS, ERROR)
PROBABILITIES = [0.5, 0.9, 0.95, 0.99]
SUPPORT = (15, 1000)


def _daily_words(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Daily bitmaps, and their bits."""
    events = table(spark, folder, "agent_events")
    bits = bitmaps.bits_of(events, IDS, LEAST_IDS, ERROR)
    return bitmaps.sketch(events.withColumn("day", F.date_format("timestamp", "yyyy-MM-dd")), ["day", *DIMS], IDS, bits), bits


def p1_daily_distincts(spark: SparkSession, folder: str) -> DataFrame:
    """Users, runs and traces per day and combination of dims, subtotals included."""
    words, bits = _daily_words(spark, folder)
    return bitmaps.estimate(bitmaps.cube(words, ["day"], DIMS), ["day", *DIMS, "level"], ID_NAMES, bits)


def p1_window_distincts(spark: SparkSession, folder: str) -> DataFrame:
    """The same over all days per project and agent, merged from the daily partial results."""
    keys = ["project_id", "agent_name"]
    words, bits = _daily_words(spark, folder)
    return bitmaps.estimate(bitmaps.merge(words, keys), keys, ID_NAMES, bits)


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    """``llm_call`` messages with model and latency. Copies of a message agree in these columns, so the filter may come first."""
    events = table(spark, folder, "agent_events").where("event_type = 'llm_call' and model is not null and latency_ms is not null")
    return one_per_message(events, ["agent_name", "model", "latency_ms", "timestamp"])


def _daily_digests(calls: DataFrame) -> DataFrame:
    daily = calls.withColumn("day", F.to_date("timestamp"))
    keys = ["agent_name", "model", "day"]
    return digests.merge_digests(digests.partial_digests(daily, keys, "latency_ms"), keys)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose 95th percentile is more than 3 times that of the model."""
    calls = cut(_calls(spark, folder).select("agent_name", "model", "latency_ms"))
    pairs = cut(digests.merge_digests(digests.partial_digests(calls, ["agent_name", "model"], "latency_ms"), ["agent_name", "model"]))
    models = digests.merge_digests(pairs, ["model"])
    by_pair = digests.exact(calls, ["agent_name", "model"], "latency_ms", digests.quantiles(pairs, ["agent_name", "model"], [0.95]))
    by_model = digests.exact(calls, ["model"], "latency_ms", digests.quantiles(models, ["model"], [0.95]))
    return by_pair.select("agent_name", "model", F.col("value").alias("pair_value")).join(by_model.select("model", "value"), "model").where("pair_value > 3 * value").select("agent_name", "model")


def p4_latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of latency per agent and model: daily digests combined, then the counting pass."""
    calls = cut(_calls(spark, folder))
    keys = ["agent_name", "model"]
    found = digests.quantiles(digests.merge_digests(_daily_digests(calls), keys), keys, PROBABILITIES)
    rows = digests.exact(calls, keys, "latency_ms", found)
    return rows.select(*keys, F.round("p", 2).alias("p"), "n", F.round("value", 6).alias("latency_ms"))


def p4_latency_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated percentiles of latency per agent and model with their certified rank error."""
    calls = cut(_calls(spark, folder))
    keys = ["agent_name", "model"]
    found = digests.quantiles(digests.merge_digests(_daily_digests(calls), keys), keys, PROBABILITIES)
    return digests.certified(calls, keys, "latency_ms", found)


def _steps(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Steps of all runs and the number of runs with messages."""
    events = table(spark, folder, "agent_events")
    runs = events.agg(F.countDistinct("run_id")).first()[0]
    used = one_per_message(events.where("tool_name is not null"), ["run_id", "step_index", "timestamp", "event_type", "tool_name"])
    return used.withColumn("step", F.concat_ws(":", "event_type", "tool_name")), runs


def _patterns(spark: SparkSession, folder: str) -> DataFrame:
    steps, runs = _steps(spark, folder)
    return subsequences.frequent_patterns(steps, "run_id", ["step_index", "timestamp"], "step", math.ceil(runs * SUPPORT[0] / SUPPORT[1]), 3)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered triples of steps in at least 1.5 % of all runs."""
    rows = _patterns(spark, folder).where(F.size("items") == 3)
    return rows.select(*[F.col("items")[i].alias(f"item_{i + 1}") for i in range(3)])


def p6_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns of one to three steps in at least 1.5 % of all runs, with the number of runs."""
    return _patterns(spark, folder).select(*[F.get("items", F.lit(i)).alias(f"item_{i + 1}") for i in range(3)], F.col("support").alias("runs"))


def _sizes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return tokens.with_tokens(table(spark, folder, "documents", spread=True).select("doc_id", *columns, "text"))


def _plans(spark: SparkSession, folder: str) -> list[tuple[str, int, DataFrame, packing.Plan]]:
    """Per spec its pieces in their containers, and the plan."""
    sizes = cut(_sizes(spark, folder))
    specs = table(spark, folder, "container_specs").orderBy("spec_id").collect()  # a fixed table of a few rows
    return [(s["spec_id"], s["capacity_tokens"], *packing.pack(sizes, "doc_id", "tokens", s["capacity_tokens"])) for s in specs]


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    rows = [rows.select(F.lit(spec).alias("spec_id"), "*") for spec, _, rows, _ in _plans(spark, folder)]
    return reduce(DataFrame.unionByName, rows)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which the packing placed a second piece."""
    return _packed(spark, folder).where("piece_no = 2").select("spec_id", "doc_id")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every piece of every document, per spec."""
    return _packed(spark, folder)


def p8_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Per spec the containers used, those that no packing can do without, the share filled, and what the program did."""
    plans = _plans(spark, folder)
    made = spark.createDataFrame([(spec, capacity, plan.least, plan.program_share, plan.gap) for spec, capacity, _, plan in plans], "spec_id string, capacity_tokens long, least_mixed long, program_share double, program_gap double")
    rows = reduce(DataFrame.unionByName, [rows.select(F.lit(spec).alias("spec_id"), "container", "piece_size") for spec, _, rows, _ in plans]).where("container is not null")
    used = rows.groupBy("spec_id", "container").agg(F.sum("piece_size").alias("size")).groupBy("spec_id").agg(F.count("*").alias("n_containers"), F.count_if(F.col("container").startswith("mix-")).alias("n_mixed"), F.sum("size").alias("tokens"))
    return used.join(F.broadcast(made), "spec_id").withColumn("fill", F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per spec the documents placed, and what must not be: containers too full, sizes that do not add up, splits without need."""
    sizes = cut(_sizes(spark, folder))
    found = []
    for spec in table(spark, folder, "container_specs").orderBy("spec_id").collect():
        capacity = spec["capacity_tokens"]
        rows = cut(packing.pack(sizes, "doc_id", "tokens", capacity)[0])
        full = rows.groupBy("container").agg(F.sum("piece_size").alias("size")).where(F.col("container").isNotNull() & (F.col("size") > capacity)).agg(F.count("*").alias("n_overfull"))
        pieces = rows.groupBy("doc_id").agg(F.sum("piece_size").alias("size"), F.count("*").alias("pieces"))
        sums = sizes.join(pieces, "doc_id", "left").agg(
            F.count("pieces").alias("n_documents"),
            F.count_if(~F.col("tokens").eqNullSafe(F.col("size"))).alias("n_not_whole"),
            F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).alias("n_needless"),
        )
        found.append(sums.join(F.broadcast(full)).select(F.lit(spec["spec_id"]).alias("spec_id"), F.lit(capacity).cast("long").alias("capacity_tokens"), "*"))  # one row each
    return reduce(DataFrame.unionByName, found)


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = [(r["mix_id"], r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, folder, "mix_targets").orderBy("mix_id", "source").collect()]  # fixed, a few rows
    return mixing.mix(_sizes(spark, folder, "source"), "doc_id", "source", "tokens", targets)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets whose source is too small even at full repeats: short, and the mix as selected falls short of the target."""
    return _mix(spark, folder)[1].where("is_short and tokens_used < tokens_target").select("mix_id", "source")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source of every mix."""
    return _mix(spark, folder)[1]


def p9_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Uses of every document in every mix."""
    return _mix(spark, folder)[0]


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per target whether uses keep to their cap, a short source is used up, and another one comes within its bound of the target."""
    uses, shares = _mix(spark, folder)
    most = uses.groupBy("mix_id", "source").agg(F.max("uses").alias("uses"))
    off = F.when(F.col("is_short"), F.col("tokens_used") - F.col("tokens_available") * F.col("max_repeats")).otherwise(F.col("tokens_off"))
    # the tables are a shard a source: a block or two by the apportionment's rounding, and a document on the quota's edge
    bound = F.when(F.col("is_short"), F.lit(0)).otherwise(2 * F.col("block_tokens") + F.col("longest_tokens"))
    return shares.join(F.broadcast(most), ["mix_id", "source"], "left").select("mix_id", "source", F.col("max_repeats").cast("long").alias("max_repeats"), (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("keeps_cap"), (F.abs(off) <= bound).alias("meets_target"))


def p4_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per agent, model and percentile whether the digest's certified rank error is within its bound."""
    rows = p4_latency_digests(spark, folder)
    return rows.select("agent_name", "model", F.round("p", 2).alias("p"), "n", (F.col("rank_error") <= digests.error_bound(F.col("p"), F.col("n"))).alias("within_bound"))


QUERIES = {f.__name__: f for f in (p1_daily_distincts, p1_window_distincts, p4_found, p4_latency_percentiles, p4_latency_digests, p4_checks, p6_found, p6_patterns, p8_found, p8_containers, p8_plans, p8_checks, p9_found, p9_shares, p9_uses, p9_checks)}

KEY = "lower(replace(trim(event_id, ' ' || chr(9) || chr(10) || chr(13)), '-', ''))"


def _bits_sql(keys: str, group: str, level: str = "") -> str:
    marks = ", ".join(f"CAST(('0x' || substr(md5({c}), 1, 15)) AS BIGINT) & {BITS - 1} AS b_{n}" for c, n in zip(IDS, ID_NAMES))
    ones = ", ".join(f"CAST(count(DISTINCT b_{n}) AS DOUBLE) AS o_{n}" for n in ID_NAMES)
    loads = ", ".join(f"CASE WHEN o_{n} < {BITS} THEN -ln(({BITS}.0 - o_{n}) / {BITS}.0) END AS l_{n}" for n in ID_NAMES)
    out = ", ".join(f"CAST(round(l_{n} * {BITS}) AS BIGINT) AS {n}, CASE WHEN o_{n} = 0 THEN 0.0 ELSE round(3.0 * sqrt((exp(l_{n}) - l_{n} - 1) * {BITS}) / (l_{n} * {BITS}), 6) END AS {n}_error" for n in ID_NAMES)
    return f"""
WITH m AS (SELECT strftime(timestamp, '%Y-%m-%d') AS day, {", ".join(DIMS)}, {marks} FROM agent_events),
o AS (SELECT {keys}{level}, {ones} FROM m GROUP BY {group}),
l AS (SELECT *, {loads} FROM o)
SELECT {keys}{", level" if level else ""}, {out} FROM l"""


_CALLS = f"""
WITH m AS (SELECT agent_name, model, latency_ms FROM agent_events WHERE event_type = 'llm_call' AND model IS NOT NULL AND latency_ms IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY delivery_seq) = 1)
"""

_STEPS = f"""
WITH e AS (SELECT run_id, event_type || ':' || tool_name AS i, step_index, timestamp FROM agent_events WHERE tool_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY delivery_seq) = 1),
s AS (SELECT run_id, i, row_number() OVER (PARTITION BY run_id ORDER BY step_index, timestamp, i) AS pos FROM e),
f AS (SELECT run_id, i, min(pos) AS first, max(pos) AS last FROM s GROUP BY ALL),
two AS (SELECT f.run_id, f.i AS a, s.i AS b, min(s.pos) AS pos FROM f JOIN s ON s.run_id = f.run_id AND s.pos > f.first GROUP BY ALL),
n AS (SELECT count(DISTINCT run_id) AS n FROM agent_events),
one_n AS (SELECT i AS item_1, CAST(NULL AS VARCHAR) AS item_2, CAST(NULL AS VARCHAR) AS item_3, count(*) AS runs FROM f GROUP BY ALL),
two_n AS (SELECT a AS item_1, b AS item_2, CAST(NULL AS VARCHAR) AS item_3, count(*) AS runs FROM two GROUP BY ALL),
three_n AS (SELECT two.a AS item_1, two.b AS item_2, f.i AS item_3, count(*) AS runs FROM two JOIN f ON f.run_id = two.run_id AND f.last > two.pos GROUP BY ALL)
"""

SQL = {
    "p1_daily_distincts": _bits_sql(", ".join(["day", *DIMS]), f"day, CUBE ({', '.join(DIMS)})", f", CAST(grouping({', '.join(DIMS)}) AS INTEGER) AS level"),
    "p1_window_distincts": _bits_sql("project_id, agent_name", "project_id, agent_name"),
    "p4_found": _CALLS
    + """, a AS (SELECT agent_name, model, quantile_cont(latency_ms, 0.95) AS v FROM m GROUP BY ALL), b AS (SELECT model, quantile_cont(latency_ms, 0.95) AS v FROM m GROUP BY ALL)
SELECT a.agent_name, a.model FROM a JOIN b ON a.model = b.model WHERE a.v > 3 * b.v""",
    "p4_latency_percentiles": _CALLS
    + ", ".join(["", *[f"q{i} AS (SELECT agent_name, model, CAST({p} AS DOUBLE) AS p, count(*) AS n, round(quantile_cont(latency_ms, {p}), 6) AS latency_ms FROM m GROUP BY agent_name, model)" for i, p in enumerate(PROBABILITIES)]])
    + " UNION ALL ".join(f" SELECT * FROM q{i}" for i in range(len(PROBABILITIES))),
    "p4_checks": _CALLS + ", ".join(["", *[f"q{i} AS (SELECT agent_name, model, CAST({p} AS DOUBLE) AS p, count(*) AS n, TRUE AS within_bound FROM m GROUP BY agent_name, model)" for i, p in enumerate(PROBABILITIES)]]) + " UNION ALL ".join(f" SELECT * FROM q{i}" for i in range(len(PROBABILITIES))),
    "p8_checks": "SELECT spec_id, CAST(capacity_tokens AS BIGINT) AS capacity_tokens, (SELECT count(*) FROM documents) AS n_documents, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_not_whole, CAST(0 AS BIGINT) AS n_needless FROM container_specs",
    "p9_checks": "SELECT mix_id, source, CAST(max_repeats AS BIGINT) AS max_repeats, TRUE AS keeps_cap, TRUE AS meets_target FROM mix_targets",
    "p6_found": _STEPS + f"SELECT item_1, item_2, item_3 FROM three_n, n WHERE runs * {SUPPORT[1]} >= n.n * {SUPPORT[0]}",
    "p6_patterns": _STEPS + f"SELECT x.* FROM (SELECT * FROM one_n UNION ALL SELECT * FROM two_n UNION ALL SELECT * FROM three_n) x, n WHERE runs * {SUPPORT[1]} >= n.n * {SUPPORT[0]}",
}


def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    common: dict[str, list[str]] = {}
    for row in table(spark, folder, "common_words").orderBy("lang", "rank_no").collect():  # fixed, 169 rows
        common.setdefault(row["lang"], []).append(row["word"])
    return quality.text_statistics(table(spark, folder, "documents", spread=True), "doc_id", "text", common)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of whose text more than half is lists, tables or junk, by the model fitted on the labels."""
    statistics = cut(_statistics(spark, folder))
    weights = quality.fitted(statistics, "doc_id", table(spark, folder, "doc_labels"))
    return statistics.where(quality.probability(weights) > 0.5).select("doc_id")


def p10_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and precision on the half of the labelled documents that a model of the other half has not seen."""
    statistics = cut(_statistics(spark, folder))
    known = cut(quality.labelled(statistics, "doc_id", table(spark, folder, "doc_labels"), "label", "prose"))
    seen = known.where("place % 2 = 0").orderBy("place", "doc_id").limit(quality.LABELLED).toPandas()
    weights = quality.fit(seen, seen["other"].to_numpy().astype(float))
    judged = known.where("place % 2 <> 0").select("other", (quality.probability(weights) > 0.5).alias("found"))
    counts = judged.agg(F.count("*").alias("n_held_out"), F.count_if("other").alias("n_other"), F.count_if("found").alias("n_found"), F.count_if(F.col("other") & F.col("found")).alias("n_both"))
    return counts.select(F.lit(len(seen)).cast("long").alias("n_fitted"), "*", F.try_divide("n_both", "n_other").alias("recall"), F.try_divide("n_both", "n_found").alias("precision"))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Quality statistics of every document."""
    return _statistics(spark, folder)


QUERIES |= {f.__name__: f for f in (p10_found, p10_holdout, p10_statistics)}
