from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))

from compare import canonical, connect
from runloom.llm import queries, tokens

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_its_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    want = connect(FOLDER).execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_bitmap_error_against_exact_counts(spark):
    got = {(r.project_id, r.agent_name): (r.users, r.runs, r.traces) for r in queries.p1_window_distincts(spark, FOLDER).collect()}
    want = {r[:2]: r[2:] for r in connect(FOLDER).execute("SELECT project_id, agent_name, count(DISTINCT user_id), count(DISTINCT run_id), count(DISTINCT trace_id) FROM agent_events GROUP BY ALL").fetchall()}
    assert set(got) == set(want) and all(abs(a - b) <= max(1, 0.03 * b) for k in want for a, b in zip(got[k], want[k]))


def test_token_counts(spark, frame):
    schema = "id long, text string"
    texts = {1: "", 2: None, 3: "hello world", 4: "  \n\t x", 5: "<|endoftext|>", 6: "数据 é" * 50, 7: "a" * 20_000}
    got = {r.id: r.tokens for r in tokens.with_tokens(frame(list(texts.items()), schema)).collect()}
    encode = tokens.encoder().encode_ordinary
    assert got == {i: len(encode(t)) if t else 0 for i, t in texts.items()} and got[3] == 2
    assert all(tokens.encoder().decode(encode(t)) == t for t in texts.values() if t)


@pytest.mark.parametrize("name", ["p8_found", "p9_found", "p10_found"])
def test_found_columns(spark, name):
    columns = {"p8_found": ["spec_id", "doc_id"], "p9_found": ["mix_id", "source"], "p10_found": ["doc_id"]}[name]
    rows = queries.QUERIES[name](spark, FOLDER)
    assert rows.columns == columns and rows.count() == rows.distinct().count() > 0


def test_bitmap_error_on_all_levels(spark):
    """Every combination of dims against exact counts: within the stated error, but for the few in a thousand that three standard errors leave."""
    names = ["users", "runs", "traces"]
    dims = ", ".join(queries.DIMS)
    sql = f"SELECT strftime(timestamp, '%Y-%m-%d') AS day, {dims}, CAST(grouping({dims}) AS INTEGER) AS level, count(DISTINCT user_id) AS users, count(DISTINCT run_id) AS runs, count(DISTINCT trace_id) AS traces FROM agent_events GROUP BY day, CUBE ({dims})"
    keys = ["day", *queries.DIMS, "level"]
    want = {tuple(r[:6]): r[6:] for r in connect(FOLDER).execute(sql).fetchall()}
    got = {tuple(r[k] for k in keys): r for r in queries.p1_daily_distincts(spark, FOLDER).collect()}
    assert set(got) == set(want) and {k[-1] for k in want} == set(range(16))
    off = sum(abs(got[k][n] - want[k][i]) > max(1, got[k][f"{n}_error"] * got[k][n]) for k in want for i, n in enumerate(names))
    assert off <= 0.003 * 3 * len(want)
