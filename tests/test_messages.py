from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runloom.functions.ids import one_per_message, uuid_key
from runloom.operators.messages import MessageStore, arrival_runs, deduplicate, first_copies, redelivered

A, B = "1025ff17-ce25-4f14-9dfe-ccc87dbc3571", "a2188944-029e-4806-ad13-bef21a6b3723"
SCHEMA = "delivery_seq long, event_id string, x string"
SPELLINGS = [A, A.upper(), A.replace("-", ""), f"  {A}", f"{A}\t", "{" + A + "}", f"urn:uuid:{A}", f" {A.upper().replace('-', '')} "]


def test_all_spellings_of_a_uuid_are_one_key(frame):
    keys = frame([(s,) for s in SPELLINGS], "id string").select(uuid_key(F.col("id")).alias("k")).distinct().collect()
    assert len(keys) == 1 and len(keys[0].k) == 16


def test_other_text_is_its_own_key(frame):
    ids = ["", " ", "abc", "ABC", " abc ", "z" * 32, "é" * 5000, None]
    keys = [r.k for r in frame([(s,) for s in ids], "id string").select(uuid_key(F.col("id")).alias("k")).distinct().collect()]
    # blank and empty agree, abc with and without blanks agree
    assert len(keys) == 6 and keys.count(None) == 1 and not any(len(k) == 16 for k in keys if k)


def rows():
    found = [(i, s, f"v{i}") for i, s in enumerate(SPELLINGS)] + [(20, B, "b"), (21, "plain", "p"), (22, "plain", "q"), (23, None, "n"), (24, None, "n"), (25, "", "e"), (26, "", "e2")]
    return found


def test_first_copy_wins_and_rows_without_id_stay(frame):
    got = sorted(r.delivery_seq for r in deduplicate(frame(rows(), SCHEMA)).collect())
    assert got == [0, 20, 21, 23, 24, 25]


def test_ties_and_nulls_in_the_order(frame):
    got = deduplicate(frame([(None, A, "a"), (3, A, "c"), (3, A, "b"), (None, B, "z"), (None, B, "y")], SCHEMA)).collect()
    assert sorted((r.delivery_seq, r.x) for r in got if r.event_id == A) == [(3, "b")]
    assert [r.x for r in got if r.event_id == B] == ["y"]


def test_empty_tables(frame, spark):
    assert deduplicate(frame([], SCHEMA)).count() == 0
    assert redelivered(frame([], SCHEMA)).count() == 0
    assert one_per_message(frame([], SCHEMA), ["x"]).columns == ["x"]


def test_clashing_names_pass_through(frame):
    schema = "delivery_seq long, event_id string, k string, v string, kept string, message_key string, late string, at string, row string"
    got = deduplicate(frame([(1, A, *"abcdefg"), (2, A, *"hijklmn")], schema)).collect()
    assert [tuple(r) for r in got] == [(1, A, *"abcdefg")]


def test_store_is_idempotent_and_compacts(frame, spark):
    store = MessageStore(spark)
    first, second = frame(rows()[:5], SCHEMA), frame(rows()[3:], SCHEMA)
    store.upsert(second)
    once = sorted(map(tuple, store.read().collect()), key=str)
    store.upsert(second)
    assert sorted(map(tuple, store.read().collect()), key=str) == once
    store.upsert(first)
    want = sorted(map(tuple, deduplicate(frame(rows(), SCHEMA)).collect()), key=str)
    assert sorted(map(tuple, store.read().collect()), key=str) == want
    store.compact()
    assert sorted(map(tuple, store.read().collect()), key=str) == want
    assert spark.table(store.table).count() == len(want)
    store.drop()


def test_store_reads_without_an_exchange(frame, spark):
    store = MessageStore(spark)
    store.upsert(frame(rows(), SCHEMA))
    plan = store.merged()._jdf.queryExecution().executedPlan().toString()
    store.drop()
    assert "Exchange" not in plan


def test_other_bucket_number(frame, spark):
    store = MessageStore(spark, buckets=3)
    store.upsert(frame(rows(), SCHEMA))
    assert store.read().count() == 6
    store.drop()


@pytest.mark.parametrize("runs", [1, 2, 50])
def test_redelivered_rows(frame, runs):
    got = sorted(r.delivery_seq for r in redelivered(frame(rows(), SCHEMA), runs=runs).collect()) if runs < 10 else None
    if got is None:
        assert sum(p.count() for p in arrival_runs(frame(rows(), SCHEMA), "delivery_seq", runs)) == len(rows())
    else:
        assert got == [1, 2, 3, 4, 5, 6, 7, 22, 26]


def test_a_hot_identifier(frame):
    many = [(i, SPELLINGS[i % len(SPELLINGS)], "x") for i in range(2000)] + [(5000, B, "y")]
    assert redelivered(frame(many, SCHEMA)).count() == 1999


def test_a_later_session_goes_on_with_a_store(frame, spark, tmp_path):
    path = str(tmp_path / "store")
    schema = SCHEMA.replace("x string", "`odd name` string, d decimal(12,6), s struct<a:int,b:string>")
    from decimal import Decimal

    first = MessageStore(spark, path, buckets=3)
    first.upsert(frame([(1, A, "a", Decimal("1.5"), (1, "x")), (2, B, "b", None, None)], schema))
    spark.sql(f"DROP TABLE {first.table}")
    second = MessageStore(spark, path)
    second.upsert(frame([(0, A.upper(), "z", None, None), (3, B, "c", None, None)], schema))
    second.compact()
    spark.sql(f"DROP TABLE {second.table}")
    third = MessageStore(spark, path)
    assert third.buckets == 3 and third.generation == 1
    assert sorted((r.delivery_seq, r["odd name"]) for r in third.read().collect()) == [(0, "z"), (2, "b")]
    third.drop()


def test_a_store_takes_more_buckets_when_it_is_compacted(frame, spark):
    store = MessageStore(spark, buckets=2)
    store.upsert(frame(rows()[:5], SCHEMA))
    store.compact(7)
    store.upsert(frame(rows()[3:], SCHEMA))
    reopened = MessageStore(spark, store.path)
    assert reopened.buckets == 7
    assert sorted(r.delivery_seq for r in reopened.read().collect()) == [0, 20, 21, 23, 24, 25]
    store.drop()


def test_first_copies_keep_all_columns_and_rows_without_an_order(frame):
    schema = "x string, delivery_seq long, event_id string, message_key string, kept string"
    data = [(f"v{i}", i, s, "k", None) for i, s in enumerate(SPELLINGS)] + [("b", 20, B, None, "z"), ("n", None, B, "k", "z"), ("o", 30, None, "k", "z")]
    got = first_copies(frame(data, schema))
    assert got.columns == ["x", "delivery_seq", "event_id", "message_key", "kept"]
    assert sorted(r.x for r in got.collect()) == ["b", "n", "o", "v0"]
    assert first_copies(frame([], schema)).count() == 0
