from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from runloom.client.recorder import Recorder
from runloom.service import Service
from runloom.streaming import payloads, wire
from runloom.streaming.ingest import Backpressure, Ingestor, Landing, hourly_counts, touched_runs
from runloom.streaming.store import EventStore

ENVELOPE = {"eventId": "e", "traceId": "t1", "runId": "r1", "timestamp": "2026-05-07T11:00:00.123456+02:00", "agentName": "a", "userId": "u", "stepIndex": 0, "metadata": {"k": [1]}}


def body(kind, **fields):
    return {k: v for k, v in {**ENVELOPE, "eventType": kind, **fields}.items() if v != "absent"}


STARTED = body("run_started", eventId="e1", status="running", input="hello")
CALL = body("llm_call", eventId="e2", model="m", status="success", latencyMs=10.5, inputTokens=3, outputTokens=4, costUsd=0.25, stepIndex=1)
TOOL = body("tool_call", eventId="e3", toolName="x", status="failed", latencyMs=7, metadata="absent", stepIndex=2)
DONE = body("run_completed", eventId="e4", status="success", output="bye", stepIndex=3)
GOOD = [
    STARTED,
    CALL,
    TOOL,
    DONE,
    body("step_completed"),
    body("step_completed", latencyMs=0),
    body("error", status="failed", errorType="x", message="m", toolName="y"),
    body("retry", attempt=1),
    body("llm_call", model="m", status="failed", latencyMs=1, inputTokens=0, outputTokens=0.0, costUsd=0),
]
BAD = {
    "inputTokens: required": body("llm_call", model="m", status="success", latencyMs=1, outputTokens=1, costUsd=0),
    "unrecognised: costUsd": body("run_completed", status="success", costUsd=1),
    "eventType: expected": body("trace_started"),
    "status: expected": body("run_started", status="success", input=""),
    "stepIndex: expected": body("step_completed", stepIndex=-1),
    "stepIndex: expected a": body("step_completed", stepIndex=1.5),
    "latencyMs: expected": body("step_completed", latencyMs="5"),
    "latencyMs: expected a": body("step_completed", latencyMs=None),
    "timestamp: expected": body("step_completed", timestamp="2026-05-07T11:00:00"),
    "timestamp: expected an": body("step_completed", timestamp="2026-13-07T11:00:00Z"),
    "eventId: expected": body("step_completed", eventId=""),
    "eventId: required": body("step_completed", eventId="absent"),
    "traceId: expected": body("step_completed", traceId=5),
    "metadata: expected": body("step_completed", metadata=[1]),
    "attempt: expected": body("retry", attempt=0),
    "body: not": "no json",
    "body: not a": [1],
}


@pytest.fixture(scope="module")
def messages(spark):
    def make(bodies):
        rows = [(i, "p", b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
        return spark.createDataFrame(rows, "position long, project_id string, body string")

    return make


def test_good_events_are_accepted(messages):
    validated = wire.validate(messages(GOOD))
    assert [list(r.problems) for r in validated.where("size(problems) > 0").collect()] == []
    row = {r.event_id: r for r in wire.accepted(validated, F.col("project_id")).collect()}["e2"]
    assert str(row.timestamp) == "2026-05-07 09:00:00.123000" and str(row.cost_usd) == "0.250000" and (row.input_tokens, row.latency_ms, row.tool_name) == (3, 10.5, None)
    assert json.loads(row.metadata) == {"k": [1]}


def test_bad_events_are_told_why(messages):
    names = list(BAD)
    got = {r.position: list(r.problems) for r in wire.validate(messages([BAD[n] for n in names] + [None, ""])).collect()}
    for i, name in enumerate(names):
        assert any(p.startswith(name) for p in got[i]), (name, got[i])
    assert got[len(names)] and got[len(names) + 1]


def test_partial_acceptance(messages):
    validated = wire.validate(messages([STARTED, CALL, BAD["inputTokens: required"], TOOL, DONE, "x"]))
    assert tuple(wire.summary(validated).first()) == (4, 0, 2)
    assert {r.event_id for r in wire.rejected(validated, "position").collect()} == {"e", "index:5"}


def test_flat_transport(spark, messages):
    flat = spark.createDataFrame(
        [("e1", "llm_call", "m", None, None, "{bad"), ("e2", "error", None, "x", "boom", '{"a": 1}'), ("e3", "run_started", "dropped", None, None, None)],
        "event_id string, event_type string, model string, error_type string, message string, metadata_json string",
    ).withColumns({c: F.lit(v) for c, v in {"trace_id": "t", "run_id": "r", "timestamp": "2026-01-01T00:00:00Z", "agent_name": "a", "user_id": "u"}.items()})
    bodies = {r["eventId"]: r for r in (json.loads(x.body) for x in wire.flat_to_wire(flat).collect())}
    assert (bodies["e1"]["inputTokens"], bodies["e1"]["costUsd"], bodies["e1"]["status"], bodies["e1"]["metadata"]) == (0, 0.0, "success", {})
    assert bodies["e2"]["metadata"] == {"a": 1} and "model" not in bodies["e3"] and bodies["e3"]["input"] == ""
    assert wire.validate(wire.flat_to_wire(flat)).where("size(problems) > 0").count() == 0


def test_payloads_go_and_come_back(messages):
    long = {**STARTED, "input": "x" * 4096 + '"{é', "metadata": {"tag": 1, "payloadRef": "local://forged"}}
    rows = wire.accepted(wire.validate(messages([long, CALL, {**DONE, "metadata": {}}])), F.col("project_id"))
    slim, texts = payloads.strip(rows)
    got = {r.event_id: r for r in slim.collect()}
    assert "input" not in slim.columns and json.loads(got["e1"].metadata) == {"tag": 1, "payloadRef": "local://e1/p/e1"}
    assert json.loads(got["e2"].metadata) == {"k": [1]} and texts.count() == 2
    back = {r.event_id: r for r in payloads.hydrate(slim, texts).collect()}
    assert back["e1"].input == long["input"] and json.loads(back["e1"].metadata) == {"tag": 1} and back["e4"].output == "bye" and back["e4"].metadata == "{}"
    missing = {r.event_id: r for r in payloads.hydrate(slim, texts.limit(0)).collect()}
    assert missing["e1"].input is None and "payloadRef" in missing["e1"].metadata


def stored_rows(messages, bodies):
    return wire.accepted(wire.validate(messages(bodies)), F.col("project_id")).drop("input", "output")


def test_append_is_idempotent(spark, messages, tmp_path):
    store = EventStore(spark, str(tmp_path))
    assert store.read().count() == 0
    rows = stored_rows(messages, [STARTED, CALL, TOOL, DONE, {**CALL, "latencyMs": 99}])
    first = store.append(rows, "b1", "position")
    assert (first.inserted, first.duplicates) == (4, 1)
    assert (store.append(rows, "b1", "position").inserted, store.read().count()) == (4, 4)
    again = store.append(rows, "b2", "position")
    assert (again.inserted, again.duplicates, store.read().count()) == (0, 5, 4)
    assert store.read().where("event_id = 'e2'").first().latency_ms == 10.5
    store.bulk_load(rows, "b3")
    assert store.read().count() == 9
    store.compact([r[0] for r in store.read().select("event_date").distinct().collect()])
    assert store.read().count() == 4 and touched_runs(store, "compacted").count() == 1


def drain(ingestor, landing, checkpoint):
    query = ingestor.start(landing.path, checkpoint, seconds=None, files=1)
    query.awaitTermination()


def test_stream_end_to_end(spark, tmp_path):
    landing, ingestor = Landing(str(tmp_path / "in")), Ingestor(spark, str(tmp_path / "out"))
    landing.put("p", map(json.dumps, [STARTED, CALL, BAD["inputTokens: required"]]))
    landing.put("p", map(json.dumps, [CALL, TOOL, DONE]))
    drain(ingestor, landing, str(tmp_path / "ck"))
    assert sorted(r.event_id for r in ingestor.store.read().collect()) == ["e1", "e2", "e3", "e4"]
    assert spark.read.json(str(tmp_path / "out/rejected")).count() == 1 and ingestor.payloads().count() == 2
    landing.put("p", map(json.dumps, [DONE]))
    drain(ingestor, landing, str(tmp_path / "ck"))
    assert ingestor.store.read().count() == 4


def test_dead_letters_after_repeated_failure(spark, tmp_path, monkeypatch, messages):
    ingestor = Ingestor(spark, str(tmp_path), max_attempts=3)
    monkeypatch.setattr(ingestor, "_ingest", lambda batch, name: 1 / 0)
    batch = messages([CALL])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            ingestor.handle(batch, 7)
    assert ingestor.handle(batch, 7) is None
    assert "division" in spark.read.json(f"{tmp_path}/dead_letters").first().error


def test_hourly_counts(spark, messages, tmp_path):
    stored_rows(messages, [STARTED, CALL, TOOL, DONE]).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    query = hourly_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.event_type, str(r.hour), r.n) for r in spark.table("hourly").collect()} == {(k, "2026-05-07 09:00:00", 1) for k in ("run_started", "llm_call", "tool_call", "run_completed")}


def test_service(spark, tmp_path):
    ingestor = Ingestor(spark, str(tmp_path / "out"))
    landing = Landing(str(tmp_path / "in"), max_depth=5, consumed=ingestor.consumed, fresh=0)
    service = Service(spark, ingestor, landing, {"key": "proj_dev"})

    def call(method, path, data=None, **headers):
        return service.handle(method, path, headers, json.dumps(data).encode() if data is not None else b"")

    assert call("GET", "/health") == (200, {"ok": True})
    assert call("POST", "/capture", {"events": []})[0] == 401
    assert call("POST", "/capture", {"events": 5}, **{"x-api-key": "key"})[0] == 400
    status, answer = call("POST", "/capture", {"events": [STARTED, CALL, {}, TOOL, DONE]}, **{"x-api-key": "key"})
    assert status == 202 and (answer["accepted"], answer["rejected"], answer["results"][0]["eventId"]) == (4, 1, "index:2")
    drain(ingestor, landing, str(tmp_path / "ck"))
    status, answer = call("POST", "/query", {"q": "average latency by tool on 2026-05-07"})
    assert status == 200 and answer["result"]["rows"] == [{"toolName": "x", "value": 7.0}]
    assert call("POST", "/query", {"q": " "})[0] == 400 and call("POST", "/query", {"q": "the weather"})[0] == 400
    (summary,) = call("GET", "/traces?toolName=x&limit=5")[1]
    assert summary == {"traceId": "t1", "projectId": "proj_dev", "agentName": "a", "outcome": "success", "runCount": 1, "startedAt": "2026-05-07T09:00:00.123Z", "endedAt": "2026-05-07T09:00:00.123Z", "durationMs": 0, "costUsd": 0.25}
    status, detail = call("GET", "/traces/t1")
    assert status == 200 and [e["eventId"] for e in detail["events"]] == ["e1", "e2", "e3", "e4"] and detail["events"][0]["input"] == "hello"
    assert detail["events"][0]["metadata"] == {"k": [1]} and detail["events"][0]["timestamp"] == "2026-05-07T09:00:00.123Z" and detail["runs"][0]["totalTokens"] == 7
    for wrong in ("from=yesterday", "limit=many", "limit=0", "limit=100000", "offset=-1"):
        assert call("GET", f"/traces?{wrong}")[0] == 400, wrong
    assert call("POST", "/query", {"q": "tokens by agent on 2026-05-07", "limit": "x"})[0] == 400
    assert call("GET", "/traces/none")[0] == 404 and call("GET", "/elsewhere")[0] == 404
    # the four of before are consumed; more than five may not wait
    assert landing.backlog() == 0
    assert call("POST", "/capture", {"events": [CALL] * 5}, **{"x-api-key": "key"})[0] == 202 and landing.backlog() == 5
    assert call("POST", "/capture", {"events": [CALL]}, **{"x-api-key": "key"})[0] == 429
    with pytest.raises(Backpressure):
        landing.put("p", ["x"])
    drain(ingestor, landing, str(tmp_path / "ck"))
    assert call("POST", "/capture", {"events": [CALL]}, **{"x-api-key": "key"})[0] == 202


def test_landing_through_hadoop(spark, tmp_path):
    landing = Landing(f"file://{tmp_path}/in", spark=spark, consumed=f"file://{tmp_path}/done", fresh=0)
    assert landing.put("p", ["{}"] * 120) == 120 and landing.backlog() == 120
    assert spark.read.json(landing.path).count() == 120 and len(list((tmp_path / "in").glob("*.json"))) == 3


def test_one_message_is_checked_as_all_are(messages):
    bodies = GOOD + list(BAD.values())
    got = {r.position: list(r.problems) for r in wire.validate(messages(bodies)).collect()}
    for i, b in enumerate(bodies):
        assert wire.check(b) == got[i], b


def test_late_hours_are_counted_anew(spark, messages, tmp_path):
    from runloom.streaming.ingest import touched_hours

    store = EventStore(spark, str(tmp_path))
    store.append(stored_rows(messages, [CALL, TOOL]), "b1", "position")
    store.append(stored_rows(messages, [{**CALL, "eventId": "late"}]), "b2", "position")
    assert [(r.event_type, str(r.hour), r.n, str(r.cost_usd)) for r in touched_hours(store, "b2").collect()] == [("llm_call", "2026-05-07 09:00:00", 2, "0.500000")]


def recorded(answers, **options):
    sent, errors, pauses = [], [], []

    def send(batch):
        answer = answers.pop(0) if answers else 202
        if isinstance(answer, Exception):
            raise answer
        if answer < 300:
            sent.append(batch)
        return answer

    return Recorder(send, on_error=errors.append, sleep=pauses.append, start_timer=False, **options), sent, errors, pauses


def test_client_events_are_valid(messages):
    recorder, sent, errors, _ = recorded([])
    run = recorder.start_run("a", "u", "hi", {"team": 1})
    run.llm_call("m", 5, 1, 2, 0.1)
    run.tool_call("x", 5, "failed", metadata={"n": 2})
    run.step()
    run.retry(1, "x")
    run.error("boom", message="m")
    run.end("failed")
    run.end("failed")
    recorder.shutdown()
    events = [e for batch in sent for e in batch]
    assert [e["stepIndex"] for e in events] == list(range(7)) and events[2]["metadata"] == {"team": 1, "n": 2}
    assert wire.validate(messages(events)).where("size(problems) > 0").count() == 0


def test_client_retries_and_drops():
    recorder, sent, errors, pauses = recorded([OSError(), 503, 429, 202])
    recorder.record({"n": 1})
    recorder.flush()
    assert sent == [[{"n": 1}]] and len(pauses) == 3 and pauses[0] < pauses[1] < pauses[2]
    recorder, sent, errors, pauses = recorded([400])
    recorder.record({})
    recorder.flush()
    assert not sent and len(errors) == 1 and not pauses
    recorder, sent, errors, _ = recorded([500] * 4)
    recorder.record({})
    recorder.flush()
    assert not sent and len(errors) == 1
    recorder, sent, errors, _ = recorded([], flush_at=3, max_batch=2)
    for i in range(3):
        recorder.record({"n": i})
    assert [len(b) for b in sent] == [2, 1]
    recorder, sent, errors, _ = recorded([], flush_at=100, max_queue=2)
    for i in range(3):
        recorder.record({"n": i})
    assert isinstance(errors[0], OverflowError)


def test_a_message_is_stored_once_over_all_dates(spark, messages, tmp_path, monkeypatch):
    """The key is the identifier alone, whatever the date; large batches and large dates take other plans."""
    store = EventStore(spark, str(tmp_path))
    at = lambda day, **fields: stored_rows(messages, [{**CALL, "timestamp": f"2026-05-{day:02d}T11:00:00Z", **fields}])
    first, second = store.append(at(7), "b1", "position"), store.append(at(8, eventId=" E2 "), "b2", "position")
    # not a UUID, so letter case counts; blanks do not
    assert (first.inserted, second.inserted) == (1, 1)
    again = store.append(at(9, eventId=" e2"), "b3", "position")
    assert (again.inserted, again.duplicates, store.read().count()) == (0, 1, 2)
    monkeypatch.setattr("runloom.streaming.store.SMALL_BATCH", 0)
    monkeypatch.setattr("runloom.streaming.store.FILE_ROWS", 2)
    # small parts are put into one file again unless this is off
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    many = stored_rows(messages, [{**TOOL, "eventId": f"x{i}", "runId": f"r{i}"} for i in range(9)] + [{**CALL, "timestamp": "2026-05-20T11:00:00Z"}])
    try:
        last = store.append(many, "b4", "position")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert (last.inserted, last.duplicates) == (9, 1)
    assert store.read().where("batch = 'b4'").select(F.input_file_name()).distinct().count() > 1


def test_references_deeper_in_the_metadata_stay(messages):
    deep = {**STARTED, "metadata": {"a": {"payloadRef": "x", "n": 1.50}, "b": 1, "c": [{"payloadRef": "y"}], "t": '"payloadRef":"z"'}}
    flat = {**DONE, "metadata": {"payloadRef": 5, "k": None}}
    rows = wire.accepted(wire.validate(messages([deep, flat])), F.col("project_id"))
    slim, texts = payloads.strip(rows)
    got = {r.event_id: json.loads(r.metadata) for r in slim.collect()}
    assert got["e1"] == {**deep["metadata"], "payloadRef": "local://e1/p/e1"} and got["e4"] == {"k": None, "payloadRef": "local://e4/p/e4"}
    back = {r.event_id: json.loads(r.metadata) for r in payloads.hydrate(slim, texts).collect()}
    assert back["e1"] == deep["metadata"] and back["e4"] == {"k": None}
