"""Tables on disk, streaming ingest and alerts end to end."""

import json
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F
from test_merge import deliveries
from test_parse import assistant

from meterloom.operators import alerts, maintenance, merge
from meterloom.schemas import REQUESTS
from meterloom.sources import batches, tables
from meterloom.streaming import dedup, ingest


def test_request_table_upsert_moves_and_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "requests")
    day1, day2 = datetime(2026, 10, 1, 23), datetime(2026, 10, 2, 1)
    first = deliveries(spark, {"request_id": "a", "ts": day1}, {"request_id": "b", "ts": day2}, {"request_id": "c", "ts": datetime(2026, 9, 1)})
    tables.upsert_request_table(spark, path, first)
    # "a" grows and moves to the next day, so its old day folder must disappear
    again = deliveries(spark, {"request_id": "a", "ts": day2, "output": 500, "seq": 50}, {"request_id": "d", "ts": day2, "seq": 51})
    for _ in range(2):  # repeating the call changes nothing
        tables.upsert_request_table(spark, path, again)
        stored = tables.read_facts(spark, path, REQUESTS)
        got = sorted(rows(stored, "request_id", "output", "ts"))
        assert got == [("a", 500, day2), ("b", 100, day2), ("c", 100, datetime(2026, 9, 1)), ("d", 100, day2)]
    october = tables.read_facts(spark, path, REQUESTS, datetime(2026, 10, 1), datetime(2026, 10, 3))
    assert october.count() == 3
    assert "PartitionFilters: [isnotnull(day" in october._jdf.queryExecution().executedPlan().toString()
    # the cut-off falls inside October 2 (00:30): its day stays, and again once nothing of it is left
    tables.drop_expired(spark, path, "requests", datetime(2026, 10, 2, 0, 30) + timedelta(days=60))
    assert sorted(rows(tables.read_facts(spark, path, REQUESTS), "request_id")) == [("a",), ("b",), ("d",)]
    tables.drop_expired(spark, path, "requests", datetime(2026, 10, 2, 1, 30) + timedelta(days=60))
    assert tables.read_facts(spark, path, REQUESTS).count() == 0


def test_export_is_formula_safe(spark, tmp_path):
    rows_ = merge.merge_deliveries(deliveries(spark, {"request_id": "r", "project": '=1+"2"'}, {"request_id": "q", "project": "a,b"}), hot_rows=None)
    maintenance.write_export(rows_, datetime(2024, 11, 5), datetime(2024, 11, 6), str(tmp_path / "csv"))
    text = "\n".join(p.read_text() for p in (tmp_path / "csv").glob("*/*.csv"))
    assert text.splitlines()[0] == ",".join(maintenance.EXPORT_COLUMNS)
    assert '"\'=1+""2""\"' in text and '"a,b"' in text


def with_workspace(df):
    return df.withColumn("workspace_id", F.lit("ws"))


def write(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))


def test_streaming_ingest_equals_batch(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    project = root / "projects" / "p"
    seen = []

    def run(checkpoint="cp"):
        q = ingest.ingest_sessions(
            spark, str(root), out, str(tmp_path / checkpoint), with_workspace,
            after=lambda d, i: seen.append((i, d.count())), max_files=1,
        )
        q.awaitTermination()

    write(project, "s1.jsonl", assistant("A", 3), assistant("A", 3), assistant("B", 9), "broken")
    run()
    write(project, "s2.jsonl", assistant("A", 294), assistant("C", 1))
    write(project / "S" / "subagents", "agent-x.jsonl", assistant("D", 2))
    run()
    got = sorted(rows(tables.read_facts(spark, f"{out}/requests", REQUESTS), "request_id", "output", "is_subagent"))
    assert got == [("A", 294, False), ("B", 9, False), ("C", 1, False), ("D", 2, True)]
    assert sum(n for _, n in seen) == 5
    run()  # nothing new
    # a lost checkpoint replays every file; the merge makes that harmless
    run("cp-new")
    again = sorted(rows(tables.read_facts(spark, f"{out}/requests", REQUESTS), "request_id", "output", "is_subagent"))
    assert again == got


def test_refused_records_reach_quarantine(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    parsed = ingest.parse.usage
    # the parser cuts texts to size, so a record that fails is made behind it
    too_long = F.when(F.col("request_id") == "C", F.repeat(F.lit("p"), 201))
    monkeypatch.setattr(ingest.parse, "usage", lambda *a: parsed(*a).withColumn("project", too_long))
    write(tmp_path / "in" / "projects" / "p", "s.jsonl", assistant("A", 3), assistant("C", 7))
    ingest.ingest_sessions(spark, str(tmp_path / "in"), out, str(tmp_path / "cp"), with_workspace).awaitTermination()
    (held,) = spark.read.parquet(f"{out}/quarantine").collect()
    assert (held.workspace_id, held.kind, held.reason) == ("ws", "usage", "project: length")
    assert json.loads(held.record)["request_id"] == "C"
    assert rows(tables.read_facts(spark, f"{out}/requests", REQUESTS), "request_id") == [("A",)]


def test_telemetry_of_one_batch_is_coalesced(spark, tmp_path):
    def payload(minute, **attrs):
        record = {"timeUnixNano": str(1_780_000_000_000_000_000 + minute * 60_000_000_000), "body": {"stringValue": "api_request"},
                  "attributes": [{"key": k, "value": {"stringValue": str(v)}} for k, v in {"request_id": "q", "model": "m", **attrs}.items()]}
        return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record]}]}]})

    at, src = datetime(2026, 6, 1), str(tmp_path / "src")
    schema = "workspace_id string, device_id string, body string, received_at timestamp"
    full = payload(5, output_tokens=4, duration_ms=70, cost_usd=0.5)
    bare = payload(1, output_tokens=9)
    given = [("w", "d", b, at + timedelta(minutes=i)) for i, b in enumerate((full, bare))]
    spark.createDataFrame(given, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    out = str(tmp_path / "out")
    ingest.ingest_telemetry(spark, stream, out, str(tmp_path / "cp")).awaitTermination()
    log = spark.read.parquet(f"{out}/log/requests/stream=telemetry").orderBy("row").collect()
    # both reports are kept, in order of arrival and not of the time they carry
    assert [r.output for r in log] == [4, 9] and len({r.row for r in log}) == 2
    (row,) = tables.read_facts(spark, f"{out}/requests", REQUESTS).collect()
    want = merge.merge_deliveries(spark.createDataFrame([
        ("w", "q", "otel", 0, "m", 4, 70, 0.5, log[0].ts), ("w", "q", "otel", 1, "m", 9, None, None, log[1].ts)],
        "workspace_id string, request_id string, source string, seq long, model string, output long, duration_ms long, otel_cost_usd double, ts timestamp")).first()
    assert (row.output, row.duration_ms, row.otel_cost_usd) == (want.output, want.duration_ms, want.otel_cost_usd)


def test_growing_outputs_across_batches(spark, tmp_path):
    src, schema = tmp_path / "src", "workspace_id string, request_id string, output long, ts timestamp, landed timestamp"
    at = datetime(2026, 10, 1)
    ahead = at + timedelta(days=400)

    def land(*data):
        spark.createDataFrame([("w", r, o, ahead, t) for r, o, t in data], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        dedup.send_growing(stream, str(tmp_path / "sent"), str(tmp_path / "cp"), arrived="landed").awaitTermination()
        return sorted(rows(spark.read.parquet(str(tmp_path / "sent")), "batch", "request_id", "output"))

    assert land(("a", 3, at), ("a", 5, at), ("b", 1, at)) == [(0, "a", 5), (0, "b", 1)]
    assert land(("a", 5, at), ("b", 2, at)) == [(0, "a", 5), (0, "b", 1), (1, "b", 2)]
    # after three days the memory is gone and the request passes again
    assert (2, "a", 5) in land(("a", 5, at + timedelta(days=9)))


def test_alert_fires_once(spark):
    now = datetime(2026, 10, 8, 12)
    ws = spark.createDataFrame([("ws", "UTC")], "id string, timezone string")
    rules = spark.createDataFrame([("r1", "ws", "daily_value", 1.0, True), ("r2", "ws", "weekly_value", 50.0, True),
                                   ("r3", "ws", "limit_hit", 0.0, True), ("r4", "ws", "daily_value", 1.0, False)],
                                  "id string, workspace_id string, type string, threshold double, enabled boolean")
    reqs = spark.createDataFrame([("ws", "q1", "s", now - timedelta(hours=1), "m", 2.0, True), ("ws", "q2", "s", now - timedelta(hours=13), "m", 9.0, True)],
                                 "workspace_id string, request_id string, session_id string, ts timestamp, model string, value_usd double, priced boolean")
    lims = spark.createDataFrame([("ws", "l", now - timedelta(hours=2), "five_hour")], "workspace_id string, id string, ts timestamp, limit_kind string")
    devices = spark.createDataFrame([], "id string, workspace_id string, name string, revoked_at timestamp, last_seen_at timestamp")
    none = spark.createDataFrame([], "rule_id string, dedupe_key string")
    fired = alerts.evaluate(rules, ws, reqs, lims, devices, none, now)
    got = sorted(rows(fired, "rule_id", "dedupe_key", "measure"))
    assert got == [("r1", "day:2026-10-08", 2.0), ("r3", f"limit:{int((now - timedelta(hours=2) - datetime(1970, 1, 1)).total_seconds()) * 1000}", 1.0)]
    stored = spark.createDataFrame([(a, b) for a, b, _ in got], "rule_id string, dedupe_key string")
    assert alerts.evaluate(rules, ws, reqs, lims, devices, stored, now).count() == 0


def test_upload_batch_files(spark, tmp_path):
    import gzip

    body = {"schemaVersion": 1, "accountHash": "a" * 64, "plan": None, "device": {"os": "linux", "ccVersions": ["2.1"]},
            "parser": {"version": "3", "unknownTypes": {"odd": 2}, "malformedLines": 1},
            "records": [{"kind": "session_meta", "sessionId": "s", "title": "t", "titleSource": "ai", "agentName": None},
                        {"kind": "session_event", "id": "e", "sessionId": "s", "ts": "2026-10-01T10:00:00Z", "event": "turn", "durationMs": 5},
                        {"kind": "session_snapshot", "sessionId": "s", "ts": None, "totalCostUSD": 1.5, "apiMs": 1, "toolMs": 2,
                         "linesAdded": 3, "linesRemoved": 4, "modelUsage": {"m": {"inputTokens": 1, "costUSD": 0.5}}}]}
    (tmp_path / "b1.json.gz").write_bytes(gzip.compress(json.dumps(body).encode()))
    docs = batches.read_batches(spark, str(tmp_path))
    (h,) = batches.batch_headers(docs).collect()
    assert (h.schema_version, h.unknown_types, h.malformed_lines, h.cc_versions, h.n_records) == (1, {"odd": 2}, 1, ["2.1"], 3)
    recs = batches.batch_records(docs)
    assert batches.records_of(recs, "session_meta").first().title == "t"
    assert batches.records_of(recs, "session_event").first().duration_ms == 5
    assert batches.records_of(recs, "session_snapshot").first().model_usage["m"].costUSD == 0.5


def test_listing_orders(spark):
    from meterloom.operators import machines, rollups

    at = datetime(2026, 10, 1)
    devices = [("d1", "w", at, None), ("d2", "w", None, None), ("d3", "w", at - timedelta(days=1), None), ("d4", "w", at, at)]
    df = spark.createDataFrame(devices, "id string, workspace_id string, last_seen_at timestamp, revoked_at timestamp")
    assert rows(machines.in_device_order(df), "id") == [("d1",), ("d3",), ("d2",), ("d4",)]
    hits = [("w", f"l{i}", at + timedelta(minutes=i % 3), "weekly", "manual") for i in range(5)]
    df = spark.createDataFrame(hits, "workspace_id string, id string, ts timestamp, limit_kind string, source string")
    listed = rollups.limit_hits(df, at, at + timedelta(days=1))
    assert rows(listed, "id") == [("l2",), ("l1",), ("l4",), ("l0",), ("l3",)]
