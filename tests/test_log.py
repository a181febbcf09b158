"""The append-only log, its compactor, the key-to-day index, usage tiles and streamed alerts."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterloom.operators import alerts, merge, tiles
from meterloom.schemas import DELIVERIES
from meterloom.sources import tables
from meterloom.streaming import alerts as stream_alerts
from meterloom.streaming import ingest, log

DAY = datetime(2025, 3, 3)
REQUEST_FIELDS = "workspace_id string, request_id string, source string, session_id string, ts timestamp, model string, output long, thinking long, input long, cache_read long, cache_write_5m long, cache_write_1h long, device_id string, duration_ms long"


def deliveries(spark, rows):
    """(workspace, request, source, ts, output, thinking) as deliveries."""
    full = [(w, r, s, f"s-{r}", ts, "claude-haiku-5-5", out, think, 10, 20, 0, 0, f"d-{out}", 5) for w, r, s, ts, out, think in rows]
    return merge.as_deliveries(spark.createDataFrame(full, REQUEST_FIELDS))


def by_arrival(batches):
    """All rows of the log in order, as one batch."""
    return [row for batch in batches for row in batch]


def random_batches(draw, n):
    return [[(f"w{draw.randrange(3)}", f"r{draw.randrange(12)}", draw.choice(["transcript", "otel"]), DAY + timedelta(hours=draw.randrange(70)), draw.randrange(1, 50), draw.choice([None, draw.randrange(9)])) for _ in range(draw.randrange(1, 15))] for _ in range(n)]


def as_text(df, columns):
    return sorted(str([None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns]) for r in df.collect())


def test_tables_equal_one_fold_of_the_whole_log(spark, tmp_path, monkeypatch):
    """Two streams commit in turns; one compaction dies halfway and is repeated; one batch is delivered again."""
    draw, folder = random.Random(4), str(tmp_path / "f")
    batches = random_batches(draw, 5)
    schema_meta = "workspace_id string, session_id string, title string, title_source string, agent_name string, updated_at timestamp"
    schema_limit = "workspace_id string, id string, ts timestamp, limit_kind string, source string"
    schema_metric = "workspace_id string, ts timestamp, metric string, value double"
    metas, hits, points = [], [], []

    def land(i, source):
        rows = deliveries(spark, batches[i]).withColumn("row", F.monotonically_increasing_id())
        meta = [("w0", f"s{k}", draw.choice([None, f"t{i}"]), draw.choice(["ai", "custom"]), draw.choice([None, f"a{i}"]), DAY + timedelta(days=i)) for k in range(2)]
        meta = [(w, s, t, ts if t else None, a, u) for w, s, t, ts, a, u in meta]
        hit = [(f"w{draw.randrange(2)}", f"l{draw.randrange(6)}", DAY + timedelta(hours=draw.randrange(50)), draw.choice(["weekly", "five_hour"]), str(i))]
        point = [("w1", DAY + timedelta(hours=i), "m", float(i))]
        records = {"requests": rows, "session_meta": spark.createDataFrame(meta, schema_meta), "limit_events": spark.createDataFrame(hit, schema_limit), "otel_metrics": spark.createDataFrame(point, schema_metric)}
        log.append(folder, source, i // 2, records, arrived_us=i)
        return meta, hit, point

    for i in range(5):
        again = draw.getstate()
        meta, hit, point = land(i, ["sessions", "telemetry"][i % 2])
        metas.append(meta), hits.append(hit), points.append(point)
        if i == 2:  # the batch comes again before it is folded
            state = draw.getstate()
            draw.setstate(again)
            land(i, "sessions")
            draw.setstate(state)
            whole = log.apply_upsert
            calls = []

            def once(spark, change, whole=whole, calls=calls):
                if calls:
                    raise RuntimeError("executor lost")
                calls.append(change)
                whole(spark, change)

            monkeypatch.setattr(log, "apply_upsert", once)
            with pytest.raises(RuntimeError):
                log.compact(spark, folder)
            monkeypatch.setattr(log, "apply_upsert", whole)
        if i in (1, 2, 4):
            assert log.compact(spark, folder)
    assert not log.compact(spark, folder)  # nothing waits

    # one by one in order: rows of a batch stand in the order they were written
    rows = by_arrival(batches)
    want = merge.merge_deliveries(deliveries(spark, rows).withColumn("seq", F.monotonically_increasing_id()).select(*DELIVERIES.names))
    columns = ["workspace_id", "request_id", "session_id", "ts", "output", "thinking", "device_id", "duration_ms", "value_usd", "sources"]
    got = log.read_table(spark, folder, "requests")
    assert as_text(got, columns) == as_text(want, columns)

    records = spark.createDataFrame([(*r, i) for i, batch in enumerate(metas) for r in batch], schema_meta + ", seq long")
    meta_columns = ["workspace_id", "session_id", "title", "title_source", "agent_name", "updated_at"]
    assert as_text(log.read_table(spark, folder, "session_meta"), meta_columns) == as_text(merge.merge_meta(records), meta_columns)
    firsts = {}
    for row in by_arrival(hits):
        firsts.setdefault(row[:2], row)
    limit_columns = ["workspace_id", "id", "ts", "limit_kind", "source"]
    assert as_text(log.read_table(spark, folder, "limit_events"), limit_columns) == sorted(str(list(r)) for r in firsts.values())
    assert as_text(log.read_table(spark, folder, "otel_metrics"), ["workspace_id", "ts", "metric", "value"]) == sorted(str(list(r)) for r in by_arrival(points))

    # the tiles' changes add up to the tiles of the table
    summed = log.read_tiles(spark, folder, "request_tiles").groupBy("workspace_id", "slot", "model").agg(F.sum("requests").alias("requests"), F.round(F.sum("value"), 9).alias("value")).where("requests <> 0")
    direct = got.groupBy("workspace_id", tiles.slot_of(F.col("ts")).alias("slot"), "model").agg(F.count("*").alias("requests"), F.round(F.sum("value_usd"), 9).alias("value"))
    assert as_text(summed, summed.columns) == as_text(direct, summed.columns)
    assert log.read_tiles(spark, folder, "limit_tiles").agg(F.sum("limits")).first()[0] == len(firsts)

    # listings stay short: one mark of generations, no commit that was folded
    assert len(tables.listed(spark, f"{folder}/generations")) == 1
    assert [tables.listed(spark, f"{folder}/log/_commits/{s}") for s in ("sessions", "telemetry")] == [[], []]

    # a batch that comes again after all is no news
    log.append(folder, "sessions", 0, {"requests": deliveries(spark, batches[0])})
    assert not log.compact(spark, folder)


def test_lease_lets_one_in(spark, tmp_path):
    path = str(tmp_path / "lease")
    with log.Lease(spark, path) as first:
        with log.Lease(spark, path) as second:
            assert first and not second
        assert tables.exists(spark, path)  # the second did not take the first one's lease with it
    with log.Lease(spark, path, seconds=-1) as first, log.Lease(spark, path, seconds=-1) as after_a_crash:
        assert first and after_a_crash
    assert not tables.exists(spark, path)


def test_two_streams_at_once(spark, tmp_path):
    """Sessions and telemetry run together; whoever compacts, all of both ends up in the tables."""
    from test_parse import assistant

    root, out = tmp_path / "in", str(tmp_path / "out")
    project = root / "projects" / "p"
    project.mkdir(parents=True)
    for i in range(2):
        (project / f"s{i}.jsonl").write_text("\n".join([assistant(f"A{i}", 3), assistant(f"B{i}", 7 + i), assistant("Q", 5)]) + "\n")

    def payload(request, output):
        attributes = {"request_id": request, "model": "m", "output_tokens": output, "duration_ms": 70}
        record = {"timeUnixNano": "1780000000000000000", "body": {"stringValue": "api_request"}, "attributes": [{"key": k, "value": {"stringValue": str(v)}} for k, v in attributes.items()]}
        return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record]}]}]})

    schema = "workspace_id string, device_id string, body string, received_at timestamp"
    for i in range(2):
        spark.createDataFrame([("ws", "d", payload("Q", 90 + i), DAY), ("ws", "d", payload(f"T{i}", 4), DAY)], schema).coalesce(1).write.parquet(str(tmp_path / "src" / f"n={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src" / "n=*"))
    named = lambda df: df.withColumn("workspace_id", F.lit("ws"))
    running = [ingest.ingest_sessions(spark, str(root), out, str(tmp_path / "c1"), named, max_files=1), ingest.ingest_telemetry(spark, stream, out, str(tmp_path / "c2"))]
    for query in running:
        query.awaitTermination()
    log.compact(spark, out)
    got = {r.request_id: (r.output, r.sources) for r in log.read_table(spark, out, "requests").collect()}
    assert got == {"A0": (3, ["transcript"]), "B0": (7, ["transcript"]), "A1": (3, ["transcript"]), "B1": (8, ["transcript"]), "Q": (91, ["otel", "transcript"]), "T0": (4, ["otel"]), "T1": (4, ["otel"])}
    assert not tables.exists(spark, f"{out}/_lease")
    read = log.read_table(spark, out, "ingest_log").groupBy("source").agg(F.sum("records").alias("n")).collect()
    assert {r.source: r.n for r in read} == {"transcript": 6, "otel": 4}


def test_an_upsert_opens_the_buckets_of_its_days_only(spark, tmp_path):
    path, table = str(tmp_path / "t"), tables.KEYED["requests"]
    rows = [("w", f"r{i}", "transcript", DAY + timedelta(days=i % 5), 5, None) for i in range(100)]
    tables.upsert_request_table(spark, path, deliveries(spark, rows).withColumn("seq", F.lit(0)))
    again = deliveries(spark, [r[:4] + (9, None) for r in rows if r[3] == DAY][:3]).withColumn("seq", F.lit(1))
    touched = again.select(*table.keys).distinct().withColumn(tables.BUCKET, table.bucket())
    folders = tables.folders_of(spark, table, path, touched)
    assert 1 <= len(folders) <= 3 and {day for day, _ in folders} == {DAY.date()}
    opened = table.read(spark, path).where(tables._among(table, folders))
    scans = opened._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scans and "day" in scans.split("PartitionFilters: [")[1]
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    tables.upsert_request_table(spark, path, again)
    rewritten = {f"{d}/{b}" for f in before if not f.exists() for b, d in [(f.parent.name, f.parent.parent.name)]}
    assert rewritten == {f"day={d}/bucket={b}" for d, b in folders}
    assert sorted(r.output for r in table.read(spark, path).collect()) == [5] * 97 + [9] * 3


def dimensions(spark):
    rules = [(f"{kind}-{w}", w, kind, threshold, True) for w in ("a", "b", "c") for kind, threshold in (("block_pct", 10.0), ("limit_hit", 0.0), ("daily_value", 3.0), ("weekly_value", 20.0), ("device_silent", 2.0))]
    zones = [("a", "Asia/Kathmandu"), ("b", "America/New_York"), ("c", "UTC")]
    devices = [("d1", "a", "x", None, DAY - timedelta(days=9)), ("d2", "b", "y", None, DAY + timedelta(days=6))]
    return (
        spark.createDataFrame(rules, "id string, workspace_id string, type string, threshold double, enabled boolean"),
        spark.createDataFrame(zones, "id string, timezone string"),
        spark.createDataFrame(devices, "id string, workspace_id string, name string, revoked_at timestamp, last_seen_at timestamp"),
        spark.createDataFrame([("a", 5.0, 4.0, 3), ("b", 8.0, 4.0, 3)], "workspace_id string, median double, p10 double, samples long"),
    )


def facts(spark, seed, until):
    draw = random.Random(seed)
    ago = lambda days: until - timedelta(seconds=draw.randrange(1, int(days * 86400)))
    requests = [(draw.choice("aab"), f"q{i}", f"s{i % 7}", ago(draw.choice([0.2, 1.5, 9])), draw.choice(["claude-haiku-5-5", "z"]), draw.randrange(1, 30) / 16) for i in range(150)]
    limits = [(draw.choice("abc"), f"l{i}", ago(draw.choice([0.1, 2])), "five_hour") for i in range(5)]
    return requests, limits


REQUESTS = "workspace_id string, request_id string, session_id string, ts timestamp, model string, value_usd double"
LIMITS = "workspace_id string, id string, ts timestamp, limit_kind string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tiles_fire_what_the_tables_fire(spark, seed):
    now = DAY + timedelta(days=10, hours=5, minutes=15 * seed)
    requests, limits = facts(spark, seed, now)
    kept, moved = spark.createDataFrame(requests, REQUESTS), spark.createDataFrame([r[:3] + (r[3] - timedelta(days=1),) + r[4:] for r in requests[:30]], REQUESTS)
    # 30 rows were first stored elsewhere and then replaced
    changes = tiles.request_changes(kept.limit(0), moved).unionByName(tiles.request_changes(moved, kept))
    hits = spark.createDataFrame(limits, LIMITS)
    rules, workspaces, devices, ceilings = dimensions(spark)
    want = alerts.candidates(rules, workspaces, kept, hits, devices, now, ceilings)
    got = alerts.candidates_from_tiles(rules, workspaces, changes, tiles.limit_tiles(hits), devices, ceilings, now)
    assert as_text(got, got.columns) == as_text(want, got.columns)
    assert {"daily_value", "weekly_value", "device_silent"} <= {r.type for r in want.collect()}
    plan = want._jdf.queryExecution().executedPlan().toString()
    assert "Scan" in plan
    with pytest.raises(ValueError):
        alerts.candidates_from_tiles(rules, workspaces, changes, tiles.limit_tiles(hits), devices, ceilings, now + timedelta(minutes=1))


def test_streamed_alerts_come_once(spark, tmp_path):
    folder, now = str(tmp_path / "f"), DAY + timedelta(days=10, hours=5, minutes=7)
    dims = dimensions(spark)
    delivered = []

    def step(i, rows, hits, at):
        full = deliveries(spark, rows)
        log.append(folder, "sessions", i, {"requests": full, "limit_events": spark.createDataFrame(hits, LIMITS)})
        log.compact(spark, folder)
        after = stream_alerts.after_batch(folder, "sessions", lambda s: dims, lambda: at, lambda df: delivered.append(sorted((r.rule_id, r.dedupe_key) for r in df.collect())))
        after(full, i)
        return after, full

    row = lambda r, ts, out: ("c", r, "transcript", ts, out, None)
    million = 50_000_000
    after, first = step(0, [row("r1", now - timedelta(hours=1), million)], [("c", "l1", now - timedelta(hours=1), "five_hour")], now)
    assert [rule for rule, _ in delivered[0]] == ["daily_value-c", "limit_hit-c", "weekly_value-c"]
    after(first, 0)  # the same batch again
    assert delivered[1] == delivered[0]
    step(1, [row("r2", now, million)], [], now + timedelta(minutes=30))  # the same day, week and hit
    assert delivered[2] == []
    # one more hit, which also has a workspace checked that was checked a moment ago
    step(2, [row("r3", now, 1)], [("c", "l2", now + timedelta(minutes=20), "weekly")], now + timedelta(minutes=31))
    assert [rule for rule, _ in delivered[3]] == ["limit_hit-c"]
    ledger = spark.read.schema(stream_alerts.EVENTS).parquet(f"{folder}/alert_events/sessions-*")
    assert ledger.count() == 4 and ledger.select("rule_id", "dedupe_key").distinct().count() == 4
