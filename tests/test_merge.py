import random
from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from meterloom.functions.pricing import price_requests
from meterloom.operators import merge
from meterloom.schemas import DELIVERIES, REQUESTS

TS = datetime(2024, 11, 5, 21, 40)
BASE = {
    "workspace_id": "w7", "request_id": "q-a", "session_id": "night", "ts": TS, "model": "claude-haiku-4-5", "source": "transcript",
    "is_subagent": False, "input": 31, "output": 100, "cache_read": 770, "cache_write_5m": 12, "cache_write_1h": 90, "web_search": 1, "web_fetch": 0,
    "device_id": "laptop", "speed": "standard", "effort": "low", "entrypoint": "desktop", "project": "maps",
}


def deliveries(spark, *items):
    data = []
    for i, item in enumerate(items):
        row = {**BASE, "seq": i, **item}
        data.append(tuple(row.get(n) for n in DELIVERIES.names))
    return spark.createDataFrame(data, DELIVERIES)


def test_merged_rows_are_priced_by_what_they_ended_up_with(spark):
    """Value of the merged row, not of any upload: it follows the largest output and the winner's other counts."""
    rng = random.Random(17)
    for _ in range(3):
        uploads = [{"output": rng.randrange(900), "input": rng.randrange(90), "source": rng.choice(["transcript", "otel"])} for _ in range(6)]
        row = merge.merge_deliveries(deliveries(spark, *uploads), hot_rows=None)
        again = price_requests(row.drop("value_usd", "priced"))
        assert rows(row, "value_usd", "priced") == rows(again, "value_usd", "priced")
        assert row.first().output == max(u["output"] for u in uploads)
        assert row.first().sources == sorted({u["source"] for u in uploads})


def test_duplicate_predicate(spark):
    stored = F.struct(F.array(F.lit("transcript")).alias("sources"), F.lit(300).alias("output"), F.lit(20).alias("thinking"))
    data = [(300, 20), (120, None), (301, 20), (300, 25)]
    df = spark.createDataFrame(data, "output int, thinking int").withColumn("stored", stored)
    assert [r[0] for r in df.select(merge.is_duplicate()).collect()] == [True, True, False, False]
    telemetry = df.withColumn("stored", F.col("stored").withField("sources", F.array(F.lit("otel"))))
    assert not any(r[0] for r in telemetry.select(merge.is_duplicate()).collect())


# ---- property test against a one-by-one replay -----------------------------------------------------


def replay(history):
    """Straight replay of a delivery history: the stored row after every upload, and duplicates."""
    row, duplicates = None, 0
    for d in history:
        if d["source"] == "transcript":
            has_t = row is not None and "transcript" in row["sources"]
            think = d["thinking"] or 0
            if has_t and d["output"] <= row["output"] and think <= (row["thinking"] or 0):
                duplicates += 1
                continue
            new = dict(d)
            if row is not None:
                new["output"] = max(row["output"], d["output"])
                both = [x for x in (row["thinking"], d["thinking"]) if x is not None]
                new["thinking"] = max([*both, 0]) if both else None
                new["device_id"] = row["device_id"] if row["device_id"] is not None else d["device_id"]
                for c in ("duration_ms", "query_source"):
                    new[c] = row[c]
            new["sources"] = sorted({*(row["sources"] if row else []), "transcript"})
            row = new
        elif row is not None and "transcript" in row["sources"]:
            row = dict(row)
            row["output"] = max(row["output"], d["output"])
            for c in ("duration_ms", "query_source"):
                row[c] = d[c] if d[c] is not None else row[c]
            row["sources"] = sorted({*row["sources"], "otel"})
        else:
            new = dict(d)
            new["thinking"] = None
            if row is not None:
                new["output"] = max(row["output"], d["output"])
                new["device_id"] = row["device_id"] if row["device_id"] is not None else d["device_id"]
                new["is_subagent"] = row["is_subagent"]
            else:
                new["is_subagent"] = d["agent_type"] is not None
            new["sources"] = ["otel"]
            row = new
    return row, duplicates


def random_history(rng, request):
    out = []
    for seq in range(rng.randrange(1, 9)):
        t = rng.random() < 0.6
        out.append(
            {
                "workspace_id": "ws", "request_id": request, "seq": seq * 10 + rng.randrange(10),
                "source": "transcript" if t else "otel", "session_id": f"s{seq}", "ts": TS, "model": "m",
                "output": rng.randrange(4), "thinking": rng.choice([None, 0, 1, 2]) if t else None,
                "input": seq, "cache_read": 0, "cache_write_5m": seq, "cache_write_1h": 0,
                "device_id": rng.choice([None, "a", "b"]), "is_subagent": rng.random() < 0.5 if t else None,
                "agent_type": rng.choice([None, "x"]), "duration_ms": None if t else rng.choice([None, seq]),
                "query_source": None if t else rng.choice([None, f"q{seq}"]),
            }
        )
    return out


CHECKED = ("session_id", "output", "thinking", "device_id", "input", "cache_write_5m", "is_subagent", "agent_type",
           "duration_ms", "query_source", "sources")


def test_replay_equivalence(spark):
    rng = random.Random(11)
    histories = {f"r{i}": random_history(rng, f"r{i}") for i in range(1500)}
    data = [tuple(d.get(n) for n in DELIVERIES.names) for h in histories.values() for d in h]
    df = spark.createDataFrame(data, DELIVERIES).repartition(6).cache()
    want = {k: replay(h) for k, h in histories.items()}

    def check(found):
        got = {r["request_id"]: r for r in found}
        assert set(got) == set(want)
        for k, (row, _) in want.items():
            assert {c: got[k][c] for c in CHECKED} == {c: row[c] for c in CHECKED}, histories[k]

    check(merge.merge_deliveries(df, hot_rows=None).collect())
    check(merge.merge_deliveries(df).collect())
    # every key treated as hot, cut into four slices
    check(merge.merge_deliveries(df, hot_rows=1, parts=4).collect())
    # incremental: first part stored, second part merged onto the stored rows
    first = merge.merge_deliveries(df.filter("seq < 30"), hot_rows=None)
    stored = spark.createDataFrame(first.collect(), REQUESTS)
    incoming = df.filter("seq >= 30")
    changed = merge.upsert_requests(stored, incoming, hot_rows=None)
    same = stored.join(incoming.select(*merge.REQUEST).distinct(), merge.REQUEST, "left_anti")
    check(same.unionByName(changed).collect())
    counts = {r[0]: r["deduplicated"] for r in merge.merge_counts(df, ["request_id"], 1).collect()}
    assert counts == {k: d for k, (_, d) in want.items()}


def test_replay_of_a_request_with_half_of_all_uploads_and_thousands_of_hot_ones(spark):
    """The default way with a lower bound: one request has half of the uploads, at uneven numbers, 5,000 more are hot too."""
    rng = random.Random(7)
    histories = {"half": [], **{f"r{i}": [] for i in range(5_000)}}
    for request, history in histories.items():
        seq = 0
        for _ in range(20_000 if request == "half" else 4):
            seq += rng.choice([1, 1, 2, 1 << 40])
            t = rng.random() < 0.5
            history.append({
                "workspace_id": "ws", "request_id": request, "seq": seq, "source": "transcript" if t else "otel", "session_id": f"s{len(history)}",
                "ts": TS, "model": "m", "output": rng.randrange(len(history) + 2), "thinking": rng.choice([None, 3]) if t else None, "input": 1,
                "cache_read": 0, "cache_write_5m": len(history), "cache_write_1h": 0, "device_id": rng.choice([None, "a"]), "is_subagent": False if t else None,
                "agent_type": None, "duration_ms": None if t else rng.choice([None, seq]), "query_source": None,
            })
    data = [tuple(d.get(n) for n in DELIVERIES.names) for h in histories.values() for d in h]
    df = spark.createDataFrame(data, DELIVERIES).repartition(8).cache()
    got = {r.request_id: r for r in merge.merge_deliveries(df, hot_rows=4, parts=16).collect()}
    assert len(got) == len(histories)
    for request, history in histories.items():
        want = replay(history)[0]
        assert {c: got[request][c] for c in CHECKED} == {c: want[c] for c in CHECKED}, request


def test_custom_title_is_never_replaced(spark):
    data = [("w", "s", 1, "gen", "ai", None), ("w", "s", 2, "mine", "custom", None), ("w", "s", 3, "gen2", "ai", "agent"),
            ("w", "s", 4, None, None, None), ("w", "s", 5, "mine2", "custom", None), ("w", "s", 6, "mine2", "custom", None)]
    df = spark.createDataFrame(data, "workspace_id string, session_id string, seq int, title string, title_source string, agent_name string")
    assert [tuple(r) for r in merge.merge_meta(df).collect()] == [("w", "s", "mine2", "custom", "agent")]
    for hot in (1, 1000):
        changed = merge.meta_changes(df, hot_rows=hot, parts=2).orderBy("seq")
        assert [r["changed"] for r in changed.collect()] == [True, True, True, False, True, False]
