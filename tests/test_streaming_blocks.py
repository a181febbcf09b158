"""Blocks of two streams against the batch form over what the watermark has closed."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meterloom.operators.blocks import build_blocks
from meterloom.session import stream_settings
from meterloom.streaming.blocks import current_blocks, stream_blocks

REQUESTS = "workspace_id string, request_id string, ts timestamp, model string, value_usd double"
LIMITS = "workspace_id string, id string, ts timestamp, limit_kind string"
DAY = datetime(2024, 5, 6)
DELAY = timedelta(minutes=30)


def streamed(spark, folder, requests, limits):
    """Each list of rows is a file, and each file a micro-batch."""
    streams = []
    for name, parts, schema in (("requests", requests, REQUESTS), ("limits", limits, LIMITS)):
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{name}/part={i}")
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}/part=*"))
    updates = stream_blocks(*streams, "30 minutes")
    with stream_settings(spark):
        query = updates.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    return spark.read.schema(updates.schema).parquet(f"{folder}/out")


def test_two_streams_give_the_blocks_of_the_batch(spark, tmp_path):
    draw = random.Random(11)
    events, hits = [], []
    for at in range(0, 48 * 60, 3):  # in order of arrival; each up to 25 minutes late
        when = DAY + timedelta(minutes=at) - timedelta(seconds=draw.randrange(25 * 60))
        ws = draw.choice(["a", "a", "a", "b", "c"])
        if ws == "b" and 600 < at < 1500:
            continue  # a long pause between blocks
        if draw.random() < 0.12 or (ws == "c" and at > 900):  # at last c has nothing but limit hits
            hits.append((ws, f"l{at}", when, draw.choice(["five_hour", "weekly", "unknown"])))
        else:
            events.append((ws, f"r{at}", when, draw.choice(["claude-opus-5-5", "claude-haiku-5-5", "unheard-of"]), float(draw.randrange(1, 50))))
    # Both streams end at the same instant, so that one watermark holds.
    end = DAY + timedelta(hours=50)
    events.append(("z", "end", end, "unheard-of", 1.0))
    hits.append(("z", "end", end, "weekly"))
    cut = lambda rows: [rows[i : i + len(rows) // 4 + 1] for i in range(0, len(rows), len(rows) // 4 + 1)]
    updates = streamed(spark, str(tmp_path), cut(events), cut(hits)).cache()
    got = current_blocks(updates)

    closed = (end - DELAY).replace(minute=0, second=0, microsecond=0)
    inside = F.col("ts") < F.lit(closed)
    want = build_blocks(spark.createDataFrame(events, REQUESTS).where(inside), spark.createDataFrame(hits, LIMITS).where(inside)).drop("last_limit")
    columns = want.columns
    table = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert table(got) == table(want)
    assert want.where("requests = 0 and limits > 0").count() > 0
    assert want.where("value_at_limit is not null and value_at_limit < value").count() > 0

    # A block is final once the watermark has passed its end; the timer says so without another event of the workspace.
    finals = {(r.workspace_id, r.block_start): r.final for r in got.collect()}
    newest = {ws: max(s for w, s in finals if w == ws) for ws, _ in finals}
    assert {k: k[1] + timedelta(hours=5) <= end - DELAY or k[1] < newest[k[0]] for k in finals} == finals
    assert any(finals[w, s] for w, s in newest.items()) and updates.where("not final").count() > 0
