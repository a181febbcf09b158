"""Alerts while data streams in: rules of touched workspaces, evaluated on usage tiles, delivered once.

A micro-batch looks at the workspaces that sent something. Their rules are evaluated on the tiles that the compactor keeps
(``log.compact``), cut off at the quarter hour in which the batch arrived; neither requests nor limit hits are read again.

The ledger ``alert_events`` has a folder per stream and batch. A rule fires for a key that no other folder holds. The folder of
a batch, once it is committed, is the answer: repeating the batch reads it and evaluates nothing, so what was delivered after
the first attempt is not delivered in another form after the second.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import as_ts
from ..operators import alerts
from ..operators.rollups import WS
from ..operators.tiles import SECONDS
from ..sources.tables import exists, listed, write_text
from . import log

EVENTS = f"rule_id string, dedupe_key string, {WS} string, type string, measure double, threshold double, fired_at timestamp"
CHECKS = f"{WS} string, checked_at timestamp"


def _ledger(spark: SparkSession, folder: str, name: str, schema: str, own: str) -> DataFrame:
    """Committed rows of all folders but one's own."""
    places = [f"{folder}/{name}/{p}" for p in listed(spark, f"{folder}/{name}/_commits") if p != own]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def quarter(at: datetime) -> datetime:
    """The last whole quarter hour."""
    return datetime.fromtimestamp(at.timestamp() // SECONDS * SECONDS, at.tzinfo)


def check(
    spark: SparkSession, folder: str, name: str, touched: DataFrame, rules: DataFrame, workspaces: DataFrame, devices: DataFrame,
    ceilings: DataFrame, now: datetime,
) -> DataFrame:
    """Rows to deliver for a batch called ``name``. ``touched``: workspace_id, has_limit of what the batch brought."""
    events, checks = f"{folder}/alert_events", f"{folder}/alert_checks"
    if not exists(spark, f"{events}/_commits/{name}"):
        now = quarter(now)
        seen = _ledger(spark, folder, "alert_checks", CHECKS, name).groupBy(WS).agg(F.max("checked_at").alias("_checked")).withColumnRenamed(WS, "id")
        state = workspaces.drop("alerts_checked_at").join(seen, "id", "left").withColumnRenamed("_checked", "alerts_checked_at")
        due = alerts.due_workspaces(state, touched, now)
        due.select(F.col("id").alias(WS), as_ts(now).alias("checked_at")).write.mode("overwrite").parquet(f"{checks}/{name}")
        due = spark.read.schema(CHECKS).parquet(f"{checks}/{name}").select(WS)
        mine = lambda df: df.join(due, WS, "left_semi")
        week = now - timedelta(days=7)
        found = alerts.candidates_from_tiles(
            mine(rules), workspaces, mine(log.read_tiles(spark, folder, "request_tiles", week)), mine(log.read_tiles(spark, folder, "limit_tiles", week)),
            mine(devices), ceilings, now,
        )
        new = alerts.unfired(found, _ledger(spark, folder, "alert_events", EVENTS, name)).withColumn("fired_at", as_ts(now))
        new.select(*[c.split(" ")[0] for c in EVENTS.split(", ")]).write.mode("overwrite").parquet(f"{events}/{name}")
        write_text(spark, f"{checks}/_commits/{name}", "")
        write_text(spark, f"{events}/_commits/{name}", "")
    return spark.read.schema(EVENTS).parquet(f"{events}/{name}")


def after_batch(
    folder: str, source: str, dimensions: Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame, DataFrame]],
    clock: Callable[[], datetime], deliver: Callable[[DataFrame], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """The ``after`` step of an ingest stream. ``dimensions`` gives rules, workspaces, devices and cached ceilings."""

    def after(deliveries: DataFrame, batch_id: int) -> None:
        spark = deliveries.sparkSession
        used = deliveries.select(WS, F.lit(False).alias("has_limit"))
        hits = f"{folder}/log/limit_events/stream={source}/batch={batch_id}"
        if exists(spark, hits):
            used = used.unionByName(spark.read.parquet(hits).select(WS, F.lit(True).alias("has_limit")))
        rows = check(spark, folder, f"{source}-{batch_id:012d}", used, *dimensions(spark), clock())
        if deliver is not None:
            deliver(rows)

    return after
