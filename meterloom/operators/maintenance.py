"""Housekeeping as DataFrame rewrites: retention, device removal, plan history, workspace removal, export."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import as_ts, in_range
from ..functions.text import csv_cell
from ..schemas import INGEST_LOG_DAYS, RETENTION_DAYS
from .rollups import WS

# Which clock each table ages by and how many days it keeps.
RETENTION = {
    "requests": ("ts", RETENTION_DAYS),
    "session_events": ("ts", RETENTION_DAYS),
    "error_events": ("ts", RETENTION_DAYS),
    "limit_events": ("ts", RETENTION_DAYS),
    "otel_metrics": ("ts", RETENTION_DAYS),
    "session_meta": ("updated_at", RETENTION_DAYS),
    "session_snapshots": ("updated_at", RETENTION_DAYS),
    "ingest_log": ("received_at", INGEST_LOG_DAYS),
}
DEVICE_TABLES = ("requests", "error_events", "limit_events", "otel_metrics", "ingest_log")
EXPORT_COLUMNS = (
    "ts", "session_id", "request_id", "model", "is_subagent", "agent_type", "input", "output", "cache_read",
    "cache_write_5m", "cache_write_1h", "value_usd", "project", "git_branch", "entrypoint", "effort", "speed",
)


def kept(df: DataFrame, table: str, now: datetime) -> DataFrame:
    """Rows of a table that are still within its retention."""
    clock, days = RETENTION[table]
    return df.filter(F.col(clock) >= as_ts(now - timedelta(days=days)))


def cutoff_day(table: str, now: datetime) -> datetime:
    """First day that may still hold kept rows; older day partitions can be dropped whole."""
    return datetime(*(now - timedelta(days=RETENTION[table][1])).timetuple()[:3])


def move_device(df: DataFrame, removals: DataFrame) -> DataFrame:
    """Re-attribute rows of removed devices. ``removals``: workspace, device and the device to move to (or null)."""
    moves = removals.select(WS, F.col("device_id").alias("_old"), F.col("move_to").alias("_new"))
    on = [df[WS] == moves[WS], df["device_id"] == moves["_old"]]
    joined = df.join(moves, on, "left").select(df["*"], "_old", "_new")
    target = F.when(F.col("_old").isNotNull(), F.col("_new")).otherwise(F.col("device_id"))
    return joined.withColumn("device_id", target).select(*df.columns)


def valid_removals(removals: DataFrame, devices: DataFrame) -> DataFrame:
    """Only revoked machines can be removed, and only onto another machine of the same workspace."""
    revoked = devices.filter(F.col("revoked_at").isNotNull()).select(WS, F.col("id").alias("device_id"))
    known = devices.select(WS, F.col("id").alias("move_to"))
    ok = removals.join(revoked, [WS, "device_id"], "left_semi").filter(
        F.col("move_to").isNull() | (F.col("move_to") != F.col("device_id"))
    )
    named = ok.filter(F.col("move_to").isNotNull()).join(known, [WS, "move_to"], "left_semi")
    return named.select(WS, "device_id", "move_to").unionByName(
        ok.filter(F.col("move_to").isNull()).select(WS, "device_id", "move_to")
    )


def plan_changes(old: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """Plan-history rows to append: workspaces whose plan or price changed."""
    before = old.select("id", F.struct("plan", "plan_price_usd").alias("_was"))
    joined = new.join(before, "id").filter(~F.struct("plan", "plan_price_usd").eqNullSafe(F.col("_was")))
    return joined.select(
        F.col("id").alias(WS), "plan", F.col("plan_price_usd").alias("monthly_price_usd"),
        F.to_date(as_ts(now)).alias("effective_from"),
    )


def without_workspaces(df: DataFrame, removed: DataFrame) -> DataFrame:
    """A table without the rows of removed workspaces (run over every table that names a workspace)."""
    return df.join(removed.select(WS), WS, "left_anti")


def _plain_number(value: Column) -> Column:
    """Decimal text without exponent or trailing zeros."""
    digits = value.cast("decimal(30,12)").cast("string")
    return F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", "")


def export_rows(requests: DataFrame, start, end) -> DataFrame:
    """Requests as export cells: text, formulas neutralised, nulls kept for the writer."""
    rows = requests.filter(in_range(start, end))
    cells = []
    for c in EXPORT_COLUMNS:
        if c == "ts":
            cell = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        elif c == "value_usd":
            cell = _plain_number(F.col(c))
        else:
            cell = F.col(c).cast("string")
        cells.append(csv_cell(cell).alias(c))
    return rows.select(WS, *cells)


def write_export(requests: DataFrame, start, end, path: str) -> None:
    """CSV export, one folder per workspace, ordered by time (a distributed range sort)."""
    rows = export_rows(requests, start, end).orderBy(WS, "ts", "request_id")
    options = {"header": "true", "escape": '"', "quoteAll": "false", "nullValue": "", "emptyValue": ""}
    rows.write.mode("overwrite").options(**options).partitionBy(WS).csv(path)
