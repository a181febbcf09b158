"""Named ranges, billing cycles and local wall-clock helpers."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RETENTION_DAYS


class Span(NamedTuple):
    key: str
    start: datetime
    end: datetime
    prev_start: datetime
    prev_end: datetime


def cycle_start(now: datetime, billing_day: int) -> datetime:
    """Start (UTC) of the billing cycle containing ``now``; billing days past 28 count as 28."""
    start = datetime(now.year, now.month, min(billing_day, 28))
    if start > now:
        year, month = (now.year, now.month - 1) if now.month > 1 else (now.year - 1, 12)
        start = start.replace(year=year, month=month)
    return start


def resolve_range(key: str | None, billing_day: int, now: datetime) -> Span:
    """Named range to half-open bounds plus the equally long period before it; unknown names mean 30 days."""
    days = {"24h": 1, "7d": 7, "30d": 30, "all": RETENTION_DAYS}
    name = key if key in (*days, "cycle", "mtd") else "30d"
    if name == "cycle":
        start = cycle_start(now, billing_day)
    elif name == "mtd":
        start = datetime(now.year, now.month, 1)
    else:
        start = now - timedelta(days=days[name])
    return Span(name, start, now, start - (now - start), start)


def cycle_start_col(now: Column, billing_day: Column) -> Column:
    """Column form of :func:`cycle_start`, for a billing day per workspace."""
    first = F.make_date(F.year(now), F.month(now), F.least(billing_day, F.lit(28)))
    as_ts = first.cast("timestamp")
    return F.when(as_ts > now, F.add_months(first, -1).cast("timestamp")).otherwise(as_ts)


def as_ts(value: datetime | Column) -> Column:
    """A timestamp column from a (naive UTC) datetime or an existing column."""
    return value if isinstance(value, Column) else F.lit(value.isoformat(sep=" ")).cast("timestamp")


def in_range(start: datetime | Column, end: datetime | Column, ts: str = "ts") -> Column:
    """Half-open time filter. Literal bounds fold to constants and reach the Parquet scan."""
    return (F.col(ts) >= as_ts(start)) & (F.col(ts) < as_ts(end))


def local_ts(ts: Column, tz: Column | str) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_day(ts: Column, tz: Column | str) -> Column:
    return F.date_format(local_ts(ts, tz), "yyyy-MM-dd")


def hour_of(ts: Column) -> Column:
    """Whole UTC hours since the epoch."""
    return F.floor(F.unix_seconds(ts) / 3600).cast("long")


def hour_start(hour: Column) -> Column:
    return F.timestamp_seconds(hour * 3600)


def with_workspace(df: DataFrame, workspaces: DataFrame, *columns: str) -> DataFrame:
    """Attach workspace columns. Small dimensions broadcast by measured size, large ones shuffle."""
    dims = workspaces.select(F.col("id").alias("workspace_id"), *columns)
    return df.join(dims, "workspace_id")
