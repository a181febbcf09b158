"""What is true of every workspace now, from one pass over its recent hours.

Requests (or usage tiles) collapse to one row per workspace and hour, which carries every sum that some rule needs as a
conditional sum. A second grouping puts a workspace's hours, bounded by the calendar, into one array; blocks are folds over it.
So the live view and all alert rules read their requests once.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import PRICE_BOOK
from ..functions.ranges import as_ts, hour_of, hour_start, in_range, local_ts
from .blocks import BLOCK_HOURS, _block_positions, learned_ceiling
from .rollups import WS
from .tiles import SECONDS

DAY = timedelta(hours=26)  # a local day began less than that before now
WEEK = timedelta(days=7)
_HOUR = ("hour", "requests", "value", "first_ts", "limits", "last_limit")


def day_start(now: datetime, tz: str = "timezone") -> Column:
    """Local midnight of the workspace, as an instant."""
    return F.to_utc_timestamp(F.date_trunc("DAY", local_ts(as_ts(now), F.col(tz))), F.col(tz))


def _zones(workspaces: DataFrame, now: datetime) -> DataFrame:
    return workspaces.select(F.col("id").alias(WS), day_start(now).alias("midnight"))


def _sums(at: Column, value: Column, n: Column, first: Column, since: datetime, now: datetime) -> list[Column]:
    """Sums of an hour: of its part that blocks read, of the local day, of the last seven days."""
    in_blocks = at >= as_ts(since)
    return [
        F.sum(F.when(in_blocks, n).otherwise(0)).alias("requests"),
        F.sum(F.when(in_blocks, value).otherwise(0.0)).alias("value"),
        F.min(F.when(in_blocks, first)).alias("first_ts"),
        F.sum(F.when((at >= F.col("midnight")) & (at >= as_ts(now - DAY)), value)).alias("day_value"),
        F.sum(F.when(at >= as_ts(now - WEEK), value)).alias("week_value"),
    ]


def hours_of_facts(requests: DataFrame, limits: DataFrame, workspaces: DataFrame, now: datetime, since: datetime) -> DataFrame:
    """Hours of the last week; blocks read from ``since`` on."""
    recent = requests.filter(in_range(min(since, now - WEEK), now)).join(_zones(workspaces, now), WS, "left")
    used = recent.groupBy(WS, hour_of(F.col("ts")).alias("hour")).agg(*_sums(F.col("ts"), F.col("value_usd"), F.lit(1), F.col("ts"), since, now))
    hits = limits.filter(in_range(since, now)).groupBy(WS, hour_of(F.col("ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("limits"), F.max(F.struct("ts", "id", "limit_kind")).alias("last_limit"), F.min("ts").alias("first_limit")
    )
    return _both(used, hits)


def hours_of_tiles(request_tiles: DataFrame, limit_tiles: DataFrame, workspaces: DataFrame, now: datetime, since: datetime) -> DataFrame:
    """The same from tiles. ``now`` and ``since`` are whole quarter hours; first events are known to the quarter hour."""
    at = F.timestamp_seconds(F.col("slot") * SECONDS)
    hour = F.floor(F.col("slot") * SECONDS / 3600).cast("long").alias("hour")
    inside = lambda start: (at >= as_ts(start)) & (at < as_ts(now))
    # All changes of a tile first: what a merge took away again must not count as an active quarter hour.
    net = request_tiles.filter(inside(min(since, now - WEEK))).groupBy(WS, "slot").agg(F.sum("requests").alias("n"), F.sum("value").alias("v")).filter("n <> 0")
    recent = net.join(_zones(workspaces, now), WS, "left")
    used = recent.groupBy(WS, hour).agg(*_sums(at, F.col("v"), F.col("n"), at, since, now))
    hits = limit_tiles.filter(inside(since)).groupBy(WS, hour).agg(
        F.sum("limits").alias("limits"), F.max("last_limit").alias("last_limit"), F.min(at).alias("first_limit")
    )
    return _both(used, hits)


def _both(used: DataFrame, hits: DataFrame) -> DataFrame:
    rows = used.join(hits, [WS, "hour"], "full")
    return rows.select(
        WS, "hour", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("value", F.lit(0.0)).alias("value"),
        F.least("first_ts", "first_limit").alias("first_ts"), F.coalesce("limits", F.lit(0)).alias("limits"), "last_limit",
        "day_value", "week_value",
    )


def state(hours: DataFrame, after: datetime) -> DataFrame:
    """One row per workspace: the newest block and the newest limit hit's block among those that end after ``after``, the
    value of the local day and of the last seven days (null without usage)."""
    active = (F.col("requests") > 0) | (F.col("limits") > 0)
    grouped = hours.groupBy(WS).agg(
        F.array_sort(F.collect_list(F.when(active, F.struct(*_HOUR)))).alias("hours"),
        F.sum("day_value").alias("day_value"),
        F.sum("week_value").alias("week_value"),
    )

    def block(at: Column) -> Column:
        start = F.element_at("hours", at)["hour"]
        own = F.filter(F.slice("hours", at, BLOCK_HOURS), lambda x: x["hour"] < start + BLOCK_HOURS)
        total = lambda field, zero: F.aggregate(own, zero, lambda acc, x: acc + x[field])
        return F.struct(
            start.alias("start_hour"), total("requests", F.lit(0).cast("long")).alias("requests"), total("value", F.lit(0.0)).alias("value"),
            F.array_min(F.transform(own, lambda x: x["first_ts"])).alias("first_ts"), total("limits", F.lit(0).cast("long")).alias("limits"),
            F.array_max(F.transform(own, lambda x: x["last_limit"])).alias("last_limit"),
        )

    cut = F.unix_seconds(as_ts(after))
    blocks = grouped.withColumn("blocks", F.filter(F.transform(_block_positions(F.col("hours")), block), lambda b: (b["start_hour"] + BLOCK_HOURS) * 3600 > cut))
    last = lambda c: F.try_element_at(c, F.lit(-1))
    return blocks.select(
        WS, last(F.col("blocks")).alias("newest"), last(F.filter("blocks", lambda b: b["limits"] > 0))["last_limit"].alias("hit"), "day_value", "week_value"
    )


def live_view(requests, limits, ingest_log, workspaces, now: datetime, ceilings=None, book=PRICE_BOOK) -> DataFrame:
    """One row per workspace: active block (or zeros), its burn rate, projection and share of the ceiling, and last upload.

    Blocks of the last six hours are rebuilt from eleven hours of events; the ceiling comes from the cached
    table when given, else from everything kept.
    """
    after = now - timedelta(hours=6)
    since = after - timedelta(hours=BLOCK_HOURS)
    recent = state(hours_of_facts(requests.filter(in_range(since, now)), limits, workspaces, now, since), after)
    learned = ceilings if ceilings is not None else learned_ceiling(requests, limits, now, book=book)
    last = ingest_log.groupBy(WS).agg(F.max("received_at").alias("last_ingest"))
    base = workspaces.select(F.col("id").alias(WS))
    joined = base.join(recent.select(WS, "newest"), WS, "left").join(learned, WS, "left").join(last, WS, "left")

    at, now_us = as_ts(now), F.unix_micros(as_ts(now))
    start, end = hour_start(F.col("newest.start_hour")), hour_start(F.col("newest.start_hour") + BLOCK_HOURS)
    inside = F.coalesce((at >= start) & (at < end), F.lit(False))
    hours = F.greatest(now_us - F.unix_micros("newest.first_ts"), F.lit(15 * 60 * 1_000_000)) / 3_600_000_000
    burn = F.col("newest.value") / hours
    projected = F.col("newest.value") + burn * ((F.unix_micros(end) - now_us) / 1000) / 3_600_000
    running = lambda c, name: F.when(inside, c).alias(name)
    zero = lambda c, name: F.when(inside, c).otherwise(F.lit(0)).alias(name)
    return joined.select(
        WS, inside.alias("active"), zero(F.col("newest.value"), "value"), zero(F.col("newest.requests"), "requests"),
        zero(burn, "burn_per_hour"), zero(projected, "projected"),
        running(F.col("newest.value") / F.col("median"), "pct_of_ceiling"), running(projected / F.col("median"), "projected_pct"),
        F.col("median").alias("ceiling"), F.coalesce("samples", F.lit(0)).alias("ceiling_samples"),
        running(start, "block_start"), running(end, "block_end"), "last_ingest",
    )
