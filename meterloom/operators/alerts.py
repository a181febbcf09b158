"""Alert rules: evaluate all workspaces in one plan, fire each (rule, key) once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import PRICE_BOOK
from ..functions.ranges import as_ts, hour_start, local_ts
from . import live
from .blocks import BLOCK_HOURS, learned_ceiling
from .machines import DAY_US, age_us
from .rollups import WS
from .tiles import SECONDS

_WEEK_MS = 7 * 86_400_000
_BLOCKS = timedelta(days=2)


def candidates(
    rules: DataFrame, workspaces: DataFrame, requests: DataFrame, limits: DataFrame, devices: DataFrame,
    now: datetime, ceilings: DataFrame | None = None, book=PRICE_BOOK,
) -> DataFrame:
    """Rules that hold now: ``rule_id, workspace_id, type, dedupe_key, measure, threshold``.

    Requests are read once for all rules, and once more for the ceilings unless they are given.
    """
    learned = ceilings if ceilings is not None else learned_ceiling(requests, limits, now, book=book)
    since = now - _BLOCKS - timedelta(hours=BLOCK_HOURS)
    hours = live.hours_of_facts(requests, limits, workspaces, now, since)
    return _held(rules, workspaces, devices, live.state(hours, now - _BLOCKS), learned, now)


def candidates_from_tiles(
    rules: DataFrame, workspaces: DataFrame, request_tiles: DataFrame, limit_tiles: DataFrame, devices: DataFrame,
    ceilings: DataFrame, now: datetime,
) -> DataFrame:
    """The same at a whole quarter hour, from usage tiles and the cached ceilings: no fact table is read."""
    if now.minute * 60 % SECONDS or now.second or now.microsecond:
        raise ValueError("tiles give sums at whole quarter hours only")
    since = now - _BLOCKS - timedelta(hours=BLOCK_HOURS)
    hours = live.hours_of_tiles(request_tiles, limit_tiles, workspaces, now, since)
    return _held(rules, workspaces, devices, live.state(hours, now - _BLOCKS), ceilings, now)


def _held(rules: DataFrame, workspaces: DataFrame, devices: DataFrame, states: DataFrame, ceilings: DataFrame, now: datetime) -> DataFrame:
    enabled = rules.filter("enabled").select(F.col("id").alias("rule_id"), WS, "type", "threshold")
    at, kind, threshold = as_ts(now), F.col("type"), F.col("threshold")
    known = workspaces.select(F.col("id").alias(WS), F.date_format(local_ts(at, F.col("timezone")), "yyyy-MM-dd").alias("day"))
    sides = enabled.filter(kind != "device_silent").join(known, WS, "left").join(states, WS, "left")
    sides = sides.join(ceilings.select(WS, "median"), WS, "left")

    start = hour_start(F.col("newest.start_hour"))
    inside = (at >= start) & (at < hour_start(F.col("newest.start_hour") + BLOCK_HOURS))
    pct = F.when(inside, F.col("newest.value") / F.col("median")) * 100
    day, week = (F.when(F.col("day").isNotNull(), F.coalesce(c, F.lit(0.0))) for c in ("day_value", "week_value"))
    ms = lambda c: F.unix_millis(c).cast("string")

    def by_kind(block: Column, limit: Column, daily: Column, weekly: Column) -> Column:
        return F.when(kind == "block_pct", block).when(kind == "limit_hit", limit).when(kind == "daily_value", daily).when(kind == "weekly_value", weekly)

    holds = by_kind(pct >= threshold, F.col("hit.ts") > as_ts(now - timedelta(hours=6)), day >= threshold, week >= threshold)
    key = by_kind(
        F.concat(F.lit("block:"), ms(start)), F.concat(F.lit("limit:"), ms(F.col("hit.ts"))), F.concat(F.lit("day:"), "day"),
        F.lit(f"week:{_epoch_ms(now) // _WEEK_MS}"),
    )
    usage = sides.filter(holds).select(
        "rule_id", WS, "type", key.alias("dedupe_key"), by_kind(pct, F.lit(1.0), day, week).alias("measure"), "threshold"
    )

    machines = devices.filter(F.col("revoked_at").isNull() & F.col("last_seen_at").isNotNull())
    quiet = enabled.filter(kind == "device_silent").join(machines, WS).filter(age_us(now) > threshold * DAY_US)
    # The key spells out every silent machine of the workspace, so the list has to meet in one row.
    grouped = quiet.groupBy("rule_id", WS, "type", "threshold").agg(
        F.array_join(F.array_sort(F.collect_list(quiet["id"])), ",").alias("ids"), F.count(F.lit(1)).alias("n")
    )
    day_no = _epoch_ms(now) // 86_400_000
    silent = grouped.select(
        "rule_id", WS, "type", F.concat(F.lit("silent:"), "ids", F.lit(f":{day_no}")).alias("dedupe_key"), F.col("n").cast("double").alias("measure"), "threshold"
    )
    return usage.unionByName(silent)


def _epoch_ms(now: datetime) -> int:
    return int((now - datetime(1970, 1, 1)).total_seconds() * 1000)


def unfired(found: DataFrame, fired: DataFrame) -> DataFrame:
    """Candidates not recorded before under the same rule and key: the rows to append and deliver."""
    known = fired.select("rule_id", "dedupe_key")
    return found.join(known, ["rule_id", "dedupe_key"], "left_anti")


def evaluate(
    rules, workspaces, requests, limits, devices, fired, now: datetime, ceilings=None, book=PRICE_BOOK
) -> DataFrame:
    found = candidates(rules, workspaces, requests, limits, devices, now, ceilings, book)
    return unfired(found, fired).withColumn("fired_at", as_ts(now))


def due_workspaces(workspaces: DataFrame, touched: DataFrame, now: datetime) -> DataFrame:
    """Workspaces to check after an upload: not checked within the last minute, or a limit hit arrived."""
    seen = touched.groupBy(WS).agg(F.max("has_limit").alias("_force"))
    joined = workspaces.join(seen.withColumnRenamed(WS, "id"), "id")
    idle = F.col("alerts_checked_at").isNull() | (F.col("alerts_checked_at") < as_ts(now - timedelta(minutes=1)))
    return joined.filter(F.col("_force") | idle).select(*workspaces.columns)


def rule_workspaces(rules: DataFrame) -> DataFrame:
    """Workspaces that have any enabled rule."""
    return rules.filter("enabled").select(WS).distinct()
