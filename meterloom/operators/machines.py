"""Machines (devices) and the cross-workspace administration view."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import PRICE_BOOK, model_family, with_prices
from ..functions.ranges import as_ts
from .rollups import WS, by_machine, filtered, with_share

DAY_US = 86_400_000_000
NO_MACHINE = "Not attributed to a machine"
REMOVED = "Removed machine"


def age_us(now: datetime, ts: str = "last_seen_at") -> Column:
    return F.unix_micros(as_ts(now)) - F.unix_micros(ts)


def silent(now: datetime, days: float = 3) -> Column:
    """Enrolled machine that reported once but not lately. A machine never seen is not silent here."""
    return F.col("revoked_at").isNull() & F.coalesce(age_us(now) > F.lit(days) * DAY_US, F.lit(False))


def stale(now: datetime, days: float = 3) -> Column:
    """Enrolled machine without a recent upload; here a machine never seen counts too."""
    return F.col("revoked_at").isNull() & F.coalesce(age_us(now) > F.lit(days) * DAY_US, F.lit(True))


def devices_with_stats(devices: DataFrame, requests: DataFrame, now: datetime) -> DataFrame:
    """Every machine with its requests and value of the last seven days."""
    recent = requests.filter(F.col("ts") > as_ts(now - timedelta(days=7)))
    n = recent.filter(F.col("device_id").isNotNull()).groupBy(WS, "device_id").agg(
        F.count(F.lit(1)).alias("requests_7d"), F.sum("value_usd").alias("value_7d")
    )
    joined = devices.join(n.withColumnRenamed("device_id", "id"), [WS, "id"], "left")
    return joined.withColumn("requests_7d", F.coalesce("requests_7d", F.lit(0))).withColumn(
        "value_7d", F.coalesce("value_7d", F.lit(0.0))
    )


def in_device_order(devices: DataFrame) -> DataFrame:
    """Live machines first, then by last upload, never-seen last (a distributed range sort)."""
    return devices.orderBy(WS, F.asc_nulls_first("revoked_at"), F.desc_nulls_last("last_seen_at"), F.asc("id"))


def machine_usage(requests: DataFrame, devices: DataFrame, start, end) -> DataFrame:
    """Usage per machine with its name and share; ids without a machine get a fallback name."""
    names = devices.select(WS, F.col("id").alias("device_id"), F.col("name").alias("_name"))
    usage = with_share(by_machine(requests, start, end)).join(names, [WS, "device_id"], "left")
    name = F.when(F.col("device_id").isNull(), NO_MACHINE).otherwise(F.coalesce("_name", F.lit(REMOVED)))
    return usage.withColumn("machine", name).drop("_name")


def idle_machines(requests: DataFrame, devices: DataFrame, start, end) -> DataFrame:
    """Enrolled machines without usage in range."""
    used = filtered(requests, start, end).select(WS, F.col("device_id").alias("id")).distinct()
    return devices.filter(F.col("revoked_at").isNull()).join(used, [WS, "id"], "left_anti")


def busiest_machine(usage: DataFrame) -> DataFrame:
    """The machine with the highest value per workspace (ties: the smaller id, requests without a machine last)."""
    best = F.min_by(
        F.struct("device_id", "value", "share"),
        F.struct(-F.col("value"), F.col("device_id").isNull(), F.col("device_id")),
    )
    return usage.groupBy(WS).agg(best.alias("_b")).select(WS, "_b.*")


def completeness(devices: DataFrame, now: datetime) -> DataFrame:
    """Machines reporting out of machines enrolled."""
    live = F.col("revoked_at").isNull()
    return devices.groupBy(WS).agg(
        F.count_if(live).alias("live"),
        F.count_if(live & ~stale(now)).alias("reporting"),
        F.count_if(stale(now)).alias("stale"),
    )


def admin_overview(
    workspaces: DataFrame, users: DataFrame, memberships: DataFrame, devices: DataFrame, requests: DataFrame,
    now: datetime, days: int = 30,
) -> DataFrame:
    """One row per workspace: owner, members, machines, last upload and usage. Every side is aggregated first."""
    per_session = requests.filter(F.col("ts") > as_ts(now - timedelta(days=days))).groupBy(WS, "session_id").agg(
        F.sum("value_usd").alias("value"), F.count(F.lit(1)).alias("requests")
    )
    used = per_session.groupBy(WS).agg(
        F.sum("value").alias("value"), F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("sessions")
    )
    members = memberships.groupBy(WS).agg(F.count(F.lit(1)).alias("members"))
    live = F.col("revoked_at").isNull()
    machines = devices.groupBy(WS).agg(
        F.count_if(live).alias("machines"),
        F.count_if(live & (F.col("last_seen_at") > as_ts(now - timedelta(days=7)))).alias("machines_reporting_7d"),
        F.max("last_seen_at").alias("last_upload"),
    )
    owners = users.select(F.col("id").alias("owner_id"), F.col("email").alias("owner_email"))
    base = workspaces.select(F.col("id").alias(WS), "name", "plan", "plan_price_usd", "created_at", "owner_id")
    out = base.join(owners, "owner_id", "left")
    for side in (members, machines, used):
        out = out.join(side, WS, "left")
    counts = ["members", "machines", "machines_reporting_7d", "value", "requests", "sessions"]
    return out.fillna(0, subset=counts).withColumn(
        "silent_machines", F.col("machines") - F.col("machines_reporting_7d")
    ).drop("owner_id")


def admin_mix(requests: DataFrame, now: datetime, days: int = 30, book=PRICE_BOOK) -> DataFrame:
    """Family mix per workspace, totals per model and the grand total, as grouping sets over one pre-aggregate."""
    recent = requests.filter(F.col("ts") > as_ts(now - timedelta(days=days)))
    level = recent.groupBy(WS, "model").agg(F.sum("value_usd").alias("value"), F.count(F.lit(1)).alias("requests"))
    priced = with_prices(level, book).select(WS, "model", model_family().alias("family"), "value", "requests")
    sets = [[WS, "family"], ["model"], []]
    return priced.groupingSets(
        [[F.col(c) for c in s] for s in sets], F.col(WS), F.col("family"), F.col("model")
    ).agg(
        F.grouping_id().alias("set_id"), F.sum("value").alias("value"), F.sum("requests").alias("requests")
    )


def family_shares(mix: DataFrame, smallest: float = 0.05) -> DataFrame:
    """Families that make up at least 5 % of a workspace's value."""
    families = mix.filter(F.col(WS).isNotNull()).select(WS, "family", "value", "requests")
    return with_share(families).filter((F.col("share") >= smallest) & (F.col("value") > 0))


def admin_totals(overview: DataFrame) -> DataFrame:
    sums = ("members", "machines", "value", "requests")
    return overview.agg(
        F.count(F.lit(1)).alias("workspaces"),
        F.count_if(F.col("requests") > 0).alias("active_workspaces"),
        *[F.sum(c).alias(c) for c in sums],
    )


def active_workspaces(workspaces: DataFrame, requests: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """Workspaces with any request in the last days (semi-join; request ids are never counted)."""
    recent = requests.filter(F.col("ts") > as_ts(now - timedelta(days=days))).select(F.col(WS).alias("id"))
    return workspaces.join(recent.distinct(), "id", "left_semi")
