"""Plan value: what the subscription returned, per cycle and projected."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranges import as_ts, cycle_start_col, in_range, local_day, with_workspace
from .rollups import WS, value_by_cycle


def cycle_daily(requests: DataFrame, workspaces: DataFrame, now: datetime) -> DataFrame:
    """Value per local day of the running cycle, with its cumulative sum.

    Each workspace has its own cycle start. No cycle is longer than 31 days, so a literal bound prunes the
    scan before the per-workspace bound applies.
    """
    recent = requests.filter(in_range(now - timedelta(days=32), now))
    base = with_workspace(recent, workspaces, "timezone", "billing_day")
    base = base.filter(F.col("ts") >= cycle_start_col(as_ts(now), F.col("billing_day")))
    daily = base.groupBy(WS, local_day(F.col("ts"), F.col("timezone")).alias("day")).agg(
        F.sum("value_usd").alias("value")
    )
    up_to = W.partitionBy(WS).orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.withColumn("cumulative", F.sum("value").over(up_to))


def plan_value(requests: DataFrame, workspaces: DataFrame, now: datetime) -> DataFrame:
    """Cycle value, multiple of the plan price, break-even day and projection, one row per workspace."""
    daily = cycle_daily(requests, workspaces, now)
    prices = workspaces.select(F.col("id").alias(WS), "plan", "plan_price_usd", "billing_day")
    reached = (F.col("plan_price_usd") > 0) & (F.col("cumulative") >= F.col("plan_price_usd"))
    summary = daily.join(prices.select(WS, "plan_price_usd"), WS).groupBy(WS).agg(
        F.sum("value").alias("cycle_value"), F.min(F.when(reached, F.col("day"))).alias("break_even_day")
    )
    out = prices.join(summary, WS, "left").fillna(0.0, subset=["cycle_value"])
    start = cycle_start_col(as_ts(now), F.col("billing_day"))
    elapsed = F.greatest(F.lit(1.0), (F.unix_micros(as_ts(now)) - F.unix_micros(start)) / 86_400_000_000)
    price, value = F.col("plan_price_usd"), F.col("cycle_value")
    return (
        out.withColumn("cycle_start", start)
        .withColumn("multiple", F.when(price > 0, value / price))
        .withColumn("to_break_even", F.when(price > 0, F.greatest(F.lit(0.0), price - value)))
        .withColumn("projected", value / elapsed * 30.4)
        .withColumn("projected_multiple", F.when(price > 0, F.col("projected") / price))
        .drop("billing_day")
    )


def price_in_force(cycles: DataFrame, periods: DataFrame, workspaces: DataFrame) -> DataFrame:
    """As-of join: the newest plan period effective by the 28th of the cycle, else the workspace price.

    Both sides are tiny per workspace (one row per month, one per plan change).
    """
    until = F.to_date(F.concat("cycle", F.lit("-28")))
    joined = cycles.select(WS, "cycle").distinct().join(periods, WS).filter(F.col("effective_from") <= until)
    order = F.struct("effective_from", "id") if "id" in periods.columns else F.struct("effective_from", "plan")
    found = joined.groupBy(WS, "cycle").agg(F.max_by("monthly_price_usd", order).alias("_price"))
    default = workspaces.select(F.col("id").alias(WS), "plan_price_usd")
    return (
        cycles.join(found, [WS, "cycle"], "left")
        .join(default, WS, "left")
        .withColumn("price", F.coalesce("_price", "plan_price_usd"))
        .drop("_price", "plan_price_usd")
    )


def cycle_table(requests: DataFrame, workspaces: DataFrame, periods: DataFrame) -> DataFrame:
    """Billing cycles with the price in force and the multiple of it."""
    priced = price_in_force(value_by_cycle(requests, workspaces), periods, workspaces)
    return priced.withColumn("multiple", F.when(F.col("price") > 0, F.col("value") / F.col("price")))
