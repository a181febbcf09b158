"""Rule-based findings: one feature row per workspace, then one boolean rule per finding."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pricing import PRICE_BOOK, plan_label
from ..functions.ranges import as_ts
from .blocks import active_block, blocks_between, learned_ceiling, unseen_usage
from .machines import silent
from .rollups import WS, by_model, error_summary, projects, subagent_breakdown, top_n, totals
from .sessions import SESSION, session_stats, top_sessions


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the rules; pass your own to tune them."""

    block_pct: float = 0.9
    trend_blocks: int = 2
    heavy_value: float = 5.0
    opus_share: float = 0.75
    cache_drop: float = 0.15
    runaway_sessions: int = 5
    runaway_factor: float = 10.0
    runaway_floor: float = 5.0
    prompt_errors: int = 3
    subagent_share: float = 0.4
    good_multiple: float = 1.5
    low_multiple: float = 0.8
    upgrade_blocks: int = 4
    silent_days: float = 3.0


def features(
    requests: DataFrame, limits: DataFrame, errors: DataFrame, devices: DataFrame, workspaces: DataFrame,
    now: datetime, ceilings: DataFrame | None = None, book=PRICE_BOOK, rules: Thresholds = Thresholds(),
) -> DataFrame:
    """Everything the rules look at, one row per workspace."""
    week, fortnight = now - timedelta(days=7), now - timedelta(days=14)
    cur = totals(requests, workspaces, week, now, book).select(
        WS, "value", "opus_value", "cache_hit_rate", "unpriced"
    )
    prev = totals(requests, workspaces, fortnight, week, book).select(
        WS, F.col("cache_hit_rate").alias("prev_cache_hit_rate")
    )
    learned = ceilings if ceilings is not None else learned_ceiling(requests, limits, now, book=book)
    blocks = blocks_between(requests, limits, fortnight, now, book)
    limited = F.col("limits") > 0
    at = F.col("block_start")
    trend = blocks.join(learned, WS, "left").groupBy(WS).agg(
        F.count_if(limited & (at >= as_ts(week)) & (at < as_ts(now))).alias("hits_now"),
        F.count_if(limited & (at >= as_ts(fortnight)) & (at < as_ts(week))).alias("hits_prev"),
        F.count_if(unseen_usage()).alias("unseen"),
    )
    active = active_block(blocks, learned, now).select(WS, "pct_of_ceiling", "projected_pct")
    too_long = error_summary(errors, week, now).filter(F.col("reason_class") == "prompt_too_long")
    too_long = too_long.select(WS, F.col("n").alias("too_long"))
    agents = subagent_breakdown(requests, week, now).groupBy(WS).agg(F.sum("value").alias("sub_value"))
    quiet = silent(now, rules.silent_days)
    machines = devices.groupBy(WS).agg(
        F.count_if(F.col("revoked_at").isNull()).alias("live"), F.count_if(quiet).alias("silent")
    )
    out = cur
    for side in (prev, trend, active, too_long, agents, machines):
        out = out.join(side, WS, "left")
    counts = ["hits_now", "hits_prev", "unseen", "too_long", "sub_value", "live", "silent"]
    plans = workspaces.select(F.col("id").alias(WS), "plan", "plan_price_usd")
    return out.fillna(0, subset=counts).join(plans, WS)


def _rules(t: Thresholds) -> list[Column]:
    value, price = F.col("value"), F.col("plan_price_usd")
    opus = F.col("opus_value") / value
    drop = F.col("prev_cache_hit_rate") - F.col("cache_hit_rate")
    sub = F.col("sub_value") / value
    multiple = value * (30.0 / 7.0) / price
    fits = plan_label(F.col("plan")).isNotNull() & (price > 0) & (value > 0)
    heavy = value > t.heavy_value

    def rule(name: str, severity, condition: Column, measure: Column, other: Column) -> Column:
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(
            F.coalesce(condition, F.lit(False)),
            F.struct(
                F.lit(name).alias("id"), sev.alias("severity"), F.lit(None).cast("string").alias("subject"),
                measure.cast("double").alias("measure"), other.cast("double").alias("reference"),
            ),
        )

    pressed = F.when(F.col("pct_of_ceiling") >= t.block_pct, "critical").otherwise("warning")
    none = F.lit(None)
    return [
        rule("block-projection", pressed, F.col("projected_pct") >= t.block_pct, F.col("projected_pct"),
             F.col("pct_of_ceiling")),
        rule("limit-trend", "warning",
             (F.col("hits_now") >= t.trend_blocks) & (F.col("hits_now") > F.col("hits_prev")), F.col("hits_now"),
             F.col("hits_prev")),
        rule("unseen-usage", "warning", F.col("unseen") > 0, F.col("unseen"), none),
        rule("opus-heavy", "info", heavy & (opus > t.opus_share), opus, none),
        rule("cache-drop", "warning", drop > t.cache_drop, F.col("cache_hit_rate"), F.col("prev_cache_hit_rate")),
        rule("prompt-too-long", "info", F.col("too_long") >= t.prompt_errors, F.col("too_long"), none),
        rule("subagent-share", "info", heavy & (sub > t.subagent_share), sub, none),
        rule("plan-value", "good", fits & (multiple >= t.good_multiple), multiple, price),
        rule("plan-underused", "info", fits & (multiple < t.low_multiple) & (F.col("plan") != "pro"), multiple, price),
        rule("upgrade-hint", "info", fits & (F.col("plan") == "max5x") & (F.col("hits_now") >= t.upgrade_blocks),
             F.col("hits_now"), none),
        rule("device-silent", "warning", (F.col("silent") > 0) & (F.col("live") > F.col("silent")), F.col("silent"),
             F.col("live")),
        rule("unpriced", "info", F.col("unpriced") > 0, F.col("unpriced"), none),
    ]


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(3)


def runaway_sessions(requests: DataFrame, now: datetime, rules: Thresholds = Thresholds()) -> DataFrame:
    """Up to two of the week's five costliest sessions that dwarf the median session of the last 30 days."""
    stats = session_stats(requests, now - timedelta(days=30), now)
    week = requests.filter((F.col("ts") >= as_ts(now - timedelta(days=7))) & (F.col("ts") < as_ts(now)))
    value = week.groupBy(*SESSION).agg(F.sum("value_usd").alias("value"))
    top = top_sessions(value, "value", 5)
    joined = top.join(stats, WS).filter(
        (F.col("n") >= rules.runaway_sessions)
        & (F.col("median") != 0)
        & (F.col("value") > F.greatest(F.col("median") * rules.runaway_factor, F.lit(rules.runaway_floor)))
    )
    two = top_n(joined, [F.desc("value"), F.asc("session_id")], 2)
    return two.select(
        WS, F.lit("runaway").alias("id"), F.lit("info").alias("severity"), F.col("session_id").alias("subject"),
        F.col("value").alias("measure"), F.col("median").alias("reference"),
    )


def findings(
    requests: DataFrame, limits: DataFrame, errors: DataFrame, devices: DataFrame, workspaces: DataFrame,
    now: datetime, ceilings: DataFrame | None = None, book=PRICE_BOOK, rules: Thresholds = Thresholds(),
) -> DataFrame:
    """All findings, most severe first by ``severity_rank``."""
    row = features(requests, limits, errors, devices, workspaces, now, ceilings, book, rules)
    fired = row.select(WS, F.explode(F.array_compact(F.array(*_rules(rules)))).alias("_f")).select(WS, "_f.*")
    both = fired.unionByName(runaway_sessions(requests, now, rules))
    return both.withColumn("severity_rank", severity_rank(F.col("severity")))


def top_agents(requests: DataFrame, now: datetime, n: int = 3) -> DataFrame:
    """The sub-agents named by the sub-agent finding."""
    agents = subagent_breakdown(requests, now - timedelta(days=7), now)
    return top_n(agents, [F.desc("value"), F.asc("agent")], n)


def digest_facts(
    requests: DataFrame, limits: DataFrame, errors: DataFrame, devices: DataFrame, workspaces: DataFrame,
    now: datetime, ceilings: DataFrame | None = None, book=PRICE_BOOK,
) -> DataFrame:
    """Facts of the weekly digest: totals, models, five anonymous projects, blocks and finding ids.

    Lists are short by construction: one entry per model, five projects, one per rule.
    """
    week, fortnight = now - timedelta(days=7), now - timedelta(days=14)
    keep = ("requests", "sessions", "value", "opus_value", "cache_hit_rate", "active_days")
    cur = totals(requests, workspaces, week, now, book).select(WS, *keep)
    prev = totals(requests, workspaces, fortnight, week, book).select(WS, *[F.col(c).alias(f"prev_{c}") for c in keep])
    models = by_model(requests, week, now, book).groupBy(WS).agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct((-F.col("value")).alias("o"), "model_label", "requests", "value"))
            ),
            lambda m: F.struct(m["model_label"].alias("model"), m["requests"].alias("requests"),
                               F.round(m["value"], 2).alias("usd")),
        ).alias("models")
    )
    best = top_n(projects(requests, week, now), [F.desc("value"), F.asc_nulls_last("project")], 5)
    rank = F.row_number().over(W.partitionBy(WS).orderBy(F.desc("value"), F.asc_nulls_last("project")))
    named = best.withColumn("position", rank)
    top = named.groupBy(WS).agg(
        F.array_sort(
            F.collect_list(
                F.struct("position", F.concat(F.lit("project "), "position").alias("project"), "sessions",
                         F.round("value", 2).alias("usd"))
            )
        ).alias("top_projects")
    )
    limited = F.col("limits") > 0
    blocks = blocks_between(requests, limits, week, now, book).groupBy(WS).agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(limited).alias("blocks_limited")
    )
    learned = ceilings if ceilings is not None else learned_ceiling(requests, limits, now, book=book)
    found = findings(requests, limits, errors, devices, workspaces, now, learned, book).groupBy(WS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("severity_rank", "id"))), lambda f: f["id"]).alias("findings")
    )
    plans = workspaces.select(F.col("id").alias(WS), "plan", "plan_price_usd")
    out = plans
    for side in (cur, prev, models, top, blocks, learned.select(WS, F.col("median").alias("ceiling")), found):
        out = out.join(side, WS, "left")
    return out.fillna(0, subset=["blocks", "blocks_limited"])


