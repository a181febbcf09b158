"""Range roll-ups: totals, daily, per model, project, machine, heatmap, cycles, quality."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pricing import PRICE_BOOK, cache_savings, model_family, model_label, with_prices
from ..functions.ranges import as_ts, in_range, local_day, local_ts, with_workspace
from ..functions.text import contains_ci

WS = "workspace_id"


def filtered(
    requests: DataFrame,
    start: datetime | Column,
    end: datetime | Column,
    model: str | None = None,
    project: str | None = None,
    device: str | None = None,
) -> DataFrame:
    """Half-open time range plus optional equality filters."""
    out = requests.filter(in_range(start, end))
    for column, wanted in (("model", model), ("project", project), ("device_id", device)):
        if wanted:
            out = out.filter(F.col(column) == wanted)
    return out


def all_tokens() -> Column:
    return F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write_5m") + F.col("cache_write_1h")


def value_of(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("value_usd")).otherwise(0.0))


def is_opus_prefix() -> Column:
    """Opus by id prefix. Project and machine views use this; totals and blocks use the price-book family."""
    return F.col("model").startswith("claude-opus")


def top_n(df: DataFrame, by: list[Column], n: int, keys: tuple[str, ...] = (WS,)) -> DataFrame:
    """First ``n`` rows per key. Spark cuts every partition to ``n`` per key before it shuffles."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def every_workspace(per_workspace: DataFrame, workspaces: DataFrame) -> DataFrame:
    """One row per workspace; measures of workspaces without usage are zero."""
    measures = [c for c in per_workspace.columns if c != WS]
    joined = workspaces.select(F.col("id").alias(WS)).join(per_workspace, WS, "left")
    return joined.fillna(0, subset=measures)


def totals(
    requests: DataFrame,
    workspaces: DataFrame,
    start: datetime | Column,
    end: datetime | Column,
    book=PRICE_BOOK,
    **filters: str | None,
) -> DataFrame:
    """Headline numbers per workspace.

    Pre-aggregates to (session, local day, model), so the two global distinct counts expand far fewer rows.
    """
    base = with_workspace(filtered(requests, start, end, **filters), workspaces, "timezone")
    level = base.groupBy(WS, "session_id", local_day(F.col("ts"), F.col("timezone")).alias("day"), "model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("value_usd").alias("value"),
        F.sum("input").alias("input"),
        F.sum("output").alias("output"),
        F.sum("cache_read").alias("cache_read"),
        F.sum(F.col("cache_write_5m") + F.col("cache_write_1h")).alias("cache_write"),
        F.sum(F.coalesce("thinking", F.lit(0))).alias("thinking"),
        value_of(F.col("is_subagent")).alias("subagent_value"),
        F.count_if(~F.col("priced")).alias("unpriced"),
    )
    priced = with_prices(level, book)
    out = priced.groupBy(WS).agg(
        F.sum("requests").alias("requests"),
        F.countDistinct("session_id").alias("sessions"),
        F.sum("value").alias("value"),
        *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write", "thinking")],
        F.sum("subagent_value").alias("subagent_value"),
        F.sum(F.when(model_family() == "opus", F.col("value")).otherwise(0.0)).alias("opus_value"),
        F.countDistinct("day").alias("active_days"),
        F.sum(cache_savings(F.col("cache_read"))).alias("cache_savings"),
        F.sum("unpriced").alias("unpriced"),
    )
    full = every_workspace(out, workspaces)
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write")
    return full.withColumn("cache_hit_rate", F.when(prompt != 0, F.col("cache_read") / prompt))


def daily_by_model(requests, workspaces, start, end, **filters) -> DataFrame:
    base = with_workspace(filtered(requests, start, end, **filters), workspaces, "timezone")
    return base.groupBy(WS, local_day(F.col("ts"), F.col("timezone")).alias("day"), "model").agg(
        F.sum("value_usd").alias("value"),
        F.count(F.lit(1)).alias("requests"),
        F.sum(all_tokens()).alias("tokens"),
    )


def by_model(requests, start, end, book=PRICE_BOOK, **filters) -> DataFrame:
    """Per-model table with the derived rates shown beside it (null where the denominator is zero)."""
    # Sessions collapse first: one row per (model, session) replaces the wide distinct expansion.
    level = filtered(requests, start, end, **filters).groupBy(WS, "model", "session_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("value_usd").alias("value"),
        *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")],
        F.sum(F.coalesce("thinking", F.lit(0))).alias("thinking"),
        F.sum("duration_ms").alias("_dur"),
        F.count("duration_ms").alias("_durn"),
        F.count_if(F.coalesce(F.col("speed") == "fast", F.lit(False))).alias("fast"),
    )
    sums = ("requests", "value", "input", "output", "cache_read", "cache_write_5m", "cache_write_1h", "thinking",
            "_dur", "_durn", "fast")
    out = level.groupBy(WS, "model").agg(F.count(F.lit(1)).alias("sessions"), *[F.sum(c).alias(c) for c in sums])
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write_5m") + F.col("cache_write_1h")
    tokens = prompt + F.col("output")
    return (
        with_prices(out, book)
        .select(
            WS, "model", model_label().alias("model_label"), "requests", "sessions", "value", "input", "output",
            "cache_read", "cache_write_5m", "cache_write_1h", "thinking",
            F.when(F.col("_durn") > 0, F.col("_dur") / F.col("_durn")).alias("avg_duration_ms"),
            "fast",
            F.when(prompt != 0, F.col("cache_read") / prompt).alias("cache_hit_rate"),
            F.when(tokens != 0, F.col("value") / tokens * 1_000_000).alias("usd_per_mtok"),
        )
    )


def with_share(df: DataFrame, value: str = "value", keys: tuple[str, ...] = (WS,)) -> DataFrame:
    """Share of the per-key total; totals are aggregated and joined, never windowed over a whole key."""
    total = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    share = F.when(F.col("_total") != 0, F.col(value) / F.col("_total")).otherwise(0.0)
    return df.join(total, list(keys)).withColumn("share", share).drop("_total")


def _split(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(WS, key.alias(name)).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("value_usd").alias("value")
    )


def effort_mix(requests, start, end) -> DataFrame:
    return _split(filtered(requests, start, end), F.coalesce("effort", F.lit("default")), "effort")


def entrypoint_split(requests, start, end) -> DataFrame:
    return _split(filtered(requests, start, end), F.coalesce("entrypoint", F.lit("unknown")), "entrypoint")


def subagent_breakdown(requests, start, end, limit: int = 12) -> DataFrame:
    sub = filtered(requests, start, end).filter("is_subagent")
    out = _split(sub, F.coalesce("agent_type", F.lit("unknown")), "agent")
    return top_n(out, [F.desc("value"), F.asc("agent")], limit)


def skill_breakdown(requests, start, end, limit: int = 12) -> DataFrame:
    used = filtered(requests, start, end).filter(F.col("skill").isNotNull() | F.col("plugin").isNotNull())
    return top_n(_split(used, F.coalesce("skill", "plugin"), "skill"), [F.desc("value"), F.asc("skill")], limit)


def projects(requests, start, end) -> DataFrame:
    """Per project (a missing project is its own row): sessions, requests, branches, Opus value."""
    level = filtered(requests, start, end).groupBy(WS, "project", "session_id", "git_branch").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("value_usd").alias("value"),
        F.max("ts").alias("last_ts"),
        value_of(is_opus_prefix()).alias("opus_value"),
    )
    return level.groupBy(WS, "project").agg(
        F.countDistinct("session_id").alias("sessions"),
        F.sum("requests").alias("requests"),
        F.sum("value").alias("value"),
        F.max("last_ts").alias("last_ts"),
        F.countDistinct("git_branch").alias("branches"),
        F.sum("opus_value").alias("opus_value"),
    ).withColumn("opus_share", F.when(F.col("value") != 0, F.col("opus_value") / F.col("value")))


def heatmap(requests, workspaces, start, end) -> DataFrame:
    """Hour of week in workspace time; day 0 is Sunday."""
    base = with_workspace(filtered(requests, start, end), workspaces, "timezone")
    local = local_ts(F.col("ts"), F.col("timezone"))
    return base.groupBy(WS, (F.dayofweek(local) - 1).alias("dow"), F.hour(local).alias("hour")).agg(
        F.sum("value_usd").alias("value"), F.count(F.lit(1)).alias("requests")
    )


def heatmap_with_limits(requests, limits, workspaces, start, end) -> DataFrame:
    """Heatmap cells flagged where a limit was hit in that hour of the week."""
    hits = with_workspace(limits.filter(in_range(start, end)), workspaces, "timezone")
    local = local_ts(F.col("ts"), F.col("timezone"))
    hit_cells = (
        hits.select(WS, (F.dayofweek(local) - 1).alias("dow"), F.hour(local).alias("hour"))
        .distinct()
        .withColumn("limit_hit", F.lit(True))
    )
    cells = heatmap(requests, workspaces, start, end)
    return cells.join(hit_cells, [WS, "dow", "hour"], "left").withColumn(
        "limit_hit", F.coalesce("limit_hit", F.lit(False))
    )


def weekly_value(requests, workspaces, now: datetime) -> DataFrame:
    """Rolling seven days, one row for every workspace."""
    return window_value(requests, workspaces, now - timedelta(days=7), now)


def window_value(requests, workspaces, start, end) -> DataFrame:
    out = filtered(requests, start, end).groupBy(WS).agg(
        F.sum("value_usd").alias("value"), F.count(F.lit(1)).alias("requests")
    )
    return every_workspace(out, workspaces)


def error_summary(errors, start, end) -> DataFrame:
    return errors.filter(in_range(start, end)).groupBy(WS, "reason_class").agg(F.count(F.lit(1)).alias("n"))


def error_headline(errors, start, end) -> DataFrame:
    """Errors in range and the most frequent class (ties: the smaller name)."""
    n = error_summary(errors, start, end)
    return n.groupBy(WS).agg(
        F.sum("n").alias("errors"),
        F.min(F.struct(-F.col("n"), F.col("reason_class"))).getField("reason_class").alias("top_class"),
    )


def limit_hits(limits, start, end) -> DataFrame:
    """Limit hits, newest first within a workspace (a distributed range sort)."""
    hits = limits.filter(in_range(start, end)).select(WS, "id", "ts", "limit_kind", "source")
    return hits.orderBy(WS, F.desc("ts"), "id")


def data_quality(requests, ingest_log, now: datetime, days: int = 30) -> DataFrame:
    """Which sources the last 30 days came from, unpriced requests, and the last upload."""
    recent = requests.filter(F.col("ts") > as_ts(now - timedelta(days=days)))
    both = F.array_contains("sources", "transcript") & F.array_contains("sources", "otel")
    n = recent.groupBy(WS).agg(
        F.count_if(both).alias("both"),
        F.count_if(F.col("sources") == F.array(F.lit("transcript"))).alias("transcript_only"),
        F.count_if(F.col("sources") == F.array(F.lit("otel"))).alias("otel_only"),
        F.count_if(~F.col("priced")).alias("unpriced"),
    )
    last = ingest_log.groupBy(WS).agg(F.max("received_at").alias("last_ingest"))
    covered = F.col("both") + F.col("otel_only")
    everything = F.greatest(F.lit(1), covered + F.col("transcript_only"))
    return n.join(last, WS, "left").withColumn("telemetry_coverage", covered / everything)


def unknown_types(ingest_log, now: datetime, days: int = 30, limit: int = 10) -> DataFrame:
    """Record types the parser did not know, summed over the upload log."""
    recent = ingest_log.filter(F.col("received_at") > as_ts(now - timedelta(days=days)))
    n = (
        recent.select(WS, F.explode("unknown_types").alias("record_type", "k"))
        .groupBy(WS, "record_type")
        .agg(F.sum("k").alias("n"))
    )
    return top_n(n, [F.desc("n"), F.asc("record_type")], limit)


def value_by_cycle(requests, workspaces) -> DataFrame:
    """Value per billing cycle. Local time shifts by (billing day - 1) days; unbounded in time."""
    base = with_workspace(requests, workspaces, "timezone", "billing_day")
    day = F.to_date(local_ts(F.col("ts"), F.col("timezone")))
    cycle = F.date_format(F.date_sub(day, F.col("billing_day") - 1), "yyyy-MM")
    level = base.groupBy(WS, cycle.alias("cycle"), "session_id").agg(
        F.sum("value_usd").alias("value"), F.count(F.lit(1)).alias("requests")
    )
    return level.groupBy(WS, "cycle").agg(
        F.sum("value").alias("value"), F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("sessions")
    )


def cumulative_daily(requests, workspaces, start, end) -> DataFrame:
    """Value per local day and its running sum (a group has one row per day)."""
    base = with_workspace(filtered(requests, start, end), workspaces, "timezone")
    daily = base.groupBy(WS, local_day(F.col("ts"), F.col("timezone")).alias("day")).agg(
        F.sum("value_usd").alias("value")
    )
    up_to = W.partitionBy(WS).orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.withColumn("cumulative", F.sum("value").over(up_to))


def productivity(snapshots, metrics, start, end) -> DataFrame:
    """Lines, commits, pull requests, active time. Telemetry wins; snapshots fill in where it is zero."""
    snap = (
        snapshots.withColumn("_at", F.coalesce("started_at", "updated_at"))
        .filter(in_range(start, end, "_at"))
        .groupBy(WS)
        .agg(F.sum("lines_added").alias("_added"), F.sum("lines_removed").alias("_removed"))
    )
    m = metrics.filter(in_range(start, end))

    def total(metric: str, kind: str | None = None) -> Column:
        hit = F.col("metric") == metric
        if kind:
            hit = hit & F.coalesce(F.col("kind") == kind, F.lit(False))
        return F.sum(F.when(hit, F.col("value")).otherwise(0.0))

    otel = m.groupBy(WS).agg(
        total("lines_of_code.count", "added").alias("_o_added"),
        total("lines_of_code.count", "removed").alias("_o_removed"),
        total("commit.count").alias("commits"),
        total("pull_request.count").alias("prs"),
        total("active_time.total").alias("active_seconds"),
        F.lit(True).alias("from_otel"),
    )

    def prefer(otel_col: str, snap_col: str) -> Column:
        return F.coalesce(F.nullif(F.col(otel_col), F.lit(0.0)), F.col(snap_col).cast("double"), F.lit(0.0))

    zero = F.lit(0.0)
    return otel.join(snap, WS, "full").select(
        WS,
        prefer("_o_added", "_added").alias("lines_added"),
        prefer("_o_removed", "_removed").alias("lines_removed"),
        F.coalesce("commits", zero).alias("commits"),
        F.coalesce("prs", zero).alias("prs"),
        F.coalesce("active_seconds", zero).alias("active_seconds"),
        F.coalesce("from_otel", F.lit(False)).alias("from_otel"),
    )


def by_machine(requests, start, end) -> DataFrame:
    """Usage per reporting machine; requests no machine claimed keep a null device."""
    level = filtered(requests, start, end).groupBy(WS, "device_id", "session_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("value_usd").alias("value"),
        value_of(is_opus_prefix()).alias("opus_value"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    return level.groupBy(WS, "device_id").agg(
        F.sum("requests").alias("requests"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("value").alias("value"),
        F.sum("opus_value").alias("opus_value"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


def machine_model_mix(requests, start, end) -> DataFrame:
    return filtered(requests, start, end).groupBy(WS, "device_id", "model").agg(F.sum("value_usd").alias("value"))


def daily_by_machine(requests, workspaces, start, end) -> DataFrame:
    base = with_workspace(filtered(requests, start, end), workspaces, "timezone")
    return base.groupBy(WS, local_day(F.col("ts"), F.col("timezone")).alias("day"), "device_id").agg(
        F.sum("value_usd").alias("value")
    )


def daily_stack(daily: DataFrame, key: str, columns: list[str], value: str = "value") -> DataFrame:
    """Day rows by series columns, zero-filled. ``columns`` names the series, so no extra pass finds them."""
    return daily.groupBy(WS, "day").pivot(key, columns).agg(F.sum(value)).fillna(0.0, subset=columns)


def filter_options(requests: DataFrame, devices: DataFrame, max_projects: int = 200) -> DataFrame:
    """Values offered by the filter pickers: models, first 200 projects by name, devices by enrolment."""
    models = requests.select(WS, F.lit("model").alias("kind"), F.col("model").alias("option")).distinct()
    named = requests.filter(F.col("project").isNotNull()).select(
        WS, F.lit("project").alias("kind"), F.col("project").alias("option")
    )
    top = top_n(named.distinct(), [F.asc("option")], max_projects)
    # A name or model sorts by itself; a device sorts by when it was enrolled.
    values = models.unionByName(top).withColumn("position", F.col("option"))
    machines = devices.select(
        WS, F.lit("device").alias("kind"), F.col("id").alias("option"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("position"),
    )
    return values.unionByName(machines)


def search_requests(requests: DataFrame, meta: DataFrame, text: str) -> DataFrame:
    """Requests whose own project or whose session title matches.

    Matching titles are found on the (much smaller) session table, so the requests only meet the hits.
    """
    hits = meta.filter(contains_ci(F.col("title"), text)).select(WS, "session_id").distinct()
    hits = hits.withColumn("_title_hit", F.lit(True))
    project_hit = F.coalesce(contains_ci(F.col("project"), text), F.lit(False))
    joined = requests.join(hits, [WS, "session_id"], "left")
    return joined.filter(project_hit | F.col("_title_hit").isNotNull()).drop("_title_hit")


def period_delta(current: Column, previous: Column) -> Column:
    """Relative change, hidden when the earlier period is too small to compare with."""
    too_small = (previous == 0) | (previous < F.abs(current) * 0.1)
    return F.when(previous.isNotNull() & ~too_small, (current - previous) / previous)


def totals_delta(requests, workspaces, start, end, prev_start, prev_end, book=PRICE_BOOK) -> DataFrame:
    """Totals of a range beside those of the period before it, from one pass: requests collapse to sessions with sums of
    either period, so no session is told apart twice."""
    periods = {"": in_range(start, end), "prev_": in_range(prev_start, prev_end)}
    used = requests.filter(periods[""] | periods["prev_"])
    by_session = used.groupBy(WS, "session_id").agg(
        *[F.sum(F.when(inside, F.col("value_usd"))).alias(f"{p}value") for p, inside in periods.items()],
        *[F.count_if(inside).alias(f"{p}requests") for p, inside in periods.items()],
    )
    names = ("value", "sessions", "requests")
    joined = every_workspace(
        by_session.groupBy(WS).agg(
            *[F.sum(f"{p}value").alias(f"{p}value") for p in periods],
            *[F.count_if(F.col(f"{p}requests") > 0).alias(f"{p}sessions") for p in periods],
            *[F.sum(f"{p}requests").alias(f"{p}requests") for p in periods],
        ),
        workspaces,
    )
    return joined.select(
        WS, *names,
        *[F.coalesce(f"prev_{c}", F.lit(0)).alias(f"prev_{c}") for c in names],
        *[period_delta(F.col(c), F.coalesce(f"prev_{c}", F.lit(0))).alias(f"{c}_delta") for c in names],
    )


def upload_report(usage: DataFrame, book=PRICE_BOOK) -> DataFrame:
    """Per-model table with a total row, as printed after a collection pass."""
    priced = with_prices(usage, book).withColumn("model_label", model_label())
    return priced.rollup("model_label").agg(
        F.grouping("model_label").cast("int").alias("is_total"),
        F.count(F.lit(1)).alias("requests"),
        F.sum("input").alias("input"),
        F.sum("output").alias("output"),
        F.sum("cache_read").alias("cache_read"),
        F.sum(F.col("cache_write_5m") + F.col("cache_write_1h")).alias("cache_write"),
        F.sum("value_usd").alias("value"),
        F.count_if(F.col("price_key").isNull()).alias("unpriced"),
    )
