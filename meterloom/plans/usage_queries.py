"""Registered queries: pricing, filters, roll-ups."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pricing, ranges
from ..operators import machines, plan_value, rollups
from .adapters import NOW, START, Tables
from .registry import cte, query

WEEK = NOW - timedelta(days=7)
_IN = "ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'"
_WEEK = "ts >= timestamp '2024-01-24' and ts < timestamp '2024-01-31'"


def totals_sql(bounds: str) -> str:
    return f"""
select w.id as workspace_id, coalesce(t.requests, 0) as requests, coalesce(t.sessions, 0) as sessions,
  coalesce(t.value, 0) as value, coalesce(t.input, 0) as input, coalesce(t.output, 0) as output,
  coalesce(t.cache_read, 0) as cache_read, coalesce(t.cache_write, 0) as cache_write,
  coalesce(t.thinking, 0) as thinking, coalesce(t.subagent_value, 0) as subagent_value,
  coalesce(t.opus_value, 0) as opus_value, coalesce(t.active_days, 0) as active_days,
  coalesce(t.cache_savings, 0) as cache_savings, coalesce(t.unpriced, 0) as unpriced,
  case when t.input + t.cache_read + t.cache_write <> 0
    then t.cache_read / (t.input + t.cache_read + t.cache_write)::double end as cache_hit_rate
from workspaces w left join (
  select workspace_id, count(*) as requests, count(distinct session_id) as sessions, sum(value_usd) as value,
    sum(input)::bigint as input, sum(output)::bigint as output, sum(cache_read)::bigint as cache_read,
    sum(cache_write_5m + cache_write_1h)::bigint as cache_write, coalesce(sum(thinking), 0)::bigint as thinking,
    sum(case when is_subagent then value_usd else 0 end) as subagent_value,
    sum(case when family = 'opus' then value_usd else 0 end) as opus_value,
    count(distinct local::date) as active_days,
    coalesce(sum(cache_read * (ri - rr) / 1e6), 0) as cache_savings,
    count(*) filter (where not priced) as unpriced
  from local_requests where {bounds} group by workspace_id) t on t.workspace_id = w.id"""


cte("month_totals", totals_sql(_IN))
cte("week_totals", totals_sql(_WEEK))
cte("last_week_totals", totals_sql("ts >= timestamp '2024-01-17' and ts < timestamp '2024-01-24'"))
_TOTALS_COLUMNS = """workspace_id, requests, sessions, round(value, 7) as value, input, output, cache_read, cache_write, thinking,
  round(subagent_value, 7) as subagent_value, round(opus_value, 7) as opus_value, active_days,
  round(cache_savings, 7) as cache_savings, unpriced, round(cache_hit_rate, 7) as cache_hit_rate"""


# ---- pricing -------------------------------------------------------------------------------------


@query(
    "prc_value",
    """select request_id, label as model_label, family, priced, round(value_usd, 7) as value_usd from requests""",
)
def prc_value(t: Tables) -> DataFrame:
    priced = pricing.with_prices(t.requests)
    return priced.select(
        "request_id", pricing.model_label().alias("model_label"), pricing.model_family().alias("family"), "priced",
        "value_usd",
    )


@query(
    "prc_savings",
    """select workspace_id, round(sum(coalesce(cache_read * (ri - rr) / 1e6, 0)), 7) as savings
from requests group by 1""",
)
def prc_savings(t: Tables) -> DataFrame:
    # Savings are linear in the tokens, so tokens collapse per model before the prices are looked up.
    level = t.requests.groupBy("workspace_id", "model").agg(F.sum("cache_read").alias("cache_read"))
    saved = pricing.cache_savings(F.col("cache_read"))
    return pricing.with_prices(level).groupBy("workspace_id").agg(F.sum(saved).alias("savings"))


@query(
    "prc_reprice",
    """select workspace_id, round(sum(value_usd), 7) as old_value,
  round(sum(value_usd + case when family = 'haiku' then output * (case when input + cache_read + cache_write_5m +
    cache_write_1h > 100000 then 2.5 else 0.5 end) / 1e6 * (case when inference_geo = 'us' then 1.1::double else 1 end)
    else 0 end), 7) as new_value
from requests group by 1""",
)
def prc_reprice(t: Tables) -> DataFrame:
    """The whole table re-priced under a changed book: output of one model costs twice as much."""
    book = [
        p._replace(
            rates=p.rates._replace(output=p.rates.output * 2),
            long_rates=p.long_rates._replace(output=p.long_rates.output * 2),
        )
        if p.key == "claude-haiku-5-5"
        else p
        for p in pricing.PRICE_BOOK
    ]
    old = t.requests.withColumn("old_value", F.col("value_usd"))
    again = pricing.price_requests(old, book)
    return again.groupBy("workspace_id").agg(F.sum("old_value").alias("old_value"), F.sum("value_usd").alias("new_value"))


@query(
    "prc_plan_detect",
    """select u.upload_id, case when lower(tier) like '%max%' and tier like '%20%' then 'max20x'
  when lower(tier) like '%max%' and tier like '%5%' then 'max5x' when lower(tier) like '%pro%' then 'pro' end as plan,
  case when lower(tier) like '%max%' then 'Max 20x' else 'Pro' end as plan_label,
  case when lower(tier) like '%max%' then 200.0::double else 20.0::double end as monthly_usd
from uploads u""",
)
def prc_plan_detect(t: Tables) -> DataFrame:
    found = t.uploads.select("upload_id", pricing.detect_plan(F.col("tier")).alias("plan"))
    return found.join(F.broadcast(pricing.plan_table(t.spark)), "plan", "left")


# ---- filters -------------------------------------------------------------------------------------


@query(
    "src_filter_options",
    """select workspace_id, 'model' as kind, model as option, model as position from requests group by 1, 3
union all
select workspace_id, 'project', project, project from (
  select workspace_id, project, row_number() over (partition by workspace_id order by project) as r
  from (select distinct workspace_id, project from requests where project is not null)) where r <= 200
union all
select workspace_id, 'device', id, strftime(created_at, '%Y-%m-%d %H:%M:%S') from devices""",
)
def src_filter_options(t: Tables) -> DataFrame:
    return rollups.filter_options(t.requests, t.devices)


@query(
    "flt_filters",
    f"""select workspace_id, count(*) as requests, round(sum(value_usd), 7) as value from requests
where {_IN} and model = 'claude-haiku-5-5' and project = 'proj_3' and device_id = 'dev_3' group by 1""",
)
def flt_filters(t: Tables) -> DataFrame:
    rows = rollups.filtered(t.requests, START, NOW, model="claude-haiku-5-5", project="proj_3", device="dev_3")
    return rows.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("value_usd").alias("value"))


@query(
    "flt_search",
    """select q.request_id, q.session_id, q.project from requests q
left join session_meta m on m.workspace_id = q.workspace_id and m.session_id = q.session_id
where m.title ilike '%00_1%' or q.project ilike '%OJ_1%'""",
)
def flt_search(t: Tables) -> DataFrame:
    found = rollups.search_requests(t.requests.select("workspace_id", "request_id", "session_id", "project"), t.meta, "00_1")
    other = rollups.search_requests(t.requests.select("workspace_id", "request_id", "session_id", "project"), t.meta, "OJ_1")
    return found.unionByName(other).distinct().select("request_id", "session_id", "project")


@query(
    "flt_cycle_ranges",
    """select id as workspace_id, c as cycle_start, c - (timestamp '2024-01-31' - c) as prev_start from (
  select id, case when make_date(2024, 1, least(billing_day, 28)) > date '2024-01-31'
    then make_timestamp(2023, 12, least(billing_day, 28), 0, 0, 0)
    else make_timestamp(2024, 1, least(billing_day, 28), 0, 0, 0) end as c from workspaces)""",
)
def flt_cycle_ranges(t: Tables) -> DataFrame:
    now = ranges.as_ts(NOW)
    start = ranges.cycle_start_col(now, F.col("billing_day"))
    dims = t.workspaces.select(F.col("id").alias("workspace_id"), start.alias("cycle_start"))
    return dims.withColumn("prev_start", F.col("cycle_start") - (now - F.col("cycle_start")))


@query(
    "flt_source_arrays",
    """select request_id, list_contains(sources, 'otel') as has_otel, sources = ['otel'] as only_otel,
  starts_with(model, 'claude-opus') as opus_prefix, family = 'opus' as opus_family,
  input + cache_read + cache_write_5m + cache_write_1h as prompt from requests""",
)
def flt_source_arrays(t: Tables) -> DataFrame:
    return pricing.with_prices(t.requests).select(
        "request_id",
        F.array_contains("sources", "otel").alias("has_otel"),
        (F.col("sources") == F.array(F.lit("otel"))).alias("only_otel"),
        rollups.is_opus_prefix().alias("opus_prefix"),
        (pricing.model_family() == "opus").alias("opus_family"),
        pricing.prompt_tokens().alias("prompt"),
    )


# ---- aggregations --------------------------------------------------------------------------------


@query("agg_totals", f"select {_TOTALS_COLUMNS} from month_totals")
def agg_totals(t: Tables) -> DataFrame:
    return rollups.totals(t.requests, t.workspaces, START, NOW)


@query(
    "agg_daily_by_model",
    f"""select workspace_id, strftime(local, '%Y-%m-%d') as day, model, round(sum(value_usd), 7) as value,
  count(*) as requests, sum(input + output + cache_read + cache_write_5m + cache_write_1h)::bigint as tokens
from local_requests where {_IN} group by 1, 2, 3""",
)
def agg_daily_by_model(t: Tables) -> DataFrame:
    return rollups.daily_by_model(t.requests, t.workspaces, START, NOW)


_BY_MODEL = f"""select workspace_id, model, min(label) as model_label, count(*) as requests,
  count(distinct session_id) as sessions, round(sum(value_usd), 7) as value, sum(input)::bigint as input,
  sum(output)::bigint as output, sum(cache_read)::bigint as cache_read,
  sum(cache_write_5m)::bigint as cache_write_5m, sum(cache_write_1h)::bigint as cache_write_1h,
  coalesce(sum(thinking), 0)::bigint as thinking, round(avg(duration_ms), 7) as avg_duration_ms,
  count(*) filter (where speed = 'fast') as fast,
  round(case when sum(input + cache_read + cache_write_5m + cache_write_1h) <> 0 then
    sum(cache_read)::double / sum(input + cache_read + cache_write_5m + cache_write_1h)::double end, 7) as cache_hit_rate,
  round(case when sum(input + output + cache_read + cache_write_5m + cache_write_1h) <> 0 then
    sum(value_usd) / sum(input + output + cache_read + cache_write_5m + cache_write_1h)::double * 1e6 end, 7)
    as usd_per_mtok
from requests where {_IN} group by 1, 2"""


@query("agg_by_model", _BY_MODEL)
def agg_by_model(t: Tables) -> DataFrame:
    return rollups.by_model(t.requests, START, NOW)


@query(
    "agg_effort",
    f"""select workspace_id, coalesce(effort, 'default') as effort, count(*) as requests,
  round(sum(value_usd), 7) as value from requests where {_IN} group by 1, 2""",
)
def agg_effort(t: Tables) -> DataFrame:
    return rollups.effort_mix(t.requests, START, NOW)


@query(
    "agg_projects",
    f"""select workspace_id, project, count(distinct session_id) as sessions, count(*) as requests,
  round(sum(value_usd), 7) as value, max(ts) as last_ts, count(distinct git_branch) as branches,
  round(sum(case when model like 'claude-opus%' then value_usd else 0 end), 7) as opus_value,
  round(case when sum(value_usd) <> 0 then
    sum(case when model like 'claude-opus%' then value_usd else 0 end) / sum(value_usd) end, 7) as opus_share
from requests where {_IN} group by 1, 2""",
)
def agg_projects(t: Tables) -> DataFrame:
    return rollups.projects(t.requests, START, NOW)


@query(
    "agg_heatmap",
    f"""select workspace_id, dayofweek(local)::int as dow, hour(local)::int as hour, round(sum(value_usd), 7) as value,
  count(*) as requests from local_requests where {_IN} group by 1, 2, 3""",
)
def agg_heatmap(t: Tables) -> DataFrame:
    return rollups.heatmap(t.requests, t.workspaces, START, NOW)


@query(
    "joi_heatmap_limits",
    f"""with cells as (select workspace_id, dayofweek(local)::int as dow, hour(local)::int as hour,
  round(sum(value_usd), 7) as value, count(*) as requests from local_requests where {_IN} group by 1, 2, 3),
hits as (select distinct l.workspace_id, dayofweek(timezone(w.timezone, timezone('UTC', l.ts)))::int as dow,
  hour(timezone(w.timezone, timezone('UTC', l.ts)))::int as hour
  from limit_events l join workspaces w on w.id = l.workspace_id where {_IN})
select c.*, h.dow is not null as limit_hit from cells c left join hits h
  on h.workspace_id = c.workspace_id and h.dow = c.dow and h.hour = c.hour""",
)
def joi_heatmap_limits(t: Tables) -> DataFrame:
    return rollups.heatmap_with_limits(t.requests, t.limits, t.workspaces, START, NOW)


@query(
    "agg_weekly",
    f"""select w.id as workspace_id, round(coalesce(sum(value_usd), 0), 7) as value, count(request_id) as requests
from workspaces w left join requests q on q.workspace_id = w.id and {_WEEK} group by 1""",
)
def agg_weekly(t: Tables) -> DataFrame:
    return rollups.weekly_value(t.requests, t.workspaces, NOW)


@query("agg_errors", f"select workspace_id, reason_class, count(*) as n from error_events where {_IN} group by 1, 2")
def agg_errors(t: Tables) -> DataFrame:
    return rollups.error_summary(t.errors, START, NOW)


@query(
    "met_errors",
    f"""select workspace_id, sum(n)::bigint as errors, first(reason_class order by n desc, reason_class) as top_class
from (select workspace_id, reason_class, count(*) as n from error_events where {_IN} group by 1, 2) group by 1""",
)
def met_errors(t: Tables) -> DataFrame:
    return rollups.error_headline(t.errors, START, NOW)


@query(
    "agg_quality",
    """select q.*, l.last_ingest, round((q.both + q.otel_only)
  / greatest(1, q.both + q.otel_only + q.transcript_only)::double, 7) as telemetry_coverage from (
  select workspace_id, count(*) filter (where list_contains(sources, 'transcript') and list_contains(sources, 'otel')) as both,
    count(*) filter (where sources = ['transcript']) as transcript_only,
    count(*) filter (where sources = ['otel']) as otel_only, count(*) filter (where not priced) as unpriced
  from requests where ts > timestamp '2024-01-01' group by 1) q
left join (select workspace_id, max(received_at) as last_ingest from log_entries group by 1) l using (workspace_id)""",
)
def agg_quality(t: Tables) -> DataFrame:
    return rollups.data_quality(t.requests, t.ingest_log, NOW)


@query(
    "agg_unknown_types",
    """select workspace_id, record_type, n from (
  select workspace_id, record_type, n, row_number() over (partition by workspace_id order by n desc, record_type) as r
  from (select workspace_id, record_type, sum(k)::bigint as n from (
    select workspace_id, received_at, unknown_a as record_type, n_a as k from log_entries
    union all select workspace_id, received_at, unknown_b, n_b from log_entries)
  where received_at > timestamp '2024-01-01' group by 1, 2)) where r <= 10""",
)
def agg_unknown_types(t: Tables) -> DataFrame:
    return rollups.unknown_types(t.ingest_log, NOW)


cte(
    "cycles",
    """select workspace_id, strftime(local::date - (billing_day - 1), '%Y-%m') as cycle, sum(value_usd) as value,
  count(*) as requests, count(distinct session_id) as sessions from local_requests group by 1, 2""",
)


@query("agg_cycle", "select workspace_id, cycle, round(value, 7) as value, requests, sessions from cycles")
def agg_cycle(t: Tables) -> DataFrame:
    return rollups.value_by_cycle(t.requests, t.workspaces)


cte(
    "daily_values",
    f"""select workspace_id, strftime(local, '%Y-%m-%d') as day, sum(value_usd) as value
from local_requests where {_IN} group by 1, 2""",
)


@query(
    "win_cumulative",
    """select workspace_id, day, round(value, 7) as value,
  round(sum(value) over (partition by workspace_id order by day), 7) as cumulative from daily_values""",
)
def win_cumulative(t: Tables) -> DataFrame:
    return rollups.cumulative_daily(t.requests, t.workspaces, START, NOW)


_TOP12 = """select workspace_id, {name}, requests, round(value, 7) as value from (
  select *, row_number() over (partition by workspace_id order by value desc, {name}) as r from (
    select workspace_id, {key} as {name}, count(*) as requests, sum(value_usd) as value
    from requests where {where} group by 1, 2)) where r <= 12"""


@query(
    "agg_subagents",
    _TOP12.format(name="agent", key="coalesce(agent_type, 'unknown')", where=f"{_IN} and is_subagent"),
)
def agg_subagents(t: Tables) -> DataFrame:
    return rollups.subagent_breakdown(t.requests, START, NOW)


@query(
    "agg_skills",
    _TOP12.format(
        name="skill", key="coalesce(q0.skill, plugin)", where=f"{_IN} and (q0.skill is not null or plugin is not null)"
    ).replace("from requests where", "from requests q0 where"),
)
def agg_skills(t: Tables) -> DataFrame:
    return rollups.skill_breakdown(t.requests, START, NOW)


@query(
    "agg_entrypoint",
    f"""select workspace_id, coalesce(entrypoint, 'unknown') as entrypoint, count(*) as requests,
  round(sum(value_usd), 7) as value from requests where {_IN} group by 1, 2""",
)
def agg_entrypoint(t: Tables) -> DataFrame:
    return rollups.entrypoint_split(t.requests, START, NOW)


@query(
    "agg_productivity",
    f"""with snap as (select workspace_id, sum(lines_added)::double as added, sum(lines_removed)::double as removed
  from session_snapshots where coalesce(started_at, updated_at) >= timestamp '2024-01-01'
    and coalesce(started_at, updated_at) < timestamp '2024-01-31' group by 1),
otel as (select workspace_id,
    sum(case when metric = 'lines_of_code.count' and kind = 'added' then value else 0 end) as added,
    sum(case when metric = 'lines_of_code.count' and kind = 'removed' then value else 0 end) as removed,
    sum(case when metric = 'commit.count' then value else 0 end) as commits,
    sum(case when metric = 'pull_request.count' then value else 0 end) as prs,
    sum(case when metric = 'active_time.total' then value else 0 end) as active_seconds
  from otel_metrics where {_IN} group by 1)
select coalesce(o.workspace_id, s.workspace_id) as workspace_id,
  coalesce(nullif(o.added, 0), s.added, 0) as lines_added, coalesce(nullif(o.removed, 0), s.removed, 0) as lines_removed,
  coalesce(commits, 0) as commits, coalesce(prs, 0) as prs, coalesce(active_seconds, 0) as active_seconds,
  o.workspace_id is not null as from_otel
from otel o full join snap s on s.workspace_id = o.workspace_id""",
)
def agg_productivity(t: Tables) -> DataFrame:
    return rollups.productivity(t.snapshots, t.metrics, START, NOW)


_BY_MACHINE = f"""select workspace_id, device_id, count(*) as requests, count(distinct session_id) as sessions,
  sum(value_usd) as value, sum(case when model like 'claude-opus%' then value_usd else 0 end) as opus_value,
  min(ts) as first_ts, max(ts) as last_ts from requests where {_IN} group by 1, 2"""
cte("machine_use", _BY_MACHINE)


@query(
    "agg_machine",
    """select workspace_id, device_id, requests, sessions, round(value, 7) as value, round(opus_value, 7) as opus_value,
  first_ts, last_ts from machine_use""",
)
def agg_machine(t: Tables) -> DataFrame:
    return rollups.by_machine(t.requests, START, NOW)


@query(
    "agg_machine_mix",
    f"""select workspace_id, device_id, model, round(sum(value_usd), 7) as value from requests where {_IN}
group by 1, 2, 3""",
)
def agg_machine_mix(t: Tables) -> DataFrame:
    return rollups.machine_model_mix(t.requests, START, NOW)


@query(
    "agg_daily_machine",
    f"""select workspace_id, strftime(local, '%Y-%m-%d') as day, device_id, round(sum(value_usd), 7) as value
from local_requests where {_IN} group by 1, 2, 3""",
)
def agg_daily_machine(t: Tables) -> DataFrame:
    return rollups.daily_by_machine(t.requests, t.workspaces, START, NOW)


_MODELS = ["claude-haiku-5-5", "claude-opus-5-5[1m]", "claude-sonnet-4-5-20250929", "other-model"]


@query(
    "agg_daily_pivot",
    "select workspace_id, strftime(local, '%Y-%m-%d') as day, "
    + ", ".join(
        f"round(sum(case when model = '{m}' then value_usd else 0 end), 7) as \"{m}\""
        for m in [*_MODELS, "anthropic.claude-opus-4-8"]
    )
    + f" from local_requests where {_IN} group by 1, 2",
)
def agg_daily_pivot(t: Tables) -> DataFrame:
    daily = rollups.daily_by_model(t.requests, t.workspaces, START, NOW)
    names = [*_MODELS, "anthropic.claude-opus-4-8"]
    # A dot in a column name reads as a struct path, so the series is renamed around the zero-fill.
    safe = daily.withColumn("model", F.regexp_replace("model", r"\.", "~"))
    stacked = rollups.daily_stack(safe, "model", [n.replace(".", "~") for n in names])
    return stacked.toDF(*[c.replace("~", ".") for c in stacked.columns])


@query(
    "win_share",
    f"""select workspace_id, model, round(v, 7) as value,
  round(case when sum(v) over (partition by workspace_id) <> 0 then v / sum(v) over (partition by workspace_id) else 0 end, 7)
    as share
from (select workspace_id, model, sum(value_usd) as v from requests where {_IN} group by 1, 2)""",
)
def win_share(t: Tables) -> DataFrame:
    return rollups.with_share(rollups.by_model(t.requests, START, NOW).select("workspace_id", "model", "value"))


@query(
    "top_projects",
    f"""select workspace_id, project, round(value, 7) as value from (
  select *, row_number() over (partition by workspace_id order by value desc, project) as r from (
    select workspace_id, project, sum(value_usd) as value from requests where {_IN} group by 1, 2)) where r <= 12""",
)
def top_projects(t: Tables) -> DataFrame:
    best = rollups.top_n(rollups.projects(t.requests, START, NOW), [F.desc("value"), F.asc_nulls_last("project")], 12)
    return best.select("workspace_id", "project", "value")


@query(
    "top_limit_hits",
    f"select workspace_id, id, ts, limit_kind, source from limit_events where {_IN}",
)
def top_limit_hits(t: Tables) -> DataFrame:
    return rollups.limit_hits(t.limits, START, NOW)


@query(
    "win_delta",
    """select workspace_id, round(c.value, 7) as value, c.sessions, c.requests, round(p.value, 7) as prev_value,
  p.sessions as prev_sessions, p.requests as prev_requests, """
    + ", ".join(
        f"round(case when p.{c} <> 0 and p.{c} >= abs(c.{c}) * 0.1 then (c.{c} - p.{c}) / p.{c}::double end, 7) as {c}_delta"
        for c in ("value", "sessions", "requests")
    )
    + " from week_totals c join last_week_totals p using (workspace_id)",
)
def win_delta(t: Tables) -> DataFrame:
    return rollups.totals_delta(t.requests, t.workspaces, WEEK, NOW, WEEK - timedelta(days=7), WEEK)


# ---- machines ------------------------------------------------------------------------------------


@query(
    "joi_devices",
    """select d.workspace_id, d.id, d.name, d.last_seen_at, d.revoked_at, coalesce(q.n, 0) as requests_7d,
  round(coalesce(q.v, 0), 7) as value_7d
from devices d left join (select workspace_id, device_id, count(*) as n, sum(value_usd) as v from requests
  where ts > timestamp '2024-01-24' group by 1, 2) q on q.workspace_id = d.workspace_id and q.device_id = d.id""",
)
def joi_devices(t: Tables) -> DataFrame:
    stats = machines.in_device_order(machines.devices_with_stats(t.devices, t.requests, NOW))
    return stats.select("workspace_id", "id", "name", "last_seen_at", "revoked_at", "requests_7d", "value_7d")


@query(
    "joi_machine_names",
    """select m.workspace_id, m.device_id, m.requests, round(m.value, 7) as value,
  case when m.device_id is null then 'Not attributed to a machine' else coalesce(d.name, 'Removed machine') end as machine,
  round(case when sum(m.value) over (partition by m.workspace_id) <> 0
    then m.value / sum(m.value) over (partition by m.workspace_id) else 0 end, 7) as share
from machine_use m left join devices d on d.workspace_id = m.workspace_id and d.id = m.device_id""",
)
def joi_machine_names(t: Tables) -> DataFrame:
    return machines.machine_usage(t.requests, t.devices, START, NOW).select(
        "workspace_id", "device_id", "requests", "value", "machine", "share"
    )


@query(
    "joi_idle_anti",
    """select d.workspace_id, d.id, d.name from devices d where d.revoked_at is null and not exists (
  select 1 from requests q where q.workspace_id = d.workspace_id and q.device_id = d.id
    and q.ts >= timestamp '2024-01-30 22:00:00' and q.ts < timestamp '2024-01-31')""",
)
def joi_idle_anti(t: Tables) -> DataFrame:
    return machines.idle_machines(t.requests, t.devices, NOW - timedelta(hours=2), NOW).select("workspace_id", "id", "name")


@query(
    "top_busiest_machine",
    """select workspace_id, device_id, round(value, 7) as value, round(case when total <> 0 then value / total else 0 end, 7) as share
from (select *, sum(value) over (partition by workspace_id) as total,
  row_number() over (partition by workspace_id order by value desc, device_id nulls last) as r from machine_use) where r = 1""",
)
def top_busiest_machine(t: Tables) -> DataFrame:
    return machines.busiest_machine(rollups.with_share(rollups.by_machine(t.requests, START, NOW)))


@query(
    "met_completeness",
    """select workspace_id, count(*) filter (where revoked_at is null) as live,
  count(*) filter (where revoked_at is null and last_seen_at >= timestamp '2024-01-28') as reporting,
  count(*) filter (where revoked_at is null and (last_seen_at is null or last_seen_at < timestamp '2024-01-28')) as stale
from devices group by 1""",
)
def met_completeness(t: Tables) -> DataFrame:
    return machines.completeness(t.devices, NOW)


@query(
    "met_refused_flag",
    """select id, coalesce(timestamp '2024-01-31' - last_refused_at < interval 7 days, false) as refusing from devices""",
)
def met_refused_flag(t: Tables) -> DataFrame:
    from ..operators.gates import recently_refused

    return t.devices.select("id", recently_refused(ranges.as_ts(NOW)).alias("refusing"))


# ---- administration ------------------------------------------------------------------------------

_ADMIN = """select w.id as workspace_id, w.name, w.plan, w.plan_price_usd, w.created_at, u.email as owner_email,
  coalesce(m.members, 0) as members, coalesce(d.machines, 0) as machines,
  coalesce(d.machines_reporting_7d, 0) as machines_reporting_7d, d.last_upload, coalesce(a.value, 0) as value,
  coalesce(a.requests, 0) as requests, coalesce(a.sessions, 0) as sessions,
  coalesce(d.machines, 0) - coalesce(d.machines_reporting_7d, 0) as silent_machines
from workspaces w left join users u on u.id = w.owner_id
left join (select workspace_id, count(*) as members from memberships group by 1) m on m.workspace_id = w.id
left join (select workspace_id, count(*) filter (where revoked_at is null) as machines,
    count(*) filter (where revoked_at is null and last_seen_at > timestamp '2024-01-24') as machines_reporting_7d,
    max(last_seen_at) as last_upload from devices group by 1) d on d.workspace_id = w.id
left join (select workspace_id, sum(value_usd) as value, count(*) as requests, count(distinct session_id) as sessions
  from requests where ts > timestamp '2024-01-01' group by 1) a on a.workspace_id = w.id"""
cte("admin_rows", _ADMIN)


@query("agg_admin", "select * exclude (value), round(value, 7) as value from admin_rows")
def agg_admin(t: Tables) -> DataFrame:
    return machines.admin_overview(
        t.workspaces, t.view("users"), t.view("memberships"), t.devices, t.requests, NOW
    )


@query(
    "agg_admin_totals",
    """select count(*) as workspaces, count(*) filter (where requests > 0) as active_workspaces,
  sum(members)::bigint as members, sum(machines)::bigint as machines, round(sum(value), 7) as value,
  sum(requests)::bigint as requests from admin_rows""",
)
def agg_admin_totals(t: Tables) -> DataFrame:
    rows = machines.admin_overview(t.workspaces, t.view("users"), t.view("memberships"), t.devices, t.requests, NOW)
    return machines.admin_totals(rows)


cte(
    "family_rows",
    """select workspace_id, family, model, sum(value_usd) as value, count(*) as requests
from requests where ts > timestamp '2024-01-01' group by grouping sets ((workspace_id, family), (model), ())""",
)


@query(
    "agg_admin_sets",
    "select workspace_id, family, model, round(value, 7) as value, requests from family_rows",
)
def agg_admin_sets(t: Tables) -> DataFrame:
    return machines.admin_mix(t.requests, NOW).drop("set_id")


@query(
    "met_family_share",
    """select workspace_id, family, round(value, 7) as value, round(value / total, 7) as share from (
  select *, sum(value) over (partition by workspace_id) as total from family_rows where workspace_id is not null)
where value / total >= 0.05 and value > 0""",
)
def met_family_share(t: Tables) -> DataFrame:
    return machines.family_shares(machines.admin_mix(t.requests, NOW)).select("workspace_id", "family", "value", "share")


@query(
    "joi_active_semi",
    """select id, name from workspaces w where exists (
  select 1 from requests q where q.workspace_id = w.id and q.ts > timestamp '2024-01-24')""",
)
def joi_active_semi(t: Tables) -> DataFrame:
    return machines.active_workspaces(t.workspaces, t.requests, NOW).select("id", "name")


@query(
    "joi_owners",
    """select m.workspace_id, lower(u.email) as email from memberships m join users u on u.id = m.user_id
where m.role = 'owner'""",
)
def joi_owners(t: Tables) -> DataFrame:
    owners = t.view("memberships").filter("role = 'owner'")
    people = t.view("users").select(F.col("id").alias("user_id"), F.lower("email").alias("email"))
    return owners.join(people, "user_id").select("workspace_id", "email")


# ---- plan value ----------------------------------------------------------------------------------

cte(
    "cycle_days",
    """select workspace_id, strftime(local, '%Y-%m-%d') as day, sum(value_usd) as value,
  min(plan_price_usd) as price, sum(sum(value_usd)) over (partition by workspace_id order by strftime(local, '%Y-%m-%d')) as cumulative
from local_requests where ts < timestamp '2024-01-31' and ts >=
  case when make_date(2024, 1, least(billing_day, 28)) > date '2024-01-31'
    then make_timestamp(2023, 12, least(billing_day, 28), 0, 0, 0)
    else make_timestamp(2024, 1, least(billing_day, 28), 0, 0, 0) end
group by workspace_id, strftime(local, '%Y-%m-%d')""",
)


@query(
    "win_break_even",
    """select workspace_id, round(sum(value), 7) as cycle_value,
  min(case when price > 0 and cumulative >= price then day end) as break_even_day from cycle_days group by 1""",
)
def win_break_even(t: Tables) -> DataFrame:
    return plan_value.plan_value(t.requests, t.workspaces, NOW).select("workspace_id", "cycle_value", "break_even_day")


@query(
    "met_plan",
    """select w.id as workspace_id, round(coalesce(v, 0), 10) as cycle_value, round(coalesce(v, 0) / plan_price_usd, 10) as multiple,
  round(greatest(0, plan_price_usd - coalesce(v, 0)), 10) as to_break_even,
  round(coalesce(v, 0) / greatest(1, 31 - billing_day) * 30.4, 10) as projected,
  round(coalesce(v, 0) / greatest(1, 31 - billing_day) * 30.4 / plan_price_usd, 10) as projected_multiple
from workspaces w left join (select workspace_id, sum(value) as v from cycle_days group by 1) c on c.workspace_id = w.id""",
    digits=10,
)
def met_plan(t: Tables) -> DataFrame:
    return plan_value.plan_value(t.requests, t.workspaces, NOW).select(
        "workspace_id", "cycle_value", "multiple", "to_break_even", "projected", "projected_multiple"
    )


@query(
    "joi_plan_asof",
    """select c.workspace_id, c.cycle, round(c.value, 10) as value, c.requests, c.sessions, p.price, round(c.value / p.price, 10) as multiple
from cycles c join (
  select k.workspace_id, k.cycle, coalesce((select first(monthly_price_usd order by effective_from desc)
      from plan_periods pp where pp.workspace_id = k.workspace_id and pp.effective_from <= (k.cycle || '-28')::date),
    w.plan_price_usd) as price
  from cycles k join workspaces w on w.id = k.workspace_id) p
  on p.workspace_id = c.workspace_id and p.cycle = c.cycle""",
    digits=10,
)
def joi_plan_asof(t: Tables) -> DataFrame:
    return plan_value.cycle_table(t.requests, t.workspaces, t.periods)
