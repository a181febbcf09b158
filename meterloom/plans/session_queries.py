"""Registered queries: sessions, blocks, findings and alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import price_requests as priced
from ..operators import alerts, blocks, insights, live, sessions, tiles
from ..session import shared_dir
from ..sources.tables import write_text
from ..streaming import alerts as stream_alerts
from .adapters import NOW, START, Tables
from .registry import cte, query

WEEK = NOW - timedelta(days=7)
_IN = "ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'"


def _modal(column: str) -> str:
    return f"""(select workspace_id, session_id, first({column} order by n desc, {column}) as {column} from (
    select workspace_id, session_id, {column}, count(*) as n from requests where {_IN} and {column} is not null
    group by 1, 2, 3) group by 1, 2)"""


cte(
    "session_rows",
    f"""select a.*, p.project, e.entrypoint, g.git_branch, d.device_id, coalesce(m.title, m.agent_name) as title,
  n.name as device_name, coalesce(c.n, 0) as compactions, coalesce(x.n, 0) as errors
from (select workspace_id, session_id, min(ts) as started, max(ts) as ended, count(*) as requests,
    sum(value_usd) as value, sum(case when is_subagent then value_usd else 0 end) as subagent_value,
    sum(input)::bigint as input, sum(output)::bigint as output, sum(cache_read)::bigint as cache_read,
    sum(cache_write_5m + cache_write_1h)::bigint as cache_write,
    array_to_string(list_sort(list(distinct model)), ',') as models
  from requests where {_IN} group by 1, 2) a
left join {_modal('project')} p using (workspace_id, session_id)
left join {_modal('entrypoint')} e using (workspace_id, session_id)
left join {_modal('git_branch')} g using (workspace_id, session_id)
left join {_modal('device_id')} d using (workspace_id, session_id)
left join session_meta m using (workspace_id, session_id)
left join devices n on n.id = d.device_id
left join (select workspace_id, session_id, count(*) as n from session_events where event = 'compaction' group by 1, 2) c
  using (workspace_id, session_id)
left join (select workspace_id, session_id, count(*) as n from error_events group by 1, 2) x
  using (workspace_id, session_id)""",
)
_SESSION_COLUMNS = (
    "workspace_id, session_id, started, ended, requests, round(value, 7) as value, "
    "round(subagent_value, 7) as subagent_value, input, output, cache_read, cache_write, models, project, entrypoint, "
    "git_branch, device_id, title, device_name, compactions, errors"
)


def _sessions(t: Tables, **options) -> DataFrame:
    rows = sessions.sessions(t.requests, t.meta, t.devices, t.session_events, t.errors, START, NOW, **options)
    return rows.withColumn("models", F.array_join("models", ","))


@query("agg_sessions", f"select {_SESSION_COLUMNS} from session_rows")
def agg_sessions(t: Tables) -> DataFrame:
    return _sessions(t)


@query(
    "agg_sessions_search",
    f"""select q.workspace_id, q.session_id, count(*) as requests, round(sum(value_usd), 7) as value
from requests q left join session_meta m using (workspace_id, session_id)
where {_IN} and (m.title ilike '%oj_1%' or q.project ilike '%oj_1%') group by 1, 2""",
)
def agg_sessions_search(t: Tables) -> DataFrame:
    return _sessions(t, search="oj_1").select("workspace_id", "session_id", "requests", "value")


def _top(order: str, n: int) -> str:
    return f"""select {_SESSION_COLUMNS} from (select *, row_number() over (partition by workspace_id
  order by {order} desc, session_id) as r from session_rows) where r <= {n}"""


@query("top_sessions", _top("value", 6))
def top_sessions(t: Tables) -> DataFrame:
    return sessions.top_sessions(_sessions(t), "value", 6)


@query("top_sessions_recent", _top("ended", 200))
def top_sessions_recent(t: Tables) -> DataFrame:
    return sessions.top_sessions(_sessions(t), "recent", 200)


@query("top_sessions_requests", _top("requests", 300))
def top_sessions_requests(t: Tables) -> DataFrame:
    return sessions.top_sessions(_sessions(t), "requests", 300)


@query(
    "agg_session_stats",
    f"""select workspace_id, round(quantile_cont(v, 0.5), 7) as median, round(quantile_cont(v, 0.95), 7) as p95, count(*) as n
from (select workspace_id, session_id, sum(value_usd) as v from requests where {_IN} group by 1, 2) group by 1""",
)
def agg_session_stats(t: Tables) -> DataFrame:
    return sessions.session_stats(t.requests, START, NOW)


@query(
    "win_context",
    """select workspace_id, session_id, request_id, is_subagent,
  row_number() over (partition by workspace_id, session_id order by ts, request_id) as ordinal,
  case when not is_subagent then row_number() over (partition by workspace_id, session_id, is_subagent order by ts, request_id) end
    as main_ordinal,
  input + cache_read + cache_write_5m + cache_write_1h as context
from requests""",
)
def win_context(t: Tables) -> DataFrame:
    return sessions.context_growth(t.requests).drop("ts", "model", "value_usd")


@query(
    "joi_compaction_asof",
    """with main as (select *, row_number() over (partition by workspace_id, session_id order by ts, request_id) as i
  from requests where not is_subagent)
select e.workspace_id, e.session_id, e.id, e.ts, min(m.i) as position
from session_events e join main m on m.workspace_id = e.workspace_id and m.session_id = e.session_id and m.ts >= e.ts
where e.event = 'compaction' group by 1, 2, 3, 4""",
)
def joi_compaction_asof(t: Tables) -> DataFrame:
    return sessions.compaction_positions(t.requests, t.session_events)


@query(
    "win_top400",
    """select workspace_id, session_id, request_id, ts, round(value_usd, 7) as value_usd from (
  select *, row_number() over (partition by workspace_id, session_id order by value_usd desc, ts, request_id) as r from requests)
where r <= 400""",
)
def win_top400(t: Tables) -> DataFrame:
    top = sessions.costliest_requests(t.requests, 400)
    return top.select("workspace_id", "session_id", "request_id", "ts", "value_usd")


@query(
    "top_session_requests",
    """select workspace_id, session_id, request_id,
  row_number() over (partition by workspace_id, session_id order by ts, request_id) as position from requests""",
)
def top_session_requests(t: Tables) -> DataFrame:
    return sessions.request_list(t.requests).select("workspace_id", "session_id", "request_id", "position")


@query(
    "joi_session_machines",
    """select workspace_id, session_id, machine, count(*) as requests from (
  select q.workspace_id, q.session_id, coalesce(d.name, 'Unknown machine') as machine
  from requests q left join devices d on d.id = q.device_id) group by 1, 2, 3""",
)
def joi_session_machines(t: Tables) -> DataFrame:
    return sessions.session_machines(t.requests, t.devices)


@query(
    "agg_session_detail",
    """select q.*, coalesce(c.n, 0) as compactions, coalesce(x.n, 0) as errors from (
  select workspace_id, session_id, count(*) as requests, count(*) filter (where is_subagent) as subagent_requests,
    round(sum(value_usd), 7) as value, round(sum(case when is_subagent then value_usd else 0 end), 7) as subagent_value,
    sum(input)::bigint as input, sum(output)::bigint as output, sum(cache_read)::bigint as cache_read,
    sum(cache_write_5m)::bigint as cache_write_5m, sum(cache_write_1h)::bigint as cache_write_1h,
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0::double, 7) as span_ms,
    round(case when sum(input + cache_read + cache_write_5m + cache_write_1h) <> 0 then sum(cache_read)::double
      / sum(input + cache_read + cache_write_5m + cache_write_1h)::double end, 7) as cache_hit_rate
  from requests group by 1, 2) q
left join (select workspace_id, session_id, count(*) as n from session_events where event = 'compaction' group by 1, 2) c
  using (workspace_id, session_id)
left join (select workspace_id, session_id, count(*) as n from error_events group by 1, 2) x using (workspace_id, session_id)""",
)
def agg_session_detail(t: Tables) -> DataFrame:
    return sessions.session_detail(t.requests, t.session_events, t.errors)


@query(
    "agg_session_parts",
    """select workspace_id, session_id, 'model' as part, model as name, min(label) as part_label, round(sum(value_usd), 7) as value
from requests group by workspace_id, session_id, model
union all
select workspace_id, session_id, 'agent', coalesce(agent_type, 'subagent'), coalesce(agent_type, 'subagent'), round(sum(value_usd), 7)
from requests where is_subagent group by workspace_id, session_id, coalesce(agent_type, 'subagent')""",
)
def agg_session_parts(t: Tables) -> DataFrame:
    return sessions.session_value_parts(t.requests)


@query(
    "met_snapshot_diff",
    """select q.workspace_id, q.session_id, round(q.v, 7) as computed_usd, s.total_cost_usd, s.lines_added, s.lines_removed,
  s.api_ms, s.tool_ms, round(q.v - s.total_cost_usd, 7) as difference_usd
from (select workspace_id, session_id, sum(value_usd) as v from requests group by 1, 2) q
left join (select * from session_snapshots where total_cost_usd > 0) s using (workspace_id, session_id)""",
)
def met_snapshot_diff(t: Tables) -> DataFrame:
    return sessions.snapshot_difference(t.requests, t.snapshots)


# ---- blocks --------------------------------------------------------------------------------------


def block_ctes(prefix: str, start: str, end: str) -> None:
    """Oracle blocks over [start, end): a recursive chain over active hours, then a range join."""
    until = end if end.startswith("(") else f"timestamp '{end}'"
    window = f"ts >= timestamp '{start}' and ts < {until}"
    cte(
        f"{prefix}_hours",
        f"""select distinct workspace_id, epoch_us(date_trunc('hour', ts)) // 3600000000 as h from requests where {window}
union select distinct workspace_id, epoch_us(date_trunc('hour', ts)) // 3600000000 from limit_events where {window}""",
    )
    cte(
        f"{prefix}_chain",
        f"""select workspace_id, unnest(list_reduce(list_prepend([]::bigint[], list_transform(hs, lambda x: [x])),
    lambda acc, x: case when len(acc) = 0 or x[1] >= acc[len(acc)] + 5 then list_concat(acc, x) else acc end)) as s
from (select workspace_id, list(h order by h) as hs from {prefix}_hours group by 1)""",
    )
    cte(
        f"{prefix}_base",
        f"""select c.workspace_id, c.s, make_timestamp(c.s * 3600000000) as block_start,
  make_timestamp((c.s + 5) * 3600000000) as block_end,
  (select min(l.ts) from limit_events l where l.workspace_id = c.workspace_id and l.{window.replace(' and ts', ' and l.ts')}
    and l.ts >= make_timestamp(c.s * 3600000000) and l.ts < make_timestamp((c.s + 5) * 3600000000)) as first_limit_ts
from {prefix}_chain c""",
    )
    cte(
        f"{prefix}_blocks",
        f"""select b.workspace_id, b.block_start, b.block_end, b.first_limit_ts,
  least(q.first_ts, l.first_ts) as first_ts, greatest(q.last_ts, l.last_ts) as last_ts,
  coalesce(q.requests, 0) as requests, coalesce(q.value, 0) as value, coalesce(q.opus_value, 0) as opus_value,
  coalesce(l.limits, 0) as limits, coalesce(l.block_limits, 0) as block_limits, l.last_ts as last_limit_ts,
  case when b.first_limit_ts is not null then coalesce(q.reached, 0) end as value_at_limit
from {prefix}_base b
left join (select b.workspace_id, b.s, count(*) as requests, sum(r.value_usd) as value, min(r.ts) as first_ts, max(r.ts) as last_ts,
    sum(case when r.family = 'opus' then r.value_usd else 0 end) as opus_value,
    sum(case when r.ts <= b.first_limit_ts then r.value_usd else 0 end) as reached
  from {prefix}_base b join requests r on r.workspace_id = b.workspace_id and r.ts >= b.block_start and r.ts < b.block_end
  where r.ts >= timestamp '{start}' and r.ts < {until} group by 1, 2) q
  on q.workspace_id = b.workspace_id and q.s = b.s
left join (select b.workspace_id, b.s, count(*) as limits, count(*) filter (where e.limit_kind <> 'weekly') as block_limits,
    min(e.ts) as first_ts, max(e.ts) as last_ts
  from {prefix}_base b join limit_events e on e.workspace_id = b.workspace_id and e.ts >= b.block_start and e.ts < b.block_end
  where e.ts >= timestamp '{start}' and e.ts < {until} group by 1, 2) l
  on l.workspace_id = b.workspace_id and l.s = b.s""",
    )


# What the watermark of two streams, the slower of them, has closed.
CLOSED = "(select date_trunc('hour', least((select max(ts) from requests), (select max(ts) from limit_events)) - interval 10 minutes))"
block_ctes("closed", "2023-12-31 19:00:00", CLOSED)
block_ctes("month", "2023-12-31 19:00:00", "2024-01-31 00:00:00")
block_ctes("kept", "2023-12-02 00:00:00", "2024-01-31 00:00:00")
block_ctes("fortnight", "2024-01-16 19:00:00", "2024-01-31 00:00:00")
block_ctes("live", "2024-01-30 13:00:00", "2024-01-31 00:00:00")
block_ctes("twoday", "2024-01-28 19:00:00", "2024-01-31 00:00:00")
cte("month_found", "select * from month_blocks where block_end > timestamp '2024-01-01'")
cte("fortnight_found", "select * from fortnight_blocks where block_end > timestamp '2024-01-17'")
cte("live_found", "select * from live_blocks where block_end > timestamp '2024-01-30 18:00:00'")
cte("twoday_found", "select * from twoday_blocks where block_end > timestamp '2024-01-29'")
cte(
    "ceilings",
    """select workspace_id, quantile_cont(value_at_limit, 0.5) as median, quantile_cont(value_at_limit, 0.1) as p10,
  count(*) as samples from kept_blocks where value_at_limit >= 1 and block_limits > 0 group by 1""",
)


def active_sql(found: str) -> str:
    return f"""select b.workspace_id, block_start, block_end, requests, value,
  (epoch_us(timestamp '2024-01-31') - epoch_us(block_start)) / 1000.0::double as elapsed_ms,
  (epoch_us(block_end) - epoch_us(timestamp '2024-01-31')) / 1000.0::double as remaining_ms,
  value / (greatest(epoch_us(timestamp '2024-01-31') - epoch_us(first_ts), 900000000)::double / 3600000000) as burn_per_hour,
  value + value / (greatest(epoch_us(timestamp '2024-01-31') - epoch_us(first_ts), 900000000)::double / 3600000000)
    * (epoch_us(block_end) - epoch_us(timestamp '2024-01-31'))::double / 3600000000 as projected,
  c.median as ceiling, coalesce(c.samples, 0) as ceiling_samples
from {found} b left join ceilings c using (workspace_id)
where timestamp '2024-01-31' >= block_start and timestamp '2024-01-31' < block_end"""


cte("month_active", active_sql("month_found"))
cte("live_active", active_sql("live_found"))
cte("fortnight_active", active_sql("fortnight_found"))
cte("twoday_active", active_sql("twoday_found"))
_BLOCK_COLUMNS = """workspace_id, block_start, block_end, first_ts, last_ts, requests, round(value, 7) as value,
  round(opus_value, 7) as opus_value, limits, block_limits, first_limit_ts, round(value_at_limit, 7) as value_at_limit"""


def _month(t: Tables) -> DataFrame:
    return blocks.blocks_between(t.requests, t.limits, START, NOW)


def _ceilings(t: Tables) -> DataFrame:
    return blocks.learned_ceiling(t.requests, t.limits, NOW)


cte(
    "exact_chain",
    """select workspace_id, unnest(list_reduce(list_prepend([]::bigint[], list_transform(us, lambda x: [x])),
    lambda acc, x: case when len(acc) = 0 or x[1] >= acc[len(acc)] + 18000000000 then list_concat(acc, x) else acc end)) as s
from (select workspace_id, list(distinct u order by u) as us from (
  select workspace_id, epoch_us(ts) as u from requests where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'
  union all select workspace_id, epoch_us(ts) from limit_events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31') group by 1)""",
)


@query(
    "blk_exact_starts",
    """select c.workspace_id, make_timestamp(c.s) as block_start, count(*) filter (where not hit) as requests,
  round(sum(value), 7) as value, count(*) filter (where hit) as limits, min(ts) as first_ts, max(ts) as last_ts
from exact_chain c join (
  select workspace_id, ts, value_usd as value, false as hit from requests where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'
  union all select workspace_id, ts, 0, true from limit_events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31') e
  on e.workspace_id = c.workspace_id and epoch_us(e.ts) >= c.s and epoch_us(e.ts) < c.s + 18000000000 group by 1, 2""",
)
def blk_exact_starts(t: Tables) -> DataFrame:
    return blocks.exact_start_blocks(t.requests, t.limits, START, NOW)


@query("blk_blocks", f"select {_BLOCK_COLUMNS} from month_found")
def blk_blocks(t: Tables) -> DataFrame:
    return _month(t).drop("last_limit")


@query(
    "blk_value_at_limit",
    """select workspace_id, block_start, round(value_at_limit, 7) as value_at_limit from month_found where limits > 0""",
)
def blk_value_at_limit(t: Tables) -> DataFrame:
    return _month(t).filter(F.col("limits") > 0).select("workspace_id", "block_start", "value_at_limit")


@query(
    "blk_ceiling",
    "select workspace_id, round(median, 7) as median, round(p10, 7) as p10, samples from ceilings",
)
def blk_ceiling(t: Tables) -> DataFrame:
    return _ceilings(t)


@query(
    "blk_ceiling_cache",
    """select k.workspace_id, k.key,
  case when k.workspace_id in ('ws_0', 'ws_1') then timestamp '2024-01-30 12:00:00' else timestamp '2024-01-31' end as computed_at,
  round(case when k.workspace_id in ('ws_0', 'ws_1') then 42 else c.median end, 7) as median,
  round(case when k.workspace_id in ('ws_0', 'ws_1') then 40 else c.p10 end, 7) as p10,
  case when k.workspace_id in ('ws_0', 'ws_1') then 7 else c.samples end as samples
from (select workspace_id, concat(count(*), ':', epoch_us(max(ts))) as key from limit_events
  where ts >= timestamp '2023-12-02' group by 1) k left join ceilings c using (workspace_id)""",
)
def blk_ceiling_cache(t: Tables) -> DataFrame:
    """Two cached rows still hold, one has an old key and one is too old; the rest are new."""
    keys = blocks.ceiling_key(t.limits, NOW)
    stale = F.col("workspace_id") == "ws_2"
    old = F.col("workspace_id") == "ws_3"
    at = F.when(old, F.lit("2024-01-29 12:00:00")).otherwise("2024-01-30 12:00:00").cast("timestamp")
    cached = keys.filter(F.col("workspace_id").isin("ws_0", "ws_1", "ws_2", "ws_3")).select(
        "workspace_id", F.when(stale, "0:0").otherwise(F.col("key")).alias("key"), at.alias("computed_at"),
        F.lit(42.0).alias("median"), F.lit(40.0).alias("p10"), F.lit(7).cast("long").alias("samples"),
    )
    return blocks.refresh_ceilings(cached, t.requests, t.limits, NOW)


_ACTIVE_COLUMNS = """workspace_id, block_start, block_end, requests, round(value, 7) as value, elapsed_ms, remaining_ms,
  round(burn_per_hour, 7) as burn_per_hour, round(projected, 7) as projected, round(value / ceiling, 7) as pct_of_ceiling,
  round(projected / ceiling, 7) as projected_pct, round(ceiling, 7) as ceiling, ceiling_samples"""


@query("blk_active", f"select {_ACTIVE_COLUMNS} from month_active")
def blk_active(t: Tables) -> DataFrame:
    return blocks.active_block(_month(t), _ceilings(t), NOW)


_UNSEEN = "coalesce(c.samples >= 3 and b.value_at_limit < c.p10 * 0.6, false)"


@query(
    "blk_unseen",
    f"""select b.workspace_id, b.block_start, b.block_end, b.requests, round(b.value, 7) as value, b.limits > 0 as limited,
  {_UNSEEN} as unseen, case when b.limits > 0 and {_UNSEEN} then 'limit ?' when b.limits > 0 then 'limit'
  when timestamp '2024-01-31' >= block_start and timestamp '2024-01-31' < block_end then 'now' else '' end as tag
from month_found b left join ceilings c using (workspace_id)""",
)
def blk_unseen(t: Tables) -> DataFrame:
    return blocks.tagged_blocks(_month(t), _ceilings(t), NOW)


@query(
    "blk_stats",
    """select workspace_id, count(*) as blocks, round(avg(value), 7) as avg_value, count(*) filter (where limits > 0) as limited,
  round(count(*) filter (where limits > 0) / count(*)::double, 7) as limited_share from month_found group by 1""",
)
def blk_stats(t: Tables) -> DataFrame:
    return blocks.block_stats(_month(t))


@query(
    "blk_live",
    """select w.id as workspace_id, a.block_start is not null as active, round(coalesce(a.value, 0), 7) as value,
  coalesce(a.requests, 0) as requests, round(coalesce(a.burn_per_hour, 0), 7) as burn_per_hour,
  round(coalesce(a.projected, 0), 7) as projected, round(a.value / c.median, 7) as pct_of_ceiling,
  round(a.projected / c.median, 7) as projected_pct, round(c.median, 7) as ceiling, coalesce(c.samples, 0) as ceiling_samples,
  a.block_start, a.block_end, l.last_ingest
from workspaces w left join live_active a on a.workspace_id = w.id left join ceilings c on c.workspace_id = w.id
left join (select workspace_id, max(received_at) as last_ingest from log_entries group by 1) l on l.workspace_id = w.id""",
)
def blk_live(t: Tables) -> DataFrame:
    return live.live_view(t.requests, t.limits, t.ingest_log, t.workspaces, NOW)


@query(
    "blk_hour_points",
    """select workspace_id, epoch_us(date_trunc('hour', ts)) // 3600000000 as hour, model, count(*) as n, round(sum(value_usd), 7) as value
from requests q where not exists (select 1 from limit_events l where l.workspace_id = q.workspace_id
  and date_trunc('hour', l.ts) = date_trunc('hour', q.ts)) and ts < timestamp '2024-01-30 12:00:00' group by 1, 2, 3
union all
select workspace_id, epoch_us(date_trunc('hour', ts)) // 3600000000, model, 1, round(value_usd, 7)
from requests q where ts >= timestamp '2024-01-30 12:00:00' or exists (select 1 from limit_events l
  where l.workspace_id = q.workspace_id and date_trunc('hour', l.ts) = date_trunc('hour', q.ts))""",
)
def blk_hour_points(t: Tables) -> DataFrame:
    return blocks.compact_points(t.requests, t.limits, NOW).select("workspace_id", "hour", "model", "n", "value")


@query(
    "blk_manual",
    """select workspace_id, id, ts, limit_kind, source from limit_events
union all
select workspace_id, concat('m_', request_id), ts, case when model like '%haiku%' then 'weekly' else 'five_hour' end, 'manual'
from requests where ts <= timestamp '2024-01-20' and duration_ms is null""",
)
def blk_manual(t: Tables) -> DataFrame:
    kind = F.when(F.col("model").contains("haiku"), "weekly").otherwise("session")
    marks = t.requests.filter(F.col("duration_ms").isNull()).select(
        "workspace_id", F.concat(F.lit("m_"), "request_id").alias("id"), "ts", kind.alias("limit_kind")
    )
    return blocks.add_manual_limits(t.limits, marks, datetime(2024, 1, 20)).drop("session_id")


# ---- findings ------------------------------------------------------------------------------------

cte(
    "feature_rows",
    """select w.id as workspace_id, w.plan, w.plan_price_usd as price, c.value, c.opus_value, c.cache_hit_rate, c.unpriced,
  p.cache_hit_rate as prev_rate, coalesce(b.hits_now, 0) as hits_now, coalesce(b.hits_prev, 0) as hits_prev,
  coalesce(b.unseen, 0) as unseen, a.value / a.ceiling as pct, a.projected / a.ceiling as ppct,
  coalesce(e.n, 0) as too_long, coalesce(s.v, 0) as sub_value, coalesce(d.live, 0) as live, coalesce(d.silent, 0) as silent
from workspaces w join week_totals c on c.workspace_id = w.id join last_week_totals p on p.workspace_id = w.id
left join (select b.workspace_id,
    count(*) filter (where limits > 0 and block_start >= timestamp '2024-01-24' and block_start < timestamp '2024-01-31') as hits_now,
    count(*) filter (where limits > 0 and block_start >= timestamp '2024-01-17' and block_start < timestamp '2024-01-24') as hits_prev,
    count(*) filter (where coalesce(c.samples >= 3 and b.value_at_limit < c.p10 * 0.6, false)) as unseen
  from fortnight_found b left join ceilings c using (workspace_id) group by 1) b on b.workspace_id = w.id
left join fortnight_active a on a.workspace_id = w.id
left join (select workspace_id, count(*) as n from error_events where reason_class = 'prompt_too_long'
  and ts >= timestamp '2024-01-24' and ts < timestamp '2024-01-31' group by 1) e on e.workspace_id = w.id
left join (select workspace_id, sum(value_usd) as v from requests where is_subagent
  and ts >= timestamp '2024-01-24' and ts < timestamp '2024-01-31' group by 1) s on s.workspace_id = w.id
left join (select workspace_id, count(*) filter (where revoked_at is null) as live,
    count(*) filter (where revoked_at is null and last_seen_at < timestamp '2024-01-28') as silent
  from devices group by 1) d on d.workspace_id = w.id""",
)
def runaway_sql(factor: float, floor: float) -> str:
    return f"""select workspace_id, session_id, v, med from (
  select t.*, row_number() over (partition by t.workspace_id order by v desc, session_id) as r2, s.med from (
    select *, row_number() over (partition by workspace_id order by v desc, session_id) as r from (
      select workspace_id, session_id, sum(value_usd) as v from requests
      where ts >= timestamp '2024-01-24' and ts < timestamp '2024-01-31' group by 1, 2)) t
  join (select workspace_id, quantile_cont(v, 0.5) as med, count(*) as n from (
      select workspace_id, session_id, sum(value_usd) as v from requests
      where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31' group by 1, 2) group by 1) s
    on s.workspace_id = t.workspace_id
  where t.r <= 5 and s.n >= 5 and s.med <> 0 and t.v > greatest({factor} * s.med, {floor})) where r2 <= 2"""


cte("runaway_rows", runaway_sql(10, 5))
cte("mild_runaway_rows", runaway_sql(1.5, 0.5))


def _rule(name: str, severity: str, condition: str, measure: str, reference: str = "null") -> str:
    return (
        f"select workspace_id, '{name}' as id, {severity} as severity, null::varchar as subject, "
        f"({measure})::double as measure, ({reference})::double as reference from feature_rows where {condition}"
    )


_FITS = "price > 0 and value > 0"
_MULT = "value * (30.0::double / 7) / price"
cte(
    "finding_rows",
    "\nunion all ".join(
        [
            _rule("block-projection", "case when pct >= 0.9 then 'critical' else 'warning' end", "ppct >= 0.9", "ppct", "pct"),
            _rule("limit-trend", "'warning'", "hits_now >= 2 and hits_now > hits_prev", "hits_now", "hits_prev"),
            _rule("unseen-usage", "'warning'", "unseen > 0", "unseen"),
            _rule("opus-heavy", "'info'", "value > 5 and opus_value / value > 0.75", "opus_value / value"),
            _rule("cache-drop", "'warning'", "prev_rate - cache_hit_rate > 0.15", "cache_hit_rate", "prev_rate"),
            _rule("prompt-too-long", "'info'", "too_long >= 3", "too_long"),
            _rule("subagent-share", "'info'", "value > 5 and sub_value / value > 0.4", "sub_value / value"),
            _rule("plan-value", "'good'", f"{_FITS} and {_MULT} >= 1.5", _MULT, "price"),
            _rule("plan-underused", "'info'", f"{_FITS} and {_MULT} < 0.8 and plan <> 'pro'", _MULT, "price"),
            _rule("upgrade-hint", "'info'", f"{_FITS} and plan = 'max5x' and hits_now >= 4", "hits_now"),
            _rule("device-silent", "'warning'", "silent > 0 and live > silent", "silent", "live"),
            _rule("unpriced", "'info'", "unpriced > 0", "unpriced"),
            "select workspace_id, 'runaway', 'info', session_id, v, med from runaway_rows",
        ]
    ),
)


@query(
    "ins_findings",
    """select workspace_id, id, severity, subject, round(measure, 7) as measure, round(reference, 7) as reference,
  case severity when 'critical' then 0 when 'warning' then 1 when 'info' then 2 else 3 end as severity_rank from finding_rows""",
)
def ins_findings(t: Tables) -> DataFrame:
    return insights.findings(t.requests, t.limits, t.errors, t.devices, t.workspaces, NOW)


@query(
    "ins_runaway",
    """select workspace_id, 'runaway' as id, 'info' as severity, session_id as subject, round(v, 7) as measure,
  round(med, 7) as reference from mild_runaway_rows""",
)
def ins_runaway(t: Tables) -> DataFrame:
    return insights.runaway_sessions(t.requests, NOW, insights.Thresholds(runaway_factor=1.5, runaway_floor=0.5))


@query(
    "ins_top_agents",
    """select workspace_id, agent, requests, round(value, 7) as value from (
  select *, row_number() over (partition by workspace_id order by value desc, agent) as r from (
    select workspace_id, coalesce(agent_type, 'unknown') as agent, count(*) as requests, sum(value_usd) as value
    from requests where is_subagent and ts >= timestamp '2024-01-24' and ts < timestamp '2024-01-31' group by 1, 2)) where r <= 3""",
)
def ins_top_agents(t: Tables) -> DataFrame:
    return insights.top_agents(t.requests, NOW)


@query(
    "ins_digest",
    """select w.id as workspace_id, w.plan, w.plan_price_usd, c.requests, c.sessions, round(c.value, 7) as value,
  p.requests as prev_requests, round(p.value, 7) as prev_value,
  (select count(distinct model) from requests q where q.workspace_id = w.id and q.ts >= timestamp '2024-01-24'
    and q.ts < timestamp '2024-01-31')::int as models,
  (select string_agg(concat('project ', r, '=', s), ',' order by r) from (
     select row_number() over (order by v desc, project nulls last) as r, s from (
       select project, sum(value_usd) as v, count(distinct session_id) as s from requests q where q.workspace_id = w.id
         and q.ts >= timestamp '2024-01-24' and q.ts < timestamp '2024-01-31' group by 1)) where r <= 5) as top_projects,
  (select count(*) from live_week b where b.workspace_id = w.id) as blocks,
  (select count(*) from live_week b where b.workspace_id = w.id and b.limits > 0) as blocks_limited,
  round(l.median, 7) as ceiling,
  (select string_agg(id, ',' order by case severity when 'critical' then 0 when 'warning' then 1 when 'info' then 2 else 3 end, id)
    from finding_rows f where f.workspace_id = w.id) as findings
from workspaces w join week_totals c on c.workspace_id = w.id join last_week_totals p on p.workspace_id = w.id
left join ceilings l on l.workspace_id = w.id""",
)
def ins_digest(t: Tables) -> DataFrame:
    facts = insights.digest_facts(t.requests, t.limits, t.errors, t.devices, t.workspaces, NOW)
    named = F.transform("top_projects", lambda p: F.concat(p["project"], F.lit("="), p["sessions"].cast("string")))
    return facts.select(
        "workspace_id", "plan", "plan_price_usd", "requests", "sessions", "value", "prev_requests", "prev_value",
        F.size("models").alias("models"), F.array_join(named, ",").alias("top_projects"), "blocks", "blocks_limited",
        "ceiling", F.array_join("findings", ",").alias("findings"),
    )


block_ctes("week", "2024-01-23 19:00:00", "2024-01-31 00:00:00")
cte("live_week", "select * from week_blocks where block_end > timestamp '2024-01-24'")


# ---- alerts --------------------------------------------------------------------------------------

cte(
    "today_rows",
    """select q.workspace_id, sum(value_usd) as value from local_requests q
where q.ts < timestamp '2024-01-31' and q.local >= date_trunc('day', timezone(q.timezone, timezone('UTC', timestamp '2024-01-31')))
group by 1""",
)
cte(
    "alert_rows",
    """select r.id as rule_id, r.workspace_id, r.type, r.threshold, concat('block:', epoch_ms(a.block_start)) as dedupe_key,
  a.value / a.ceiling * 100 as measure
from alert_rules r join twoday_active a using (workspace_id)
where r.enabled and r.type = 'block_pct' and a.value / a.ceiling * 100 >= r.threshold
union all
select r.id, r.workspace_id, r.type, r.threshold, concat('limit:', epoch_ms(b.last_limit_ts)), 1
from alert_rules r join (select workspace_id, arg_max(last_limit_ts, block_start) as last_limit_ts from twoday_found
  where limits > 0 group by 1) b using (workspace_id)
where r.enabled and r.type = 'limit_hit' and b.last_limit_ts > timestamp '2024-01-30 18:00:00'
union all
select r.id, r.workspace_id, r.type, r.threshold,
  concat('day:', strftime(timezone(w.timezone, timezone('UTC', timestamp '2024-01-31')), '%Y-%m-%d')), coalesce(d.value, 0)
from alert_rules r join workspaces w on w.id = r.workspace_id left join today_rows d on d.workspace_id = w.id
where r.enabled and r.type = 'daily_value' and coalesce(d.value, 0) >= r.threshold
union all
select r.id, r.workspace_id, r.type, r.threshold, concat('week:', 1706659200 // 604800), t.value
from alert_rules r join week_totals t using (workspace_id)
where r.enabled and r.type = 'weekly_value' and t.value >= r.threshold
union all
select r.id, r.workspace_id, r.type, r.threshold, concat('silent:', string_agg(d.id, ',' order by d.id), ':', 1706659200 // 86400), count(*)
from alert_rules r join devices d using (workspace_id)
where r.enabled and r.type = 'device_silent' and d.revoked_at is null
  and d.last_seen_at < timestamp '2024-01-31' - interval 5 days
group by r.id, r.workspace_id, r.type, r.threshold""",
)


def _candidates(t: Tables) -> DataFrame:
    return alerts.candidates(t.view("alert_rules"), t.workspaces, t.requests, t.limits, t.devices, NOW)


@query(
    "alt_candidates",
    "select rule_id, workspace_id, type, threshold, dedupe_key, round(measure, 7) as measure from alert_rows",
)
def alt_candidates(t: Tables) -> DataFrame:
    return _candidates(t)


@query(
    "alt_fired",
    """select rule_id, workspace_id, type, threshold, dedupe_key, round(measure, 7) as measure, timestamp '2024-01-31' as fired_at
from alert_rows a where not exists (select 1 from alert_events e where e.rule_id = a.rule_id and e.dedupe_key = a.dedupe_key)""",
)
def alt_fired(t: Tables) -> DataFrame:
    return alerts.evaluate(
        t.view("alert_rules"), t.workspaces, t.requests, t.limits, t.devices, t.view("alert_events"), NOW
    )


@query(
    "str_alerts",
    """select rule_id, workspace_id, type, threshold, dedupe_key, round(measure, 7) as measure, timestamp '2024-01-31' as fired_at
from alert_rows a where not exists (select 1 from alert_events e where e.rule_id = a.rule_id and e.dedupe_key = a.dedupe_key)""",
)
def str_alerts(t: Tables) -> DataFrame:
    """The events file as a stream that only leaves usage tiles; rules are evaluated on these, with what fired before."""
    spark, folder = t.spark, shared_dir(t.spark, "alerts")
    given = t.view("alert_events").withColumns({"type": F.lit(""), "measure": F.lit(0.0), "threshold": F.lit(0.0), "fired_at": F.lit(None).cast("timestamp")})
    given.write.parquet(f"{folder}/alert_events/given")
    write_text(spark, f"{folder}/alert_events/_commits/given", "")
    _ceilings(t).write.parquet(f"{folder}/ceilings")  # kept by a daily job

    def handle(batch: DataFrame, batch_id: int) -> None:
        used, hits = priced(t.view("raw_requests", events=batch)), t.view("limit_events", events=batch)
        tiles.request_changes(used.limit(0), used).write.mode("overwrite").parquet(f"{folder}/request_tiles/generation={batch_id}")
        tiles.limit_tiles(hits).write.mode("overwrite").parquet(f"{folder}/limit_tiles/generation={batch_id}")

    schema = spark.read.parquet(f"{t.folder}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    touched = t.workspaces.select(F.col("id").alias("workspace_id"), F.lit(True).alias("has_limit"))
    fired = stream_alerts.check(spark, folder, "batch", touched, t.view("alert_rules"), t.workspaces, t.devices, spark.read.parquet(f"{folder}/ceilings"), NOW)
    return fired.select("rule_id", "workspace_id", "type", "threshold", "dedupe_key", "measure", "fired_at")


@query(
    "alt_due",
    """select w.id, w.alerts_checked_at from workspaces w join (
  select workspace_id, bool_or(event_type = 'error' and event_id % 20 = 0) as f from (
    select *, concat('ws_', user_id % 8) as workspace_id from events) where ts >= timestamp '2024-01-30 12:00:00' group by 1) t
  on t.workspace_id = w.id
where t.f or w.alerts_checked_at is null or w.alerts_checked_at < timestamp '2024-01-30 23:59:00'""",
)
def alt_due(t: Tables) -> DataFrame:
    rows = t.requests.select("workspace_id", "ts", F.lit(False).alias("has_limit")).unionByName(
        t.limits.select("workspace_id", "ts", F.lit(True).alias("has_limit"))
    )
    touched = rows.filter(F.col("ts") >= F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return alerts.due_workspaces(t.workspaces, touched, NOW).select("id", "alerts_checked_at")


@query("set_rule_workspaces", "select distinct workspace_id from alert_rules where enabled")
def set_rule_workspaces(t: Tables) -> DataFrame:
    return alerts.rule_workspaces(t.view("alert_rules"))
