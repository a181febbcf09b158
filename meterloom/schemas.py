"""Schemas of the fact, dimension and product tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(required: str, **fields: T.DataType) -> T.StructType:
    keys = set(required.split())
    return T.StructType([T.StructField(n, t, n not in keys) for n, t in fields.items()])


REQUESTS = _struct(
    "workspace_id request_id session_id ts model",
    workspace_id=_S, request_id=_S, message_id=_S, session_id=_S, device_id=_S, ts=_TS, model=_S,
    is_subagent=_B, agent_id=_S, agent_type=_S, skill=_S, plugin=_S,
    input=_L, output=_L, cache_read=_L, cache_write_5m=_L, cache_write_1h=_L, thinking=_L,
    web_search=_L, web_fetch=_L, service_tier=_S, speed=_S, inference_geo=_S, effort=_S, entrypoint=_S,
    cc_version=_S, project=_S, git_branch=_S, value_usd=_D, priced=_B,
    duration_ms=_L, query_source=_S, otel_cost_usd=_D, sources=T.ArrayType(_S),
)

# One row per upload of a request: what the merge folds over. ``seq`` orders deliveries within a request.
DELIVERIES = _struct(
    "workspace_id request_id seq source",
    workspace_id=_S, request_id=_S, seq=_L, batch_id=_S, source=_S,
    message_id=_S, session_id=_S, device_id=_S, ts=_TS, model=_S,
    is_subagent=_B, agent_id=_S, agent_type=_S, skill=_S, plugin=_S,
    input=_L, output=_L, cache_read=_L, cache_write_5m=_L, cache_write_1h=_L, thinking=_L,
    web_search=_L, web_fetch=_L, service_tier=_S, speed=_S, inference_geo=_S, effort=_S, entrypoint=_S,
    cc_version=_S, project=_S, git_branch=_S,
    duration_ms=_L, query_source=_S, otel_cost_usd=_D,
)

MODEL_USAGE = T.MapType(
    _S,
    _struct(
        "",
        inputTokens=_L, outputTokens=_L, thinkingTokens=_L, cacheReadInputTokens=_L,
        cacheCreationInputTokens=_L, webSearchRequests=_L, costUSD=_D,
    ),
)

SESSION_META = _struct(
    "workspace_id session_id",
    workspace_id=_S, session_id=_S, title=_S, title_source=_S, agent_name=_S, updated_at=_TS,
)
SESSION_SNAPSHOTS = _struct(
    "workspace_id session_id",
    workspace_id=_S, session_id=_S, started_at=_TS, total_cost_usd=_D, api_ms=_L, tool_ms=_L,
    lines_added=_L, lines_removed=_L, model_usage=MODEL_USAGE, updated_at=_TS,
)
SESSION_EVENTS = _struct(
    "workspace_id id session_id ts event",
    workspace_id=_S, id=_S, session_id=_S, ts=_TS, event=_S, duration_ms=_L, pre_tokens=_L, trigger=_S,
)
ERROR_EVENTS = _struct(
    "workspace_id id session_id ts reason_class",
    workspace_id=_S, id=_S, session_id=_S, device_id=_S, ts=_TS, code=_S, reason_class=_S, source=_S,
)
LIMIT_EVENTS = _struct(
    "workspace_id id ts limit_kind",
    workspace_id=_S, id=_S, session_id=_S, device_id=_S, ts=_TS, limit_kind=_S, resets_at=_TS, source=_S,
)
OTEL_METRICS = _struct(
    "workspace_id ts metric value",
    workspace_id=_S, device_id=_S, ts=_TS, metric=_S, kind=_S, session_id=_S, value=_D,
)
INGEST_LOG = _struct(
    "workspace_id source received_at",
    workspace_id=_S, device_id=_S, source=_S, received_at=_TS, records=_L, accepted=_L, deduplicated=_L,
    parser_version=_S, unknown_types=T.MapType(_S, _L), malformed_lines=_L,
)
WORKSPACES = _struct(
    "id name",
    id=_S, name=_S, owner_id=_S, account_hash=_S, hash_salt=_S, plan=_S, plan_price_usd=_D, detected_tier=_S,
    require_email_match=_B, extra_emails=T.ArrayType(_S), billing_day=_I, timezone=_S,
    alerts_checked_at=_TS, created_at=_TS,
)
MEMBERSHIPS = _struct("workspace_id user_id role", workspace_id=_S, user_id=_S, role=_S)
USERS = _struct("id email", id=_S, email=_S)
PLAN_PERIODS = _struct(
    "workspace_id plan effective_from",
    id=_L, workspace_id=_S, plan=_S, monthly_price_usd=_D, effective_from=T.DateType(),
)
DEVICES = _struct(
    "id workspace_id name",
    id=_S, workspace_id=_S, name=_S, os=_S, enrolled_via=_S, cc_versions=T.ArrayType(_S), parser_version=_S,
    created_at=_TS, last_seen_at=_TS, revoked_at=_TS, refused_uploads=_L, last_refused_at=_TS,
    last_refused_reason=_S,
)
ALERT_RULES = _struct(
    "id workspace_id type threshold",
    id=_S, workspace_id=_S, type=_S, threshold=_D, channel=_S, target=_S, enabled=_B,
)
ALERT_EVENTS = _struct(
    "rule_id workspace_id dedupe_key",
    rule_id=_S, workspace_id=_S, dedupe_key=_S, fired_at=_TS, message=_S, delivered=_B, error=_S,
)

# Closed vocabularies of the wire format.
REASON_CLASSES = ("prompt_too_long", "auth", "network", "rate_limit", "overloaded", "other")
LIMIT_KINDS = ("five_hour", "weekly", "unknown")
TITLE_SOURCES = ("ai", "custom")
SESSION_EVENT_KINDS = ("compaction", "turn")
RECORD_KINDS = ("usage", "error", "limit", "session_meta", "session_snapshot", "session_event")
ALERT_TYPES = ("block_pct", "limit_hit", "daily_value", "weekly_value", "device_silent")

# How long facts and the upload log are kept.
RETENTION_DAYS = 60
INGEST_LOG_DAYS = 14
MAX_RECORDS_PER_BATCH = 500
