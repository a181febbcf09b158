"""Session lines (JSON text) to typed records.

Lines become VARIANT values once; every output column is an explicit typed path. Nothing is copied whole, so
message content cannot leak into a table.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import line_id, project_name
from ..functions.ranges import as_ts
from ..functions.text import classify_reason, is_limit, limit_kind, resets_at
from ..schemas import MODEL_USAGE

# Line types and system subtypes that are known and carry nothing we keep.
IGNORED_TYPES = (
    "user", "attachment", "last-prompt", "mode", "permission-mode", "queue-operation", "file-history-snapshot",
    "file-history-delta", "atis-latch", "relocated", "summary", "progress",
)
IGNORED_SYSTEM = ("stop_hook_summary", "away_summary", "local_command", "informational")
PARSED_TYPES = ("assistant", "cost-state", "ai-title", "custom-title", "agent-name", "system")
SYNTHETIC_MODEL = "<synthetic>"

# Separates line ids from other hashes; pass your deployment's key to reproduce ids it already stores.
LINE_KEY = "session-line"


def raw(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def is_object(v: Column, path: str) -> Column:
    """Whether the value is an object. Casting to a struct looks at field names only, while asking for the
    schema of a large value would walk all of it."""
    return F.try_variant_get(v, path, "struct<_:variant>").isNotNull()


def obj(v: Column, path: str) -> Column:
    """Sub-object at ``path``, null when it is anything but an object."""
    return F.when(is_object(v, path), raw(v, path))


def text(v: Column, path: str, size: int = 200) -> Column:
    """Non-empty JSON string, cut to ``size``; other JSON types are null."""
    x = F.when(kind(raw(v, path)) == "STRING", F.try_variant_get(v, path, "string"))
    return F.nullif(F.substring(x, 1, size), F.lit(""))


def string(v: Column, path: str) -> Column:
    """JSON string as it is (possibly empty); other JSON types are null."""
    return F.when(kind(raw(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str, as_type: str) -> Column:
    """JSON number; numeric strings, booleans and numbers out of range are null."""
    is_number = F.substring(kind(raw(v, path)), 1, 3).isin("BIG", "DEC", "DOU")
    return F.when(is_number, F.try_variant_get(v, path, as_type))


def _whole(v: Column, path: str) -> Column:
    return F.floor(_number(v, path, "decimal(20,2)")).cast("long")


def count(v: Column, path: str) -> Column:
    """Positive number rounded down, else 0."""
    return F.greatest(_whole(v, path), F.lit(0).cast("long"))


def count_or_null(v: Column, path: str) -> Column:
    """Non-negative number rounded down, else null."""
    return F.nullif(F.greatest(_whole(v, path), F.when(raw(v, path).isNotNull(), F.lit(-1))), F.lit(-1).cast("long"))


def amount(v: Column, path: str) -> Column:
    return F.greatest(F.nullif(_number(v, path, "double"), F.lit(float("inf"))), F.lit(0.0))


def flag(v: Column, path: str) -> Column:
    return F.coalesce((kind(raw(v, path)) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def instant(v: Column, path: str) -> Column:
    """ISO time at millisecond precision, or null."""
    return F.date_trunc("MILLISECOND", F.try_to_timestamp(string(v, path)))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Classify lines. Input: ``line`` plus any context columns; blank lines are dropped.

    Adds ``v`` (the parsed object, null when malformed), ``type`` and ``cc_version``. The object comes out of
    a generator, which filters cannot be pushed through: every line is parsed exactly once, whatever the
    operators downstream test on it.
    """
    context = [c for c in lines.columns if c != "line"]
    full = lines.filter(F.trim("line") != "")
    whole = full.select(*context, F.explode(F.array(F.try_parse_json("line"))).alias("v"))
    v = F.col("v")
    typed = whole.withColumn("v", obj(v, "$"))
    return typed.select(
        *context, "v",
        F.when(v.isNotNull(), F.coalesce(string(v, "$.type"), F.lit("(none)"))).alias("type"),
        text(v, "$.version", 50).alias("cc_version"),
    )


def unknown_key() -> Column:
    """Counter name of a line the parser does not know, else null."""
    v = F.col("v")
    subtype = F.coalesce(string(v, "$.subtype"), F.lit("(none)"))
    known_system = subtype.isin("compact_boundary", "turn_duration", *IGNORED_SYSTEM)
    placed = text(v, "$.sessionId").isNotNull() & instant(v, "$.timestamp").isNotNull()
    return F.when(
        F.col("type") == "system", F.when(placed & ~known_system, F.concat(F.lit("system/"), subtype))
    ).when(~F.col("type").isin(*PARSED_TYPES, *IGNORED_TYPES), F.col("type"))


def unknown_counts(parsed: DataFrame, by: list[str]) -> DataFrame:
    keyed = parsed.select(*by, unknown_key().alias("record_type")).filter(F.col("record_type").isNotNull())
    return keyed.groupBy(*by, "record_type").agg(F.count(F.lit(1)).alias("n"))


def line_counts(parsed: DataFrame, by: list[str]) -> DataFrame:
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines_read"), F.count_if(F.col("v").isNull()).alias("malformed_lines")
    )


def _assistant(parsed: DataFrame) -> DataFrame:
    """Assistant lines with a message, a session and a time."""
    v = F.col("v")
    return (
        parsed.filter(F.col("type") == "assistant")
        .withColumn("m", obj(v, "$.message"))
        .withColumn("session_id", text(v, "$.sessionId"))
        .withColumn("ts", instant(v, "$.timestamp"))
        .filter(F.col("m").isNotNull() & F.col("session_id").isNotNull() & F.col("ts").isNotNull())
        .withColumn("model", text(F.col("m"), "$.model", 100))
        .withColumn("is_error", flag(v, "$.isApiErrorMessage"))
    )


def _context(parsed: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in parsed.columns else F.lit(default)


def usage(parsed: DataFrame, project_salt: str | None = None) -> DataFrame:
    """Usage records, one per line. File context (``file_is_subagent``, ``file_agent_id``,
    ``file_agent_type``) is used when present."""
    v, m, u = F.col("v"), F.col("m"), F.col("u")
    context = [c for c in parsed.columns if c not in ("v", "type", "cc_version")]
    base = _assistant(parsed).filter(
        ~F.col("is_error") & (F.coalesce("model", F.lit(SYNTHETIC_MODEL)) != SYNTHETIC_MODEL)
    )
    base = base.withColumn("request_id", text(v, "$.requestId")).filter(F.col("request_id").isNotNull())
    base = base.withColumn("u", obj(m, "$.usage")).withColumn("is_subagent", F.coalesce(
        _context(parsed, "file_is_subagent", False), F.lit(False)) | flag(v, "$.isSidechain"))
    split = is_object(u, "$.cache_creation")
    w5 = F.when(split, count(u, "$.cache_creation.ephemeral_5m_input_tokens")).otherwise(0)
    w1 = F.when(split, count(u, "$.cache_creation.ephemeral_1h_input_tokens")).otherwise(0)
    rest = F.greatest(count(u, "$.cache_creation_input_tokens") - (w5 + w1), F.lit(0))
    sub = F.col("is_subagent")
    agent = F.when(sub, _context(parsed, "file_agent_type", None).cast("string"))
    return base.select(
        *context,
        "request_id",
        text(m, "$.id").alias("message_id"),
        "session_id", "ts", "model", "is_subagent",
        F.when(sub, F.coalesce(text(v, "$.agentId"), _context(parsed, "file_agent_id", None).cast("string"))).alias(
            "agent_id"
        ),
        count(u, "$.input_tokens").alias("input"),
        count(u, "$.output_tokens").alias("output"),
        count(u, "$.cache_read_input_tokens").alias("cache_read"),
        (w5 + rest).alias("cache_write_5m"),
        w1.alias("cache_write_1h"),
        count_or_null(u, "$.output_tokens_details.thinking_tokens").alias("thinking"),
        count(u, "$.server_tool_use.web_search_requests").alias("web_search"),
        count(u, "$.server_tool_use.web_fetch_requests").alias("web_fetch"),
        text(u, "$.service_tier", 50).alias("service_tier"),
        text(u, "$.speed", 50).alias("speed"),
        text(u, "$.inference_geo", 50).alias("inference_geo"),
        F.coalesce(text(v, "$.perTurnEffort", 50), text(v, "$.effort", 50)).alias("effort"),
        F.coalesce(text(v, "$.attributionAgent", 100), agent).alias("agent_type"),
        text(v, "$.attributionSkill", 100).alias("skill"),
        text(v, "$.attributionPlugin", 100).alias("plugin"),
        text(v, "$.entrypoint", 50).alias("entrypoint"),
        "cc_version",
        project_name(string(v, "$.cwd"), project_salt).alias("project"),
        text(v, "$.gitBranch", 200).alias("git_branch"),
    )


def message_text(m: Column) -> Column:
    """First text of a message (a string, or the first content part that has one), at most 500 characters."""
    parts = F.try_variant_get(m, "$.content", "array<variant>")
    whole = F.when(parts.isNull(), string(m, "$.content"))
    texts = F.transform(parts, lambda b: string(b, "$.text"))
    found = F.try_element_at(F.filter(texts, lambda t: t.isNotNull()), F.lit(1))
    return F.substring(F.coalesce(whole, found, F.lit("")), 1, 500)


def api_errors(parsed: DataFrame, line_key: str = LINE_KEY, zone: str = "UTC") -> DataFrame:
    """Locally reported API errors: limit hits and classified errors. The text itself is not kept."""
    v = F.col("v")
    context = [c for c in parsed.columns if c not in ("v", "type", "cc_version")]
    base = (
        _assistant(parsed)
        .filter("is_error")
        .withColumn("text", message_text(F.col("m")))
        .withColumn("code", text(v, "$.error", 100))
    )
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    fallback = F.concat(iso, F.lit(":"), F.coalesce("code", F.lit("null")))
    uuid = string(v, "$.uuid")
    limit = is_limit(F.col("text"))
    return base.select(
        *context,
        F.when(limit, "limit").otherwise("error").alias("kind"),
        line_id(line_key, F.col("session_id"), uuid, fallback).alias("id"),
        "session_id", "ts",
        F.when(~limit, F.col("code")).alias("code"),
        F.when(~limit, classify_reason(F.col("code"), F.col("text"))).alias("reason_class"),
        limit_kind(F.col("text")).alias("limit_kind"),
        F.when(limit, resets_at(F.col("text"), F.col("ts"), zone)).alias("resets_at"),
    )


def snapshots(parsed: DataFrame, max_models: int = 50) -> DataFrame:
    """Cost-state lines: the session's own accounting, with a per-model map."""
    v = F.col("v")
    context = [c for c in parsed.columns if c not in ("v", "type", "cc_version")]
    names = MODEL_USAGE.valueType.names

    def entry(e: Column) -> Column:
        fields = [count(e, f"$.{n}").alias(n) if n != "costUSD" else amount(e, "$.costUSD").alias(n) for n in names]
        return F.struct(*fields)

    models = F.try_variant_get(obj(v, "$.modelUsage"), "$", "map<string,variant>")
    pairs = F.slice(F.map_entries(models), 1, max_models)
    kept = F.filter(pairs, lambda p: is_object(p["value"], "$") & (F.length(p["key"]) <= 100))
    usage_map = F.map_from_entries(F.transform(kept, lambda p: F.struct(p["key"], entry(p["value"]))))
    start = _number(v, "$.startTime", "decimal(20,2)")
    return (
        parsed.filter(F.col("type") == "cost-state")
        .withColumn("session_id", text(v, "$.sessionId"))
        .filter(F.col("session_id").isNotNull())
        .select(
            *context, "session_id",
            F.timestamp_millis(F.floor(start).cast("long")).alias("started_at"),
            amount(v, "$.totalCostUSD").alias("total_cost_usd"),
            count(v, "$.totalAPIDuration").alias("api_ms"),
            count(v, "$.totalToolDuration").alias("tool_ms"),
            count(v, "$.totalLinesAdded").alias("lines_added"),
            count(v, "$.totalLinesRemoved").alias("lines_removed"),
            F.coalesce(usage_map, F.create_map().cast(MODEL_USAGE)).alias("model_usage"),
        )
    )


def meta_lines(parsed: DataFrame, titles: bool = True) -> DataFrame:
    """Title and agent-name lines of main session files (sub-agent files and ``titles=False`` give none)."""
    v = F.col("v")
    context = [c for c in parsed.columns if c not in ("v", "type", "cc_version")]
    wanted = parsed.filter(
        F.col("type").isin("ai-title", "custom-title", "agent-name")
        & F.lit(titles)
        & ~F.coalesce(_context(parsed, "file_is_subagent", False), F.lit(False))
    )
    custom = F.col("type") == "custom-title"
    generated = F.col("type") == "ai-title"
    title = F.when(custom, text(v, "$.customTitle", 300)).when(generated, text(v, "$.aiTitle", 300))
    out = wanted.select(
        *context,
        text(v, "$.sessionId").alias("session_id"),
        title.alias("title"),
        F.when(title.isNotNull(), F.when(custom, "custom").otherwise("ai")).alias("title_source"),
        F.when(F.col("type") == "agent-name", text(v, "$.agentName", 200)).alias("agent_name"),
    )
    return out.filter(
        F.col("session_id").isNotNull() & (F.col("title").isNotNull() | F.col("agent_name").isNotNull())
    )


def session_titles(meta: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One meta record per session and pass: the newest custom title, else the newest generated one."""
    is_custom = F.col("title_source") == "custom"
    best = F.max_by(
        F.struct("title", "title_source"),
        F.when(F.col("title").isNotNull(), F.struct(is_custom.alias("c"), F.col(seq).alias("s"))),
    )
    name = F.max_by("agent_name", F.when(F.col("agent_name").isNotNull(), F.col(seq)))
    return meta.groupBy(*keys).agg(best.alias("_b"), name.alias("agent_name")).select(
        *keys, "_b.title", "_b.title_source", "agent_name"
    )


def session_events(parsed: DataFrame, line_key: str = LINE_KEY) -> DataFrame:
    """Compactions and turn durations."""
    v = F.col("v")
    context = [c for c in parsed.columns if c not in ("v", "type", "cc_version")]
    base = (
        parsed.filter(F.col("type") == "system")
        .withColumn("subtype", string(v, "$.subtype"))
        .filter(F.col("subtype").isin("compact_boundary", "turn_duration"))
        .withColumn("session_id", text(v, "$.sessionId"))
        .withColumn("ts", instant(v, "$.timestamp"))
        .filter(F.col("session_id").isNotNull() & F.col("ts").isNotNull())
    )
    compact = F.col("subtype") == "compact_boundary"
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    fallback = F.concat(iso, F.when(compact, ":compact").otherwise(":turn"))
    uuid = string(v, "$.uuid")
    return base.select(
        *context,
        line_id(line_key, F.col("session_id"), uuid, fallback).alias("id"),
        "session_id", "ts",
        F.when(compact, "compaction").otherwise("turn").alias("event"),
        F.when(compact, count_or_null(v, "$.compactMetadata.durationMs"))
        .otherwise(count_or_null(v, "$.durationMs"))
        .alias("duration_ms"),
        F.when(compact, count_or_null(v, "$.compactMetadata.preTokens")).alias("pre_tokens"),
        F.when(compact, text(v, "$.compactMetadata.trigger", 50)).alias("trigger"),
    )


def collapse_usage(records: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One record per request: the largest output, ties to the latest line, plus the lines collapsed."""
    fields = [c for c in records.columns if c not in keys]
    best = F.max_by(F.struct(*fields), F.struct("output", seq))
    return records.groupBy(*keys).agg(best.alias("_r"), (F.count(F.lit(1)) - 1).alias("duplicate_lines")).select(
        *keys, "_r.*", "duplicate_lines"
    )


def not_yet_sent(records: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """Records not covered by what was already sent (same request with at least this output)."""
    known = sent.select(*keys, F.col("output").alias("_sent"))
    best = known.groupBy(*keys).agg(F.max("_sent").alias("_sent"))
    on = [records[k].eqNullSafe(best[k]) for k in keys] + [best["_sent"] >= records["output"]]
    return records.join(best, on, "left_anti")


def prune_sent(sent: DataFrame, now: datetime, days: int = 3) -> DataFrame:
    """The sent cache only covers a few days; older rows can be forgotten because the merge is idempotent."""
    return sent.filter(F.col("ts") >= as_ts(now - timedelta(days=days)))


def login_spans(passes: DataFrame) -> DataFrame:
    """Half-open spans ``(span_from, span_to]`` of each root and the account their lines belong to.

    ``passes`` lists collection passes: ``root, pass_at, account_hash`` (null when logged out) and
    ``caught_switch`` (the watcher saw the login change, so lines so far belong to the account before it).
    Spans in which the login changed unseen are ``ambiguous``. A root has one row per pass.
    """
    caught = F.coalesce("caught_switch", F.lit(False))
    effective = passes.filter(F.col("account_hash").isNotNull() | caught)
    w = W.partitionBy("root").orderBy("pass_at")
    saved = F.lag("account_hash").over(w)
    staged = effective.withColumn("saved", saved).withColumn("caught", caught)
    use_saved = F.col("caught") & F.col("saved").isNotNull()
    readable = staged.filter(use_saved | F.col("account_hash").isNotNull())
    return readable.withColumn("span_from", F.lag("pass_at").over(w)).select(
        "root", "span_from", F.col("pass_at").alias("span_to"),
        F.when(use_saved, F.col("saved")).otherwise(F.col("account_hash")).alias("label"),
        (~use_saved & F.coalesce(F.col("saved") != F.col("account_hash"), F.lit(False))).alias("ambiguous"),
    )


def label_accounts(lines: DataFrame, passes: DataFrame, landed: str = "landed_at") -> DataFrame:
    """As-of join of lines to the collection pass that read them.

    Spans are cut into hours and joined on (root, hour), so a busy root spreads over its hours instead of
    ending up in one task. Lines after the last pass have not been read yet and drop out. Lines before the
    first pass belong to it.
    """
    spans = login_spans(passes)
    hour_us = 3_600_000_000
    # The open first span is matched without cutting it into hours.
    closed = spans.filter(F.col("span_from").isNotNull()).withColumn(
        "_hour",
        F.explode(
            F.sequence(
                F.floor(F.unix_micros("span_from") / hour_us).cast("long"),
                F.floor(F.unix_micros("span_to") / hour_us).cast("long"),
            )
        ),
    )
    opening = spans.filter(F.col("span_from").isNull()).select(
        F.col("root").alias("_r0"), F.col("span_to").alias("_t0"), F.col("label").alias("_l0")
    )
    hour = F.floor(F.unix_micros(landed) / hour_us).cast("long")
    marked = lines.withColumn("_hour", hour).join(opening, F.col("root") == F.col("_r0"), "left")
    right = closed.select(
        F.col("root").alias("_root"), F.col("_hour").alias("_h"), "span_from", "span_to", "label", "ambiguous"
    )
    on = (
        (F.col("root") == F.col("_root"))
        & (F.col("_hour") == F.col("_h"))
        & (F.col(landed) > F.col("span_from"))
        & (F.col(landed) <= F.col("span_to"))
    )
    early = F.coalesce(F.col(landed) <= F.col("_t0"), F.lit(False))
    joined = marked.join(right, on, "left")
    return joined.filter(early | F.col("label").isNotNull()).select(
        *lines.columns,
        F.when(early, F.col("_l0")).otherwise(F.col("label")).alias("account_hash"),
        F.when(early, F.lit(False)).otherwise(F.col("ambiguous")).alias("ambiguous"),
    )


def pass_report(usage_rows: DataFrame, parsed: DataFrame, errors: DataFrame, by: list[str]) -> DataFrame:
    """Counters printed after a pass: lines, malformed, unique and repeated requests, sessions, sub-agents,
    errors and limit hits."""
    unique = collapse_usage(usage_rows, [*by, "request_id"])
    per_session = unique.groupBy(*by, "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_subagent").alias("sub"), F.sum("duplicate_lines").alias("dup")
    )
    used = per_session.groupBy(*by).agg(
        F.sum("n").alias("unique_requests"),
        F.sum("dup").alias("repeated_lines"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("sub").alias("subagent_requests"),
    )
    failed = errors.select(*by, "kind", "id").distinct().groupBy(*by).agg(
        F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "limit").alias("limits")
    )
    out = line_counts(parsed, by).join(used, by, "left").join(failed, by, "left")
    return out.fillna(0)
