"""Upload batches: JSON documents with a header and up to 500 records of six kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import amount, count, count_or_null, flag, instant, obj, raw, text
from ..schemas import MODEL_USAGE, RECORD_KINDS


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch file (gzip is recognised by its extension)."""
    raw_text = spark.read.text(path, wholetext=True)
    return raw_text.select(F.col("_metadata.file_path").alias("batch_id"), F.col("value").alias("body"))


def batch_headers(batches: DataFrame) -> DataFrame:
    """Header fields of each batch; other columns of ``batches`` pass through."""
    context = [c for c in batches.columns if c != "body"]
    # The object comes out of a generator, so a body is parsed once, not once per field.
    whole = batches.select(*context, F.explode(F.array(F.try_parse_json("body"))).alias("v"))
    v = F.col("v")
    unknown = F.try_variant_get(raw(v, "$.parser.unknownTypes"), "$", "map<string,bigint>")
    versions = F.try_variant_get(v, "$.device.ccVersions", "array<string>")
    records = F.try_variant_get(v, "$.records", "array<variant>")
    return whole.select(
        *context,
        count(v, "$.schemaVersion").alias("schema_version"),
        text(v, "$.accountHash").alias("account_hash"),
        text(v, "$.accountEmailProof").alias("email_proof"),
        text(v, "$.plan.rateLimitTier").alias("tier"),
        text(v, "$.device.os", 1000).alias("os"),
        F.coalesce(versions, F.array().cast("array<string>")).alias("cc_versions"),
        text(v, "$.parser.version").alias("parser_version"),
        F.coalesce(unknown, F.create_map().cast("map<string,bigint>")).alias("unknown_types"),
        count_or_null(v, "$.parser.malformedLines").alias("malformed_lines"),
        F.coalesce(F.size(records), F.lit(0)).alias("n_records"),
    )


def batch_records(batches: DataFrame) -> DataFrame:
    """One row per record: ``kind``, the record as VARIANT and its position in the batch."""
    context = [c for c in batches.columns if c != "body"]
    records = F.try_variant_get(F.try_parse_json("body"), "$.records", "array<variant>")
    rows = batches.select(*context, F.posexplode(records).alias("position", "v"))
    return rows.withColumn("kind", text(F.col("v"), "$.kind"))


def _whole(v: Column, path: str) -> Column:
    """Number as sent, so that validation can see negative values."""
    return F.try_variant_get(v, path, "bigint")


def _as_text(v: Column, path: str) -> Column:
    return text(v, path, 10_000)


_USAGE_TEXT = {
    "request_id": "requestId", "message_id": "messageId", "session_id": "sessionId", "model": "model",
    "agent_id": "agentId", "service_tier": "serviceTier", "speed": "speed", "inference_geo": "inferenceGeo",
    "effort": "effort", "agent_type": "agentType", "skill": "skill", "plugin": "plugin",
    "entrypoint": "entrypoint", "cc_version": "ccVersion", "project": "project", "git_branch": "gitBranch",
}
_USAGE_COUNT = {
    "input": "input", "output": "output", "cache_read": "cacheRead", "cache_write_5m": "cacheWrite5m",
    "cache_write_1h": "cacheWrite1h", "thinking": "thinking", "web_search": "webSearch", "web_fetch": "webFetch",
}


def records_of(records: DataFrame, kind: str) -> DataFrame:
    """Typed records of one kind, ready for validation."""
    if kind not in RECORD_KINDS:
        raise ValueError(f"unknown record kind {kind!r}")
    context = [c for c in records.columns if c not in ("v", "kind")]
    v = F.col("v")
    session, ts = _as_text(v, "$.sessionId").alias("session_id"), instant(v, "$.ts").alias("ts")
    if kind == "usage":
        columns = [
            *[_as_text(v, f"$.{path}").alias(name) for name, path in _USAGE_TEXT.items()],
            *[_whole(v, f"$.{path}").alias(name) for name, path in _USAGE_COUNT.items()],
            ts, flag(v, "$.isSubagent").alias("is_subagent"),
        ]
    elif kind == "error":
        columns = [
            _as_text(v, "$.id").alias("id"), session, ts, _as_text(v, "$.code").alias("code"),
            _as_text(v, "$.reasonClass").alias("reason_class"),
        ]
    elif kind == "limit":
        columns = [
            _as_text(v, "$.id").alias("id"), session, ts, _as_text(v, "$.limitKind").alias("limit_kind"),
            instant(v, "$.resetsAt").alias("resets_at"),
        ]
    elif kind == "session_meta":
        columns = [
            session, _as_text(v, "$.title").alias("title"), _as_text(v, "$.titleSource").alias("title_source"),
            _as_text(v, "$.agentName").alias("agent_name"),
        ]
    elif kind == "session_snapshot":
        names = MODEL_USAGE.valueType.names
        models = F.try_variant_get(obj(v, "$.modelUsage"), "$", "map<string,variant>")
        usage = F.transform_values(
            models,
            lambda _, e: F.struct(
                *[(amount(e, "$.costUSD") if n == "costUSD" else count(e, f"$.{n}")).alias(n) for n in names]
            ),
        )
        columns = [
            session, ts.alias("started_at"), F.try_variant_get(v, "$.totalCostUSD", "double").alias("total_cost_usd"),
            _whole(v, "$.apiMs").alias("api_ms"), _whole(v, "$.toolMs").alias("tool_ms"),
            _whole(v, "$.linesAdded").alias("lines_added"), _whole(v, "$.linesRemoved").alias("lines_removed"),
            usage.alias("model_usage"),
        ]
    else:
        columns = [
            _as_text(v, "$.id").alias("id"), session, ts, _as_text(v, "$.event").alias("event"),
            _whole(v, "$.durationMs").alias("duration_ms"), _whole(v, "$.preTokens").alias("pre_tokens"),
            _as_text(v, "$.trigger").alias("trigger"),
        ]
    # Typed columns leave through a generator, so validation filters test them instead of extracting again.
    return records.filter(F.col("kind") == kind).select(*context, F.inline(F.array(F.struct(*columns))))
