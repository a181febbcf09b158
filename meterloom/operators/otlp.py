"""Telemetry payloads (OTLP JSON) to request, error and metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256
from ..functions.text import classify_status

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
LOGS_SCHEMA = (
    f"resourceLogs array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<logRecords:array<struct<"
    f"timeUnixNano:string,observedTimeUnixNano:string,body:struct<stringValue:string>,attributes:{_ATTRS}>>>>>>"
)
METRICS_SCHEMA = (
    f"resourceMetrics array<struct<resource:struct<attributes:{_ATTRS}>,scopeMetrics:array<struct<metrics:array<"
    f"struct<name:string,sum:struct<aggregationTemporality:string,dataPoints:array<struct<asDouble:double,"
    f"asInt:string,timeUnixNano:string,attributes:{_ATTRS}>>>>>>>>>"
)
# The telemetry namespace, kept metrics and the key of error ids.
NAMESPACE = "claude_code."
KEPT_METRICS = (
    "lines_of_code.count", "commit.count", "pull_request.count", "active_time.total", "session.count",
    "code_edit_tool.decision",
)
CUMULATIVE = ("2", "AGGREGATION_TEMPORALITY_CUMULATIVE")
ERROR_KEY = "otel-error"

_DERIVED = ("a", "event", "ts", "session_id", "resource_email")
_NUMERIC = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)?\s*$"


def _to_number(s: Column) -> Column:
    """Number a text stands for: blank is 0, anything else not numeric is null."""
    trimmed = F.trim(s)
    return F.when(s.rlike(_NUMERIC), F.when(trimmed == "", 0.0).otherwise(trimmed.try_cast("double")))


def _plain(d: Column) -> Column:
    """Text of a number: whole numbers without a fraction."""
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))


def attributes(*lists: Column) -> Column:
    """Attribute lists to one map; later lists override earlier ones.

    A value is its string, else integer, else double, else boolean; ``s`` is its text and ``n`` its number.
    """
    empty = F.array().cast(_ATTRS)
    joined = F.concat(*[F.coalesce(a, empty) for a in lists])
    usable = F.filter(
        joined,
        lambda kv: kv["key"].isNotNull()
        & F.coalesce(
            kv["value"]["stringValue"], kv["value"]["intValue"], kv["value"]["doubleValue"].cast("string"),
            kv["value"]["boolValue"].cast("string"),
        ).isNotNull(),
    )

    def typed(v: Column) -> Column:
        whole = _to_number(v["intValue"])
        return (
            F.when(
                v["stringValue"].isNotNull(),
                F.struct(v["stringValue"].alias("s"), _to_number(v["stringValue"]).alias("n")),
            )
            .when(
                v["intValue"].isNotNull(),
                F.struct(F.coalesce(_plain(whole), F.lit("NaN")).alias("s"), whole.alias("n")),
            )
            .when(
                v["doubleValue"].isNotNull(),
                F.struct(_plain(v["doubleValue"]).alias("s"), v["doubleValue"].alias("n")),
            )
            .otherwise(F.struct(v["boolValue"].cast("string").alias("s"), F.lit(None).cast("double").alias("n")))
        )

    return F.map_from_entries(F.transform(usable, lambda kv: F.struct(kv["key"].alias("key"), typed(kv["value"]))))


def attr_text(attrs: Column, key: str, size: int = 200) -> Column:
    return F.nullif(F.substring(F.try_element_at(attrs, F.lit(key))["s"], 1, size), F.lit(""))


def attr_number(attrs: Column, key: str) -> Column:
    n = F.try_element_at(attrs, F.lit(key))["n"]
    return F.when((n >= 0) & (n < float("inf")), n)


def nanos(v: Column) -> Column:
    """Epoch nanoseconds (as text) to a time, null when absent, malformed or not positive."""
    n = F.when(v.rlike(r"^\s*[+-]?\d{1,30}\s*$"), F.trim(v).try_cast("decimal(38,0)"))
    ms = F.floor(n / F.lit(1_000_000).cast("decimal(10,0)")).cast("long")
    return F.when(ms > 0, F.timestamp_millis(ms))


def log_records(payloads: DataFrame, body: str = "body", received: str = "received_at") -> DataFrame:
    """One row per log record: attribute map, event name, time and session. Other payload columns pass through."""
    context = [c for c in payloads.columns if c != body]
    parsed = payloads.withColumn("_p", F.from_json(body, LOGS_SCHEMA))
    rec = (
        parsed.select(*context, F.explode("_p.resourceLogs").alias("_r"))
        .select(*context, F.col("_r.resource.attributes").alias("_ra"), F.explode("_r.scopeLogs").alias("_s"))
        .select(*context, "_ra", F.explode("_s.logRecords").alias("_l"))
        .withColumn("a", attributes(F.col("_ra"), F.col("_l.attributes")))
    )
    a = F.col("a")
    name = F.coalesce(attr_text(a, "event.name"), F.col("_l.body.stringValue"), F.lit(""))
    stamped = F.try_to_timestamp(attr_text(a, "event.timestamp"))
    at = F.coalesce(nanos(F.col("_l.timeUnixNano")), nanos(F.col("_l.observedTimeUnixNano")), stamped, F.col(received))
    return rec.select(
        *context, "a",
        F.when(name.startswith(NAMESPACE), F.substring(name, len(NAMESPACE) + 1, 1000)).otherwise(name).alias("event"),
        at.alias("ts"),
        F.coalesce(attr_text(a, "session.id"), F.lit("unknown")).alias("session_id"),
        attr_text(attributes(F.col("_ra")), "user.email", 320).alias("resource_email"),
    )


def _request_id() -> Column:
    return F.coalesce(attr_text(F.col("a"), "request_id"), attr_text(F.col("a"), "client_request_id"))


def requests(records: DataFrame) -> DataFrame:
    """Request events as telemetry deliveries."""
    a = F.col("a")
    context = [c for c in records.columns if c not in _DERIVED]

    def tokens(key: str) -> Column:
        return F.coalesce(attr_number(a, key), F.lit(0.0)).cast("long")

    rows = records.filter(F.col("event") == "api_request").select(
        *context,
        _request_id().alias("request_id"),
        "session_id", "ts",
        attr_text(a, "model", 100).alias("model"),
        tokens("input_tokens").alias("input"),
        tokens("output_tokens").alias("output"),
        tokens("cache_read_tokens").alias("cache_read"),
        tokens("cache_creation_tokens").alias("cache_write_5m"),
        attr_number(a, "cost_usd").alias("otel_cost_usd"),
        attr_number(a, "duration_ms").cast("long").alias("duration_ms"),
        attr_text(a, "speed", 50).alias("speed"),
        attr_text(a, "effort", 50).alias("effort"),
        attr_text(a, "query_source", 100).alias("query_source"),
        attr_text(a, "agent.name", 100).alias("agent_type"),
        attr_text(a, "skill.name", 100).alias("skill"),
        attr_text(a, "plugin.name", 100).alias("plugin"),
        F.coalesce(attr_text(a, "app.version", 50), attr_text(a, "service.version", 50)).alias("cc_version"),
        F.lit("otel").alias("source"),
    )
    return rows.filter(F.col("request_id").isNotNull() & F.col("model").isNotNull())


def errors(records: DataFrame) -> DataFrame:
    """Error events with a deterministic id, so replays insert nothing."""
    a = F.col("a")
    context = [c for c in records.columns if c not in _DERIVED]
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    message = F.concat_ws(":", "session_id", F.coalesce(_request_id(), iso), "event")
    status = attr_text(a, "status_code", 10)
    text = F.coalesce(attr_text(a, "error", 300), F.lit(""))
    return records.filter(F.col("event").isin("api_error", "api_retries_exhausted")).select(
        *context,
        F.substring(hmac_sha256(ERROR_KEY, message), 1, 32).alias("id"),
        "session_id", "ts",
        status.alias("code"),
        classify_status(status, text).alias("reason_class"),
        F.lit("otel").alias("source"),
    )


def log_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """Per payload: requests, errors and ignored records."""
    request = F.col("event") == "api_request"
    usable = request & _request_id().isNotNull() & attr_text(F.col("a"), "model", 100).isNotNull()
    error = F.col("event").isin("api_error", "api_retries_exhausted")
    return records.groupBy(*by).agg(
        F.count_if(usable).alias("requests"),
        F.count_if(error).alias("errors"),
        F.count_if(~usable & ~error).alias("ignored"),
    )


def identities(records: DataFrame, by: list[str]) -> DataFrame:
    """Distinct account ids and e-mails per payload, for the gates. Payloads are bounded uploads."""
    a = F.col("a")
    return records.groupBy(*by).agg(
        F.array_sort(F.collect_set(attr_text(a, "user.account_uuid"))).alias("accounts"),
        F.array_sort(
            F.array_union(F.collect_set(attr_text(a, "user.email", 320)), F.collect_set("resource_email"))
        ).alias("emails"),
    )


def metric_points(payloads: DataFrame, body: str = "body", received: str = "received_at") -> DataFrame:
    """One row per data point of a kept metric; ``cumulative`` marks points that must be skipped."""
    context = [c for c in payloads.columns if c != body]
    names = [NAMESPACE + m for m in KEPT_METRICS]
    parsed = payloads.withColumn("_p", F.from_json(body, METRICS_SCHEMA))
    point = (
        parsed.select(*context, F.explode("_p.resourceMetrics").alias("_r"))
        .select(*context, F.col("_r.resource.attributes").alias("_ra"), F.explode("_r.scopeMetrics").alias("_s"))
        .select(*context, "_ra", F.explode("_s.metrics").alias("_m"))
        .filter(F.col("_m.name").isin(*names) & F.col("_m.sum").isNotNull())
        .select(*context, "_ra", "_m", F.explode("_m.sum.dataPoints").alias("_d"))
        .withColumn("a", attributes(F.col("_ra"), F.col("_d.attributes")))
    )
    a = F.col("a")
    value = F.coalesce(F.col("_d.asDouble"), _to_number(F.col("_d.asInt")))
    return point.select(
        *context, "a",
        F.coalesce(nanos(F.col("_d.timeUnixNano")), F.col(received)).alias("ts"),
        F.substring("_m.name", len(NAMESPACE) + 1, 200).alias("metric"),
        F.coalesce(attr_text(a, "type", 50), attr_text(a, "decision", 50)).alias("kind"),
        attr_text(a, "session.id").alias("session_id"),
        F.when(F.abs(value) < float("inf"), value).alias("value"),
        F.coalesce(F.col("_m.sum.aggregationTemporality").isin(*CUMULATIVE), F.lit(False)).alias("cumulative"),
    )


def metrics(points: DataFrame) -> DataFrame:
    """Delta sums to store. Replays add up again; see ``distinct_metrics``."""
    return points.filter(~F.col("cumulative") & F.col("value").isNotNull()).drop("a", "cumulative")


def distinct_metrics(rows: DataFrame) -> DataFrame:
    """Optional: drop exact repeats of a metric point."""
    return rows.distinct()


def cumulative_skipped(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(F.count_if("cumulative").alias("cumulative_skipped"))
