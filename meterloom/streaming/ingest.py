"""Streaming ingest: landed session files and telemetry to the append-only log, from there to the fact tables and alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import otlp, parse
from ..operators.merge import REQUEST, SESSION, as_deliveries
from ..operators.validate import split_records
from ..sources.transcripts import stream_lines, with_position
from . import log


def usage_deliveries(
    parsed: DataFrame, batch_id: int, project_salt: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Deliveries of one micro-batch, one per request, and the records that failed validation."""
    rows = parse.usage(parsed, project_salt)
    one = parse.collapse_usage(rows, REQUEST)
    valid, refused = split_records(one, "usage")
    deliveries = as_deliveries(
        valid.withColumn("seq", F.lit(batch_id * 2)).withColumn("source", F.lit("transcript")).withColumn(
            "batch_id", F.lit(str(batch_id))
        )
    )
    return deliveries, as_refused(refused, "usage")


def as_refused(refused: DataFrame, kind: str) -> DataFrame:
    """Quarantine rows of any record kind: workspace, kind, reason and the record as JSON."""
    record = F.to_json(F.struct(*[c for c in refused.columns if c != "reason"]))
    return refused.select("workspace_id", F.lit(kind).alias("kind"), "reason", record.alias("record"))


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch under its own folder; a replay of the batch replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def session_records(parsed: DataFrame, batch_id: int, project_salt: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Records of all kinds in parsed lines, by table, and those that failed validation."""
    deliveries, quarantine = usage_deliveries(parsed, batch_id, project_salt)
    problems = parse.api_errors(parsed).drop("seq").withColumn("source", F.lit("transcript"))
    landed = F.col("landed_at") if "landed_at" in parsed.columns else F.lit(None).cast("timestamp")
    # One record per session and batch: what a session's later lines say counts.
    newest = parse.snapshots(parsed).withColumn("updated_at", landed)
    fields = [c for c in newest.columns if c not in (*SESSION, "seq")]
    newest = newest.groupBy(*SESSION).agg(F.max_by(F.struct(*fields), "seq").alias("_s")).select(*SESSION, "_s.*")
    lines = parse.meta_lines(parsed).withColumn("updated_at", landed)
    titles = parse.session_titles(lines, SESSION).join(lines.groupBy(*SESSION).agg(F.max("updated_at").alias("updated_at")), SESSION)
    split = {
        "error_events": ("error", problems.filter("kind = 'error'")),
        "limit_events": ("limit", problems.filter("kind = 'limit'")),
        "session_events": ("session_event", parse.session_events(parsed).drop("seq")),
        "session_snapshots": ("session_snapshot", newest),
        "session_meta": ("session_meta", titles),
    }
    found = {"requests": deliveries}
    for table, (kind, rows) in split.items():
        found[table], refused = split_records(rows, kind)
        quarantine = quarantine.unionByName(as_refused(refused, kind))
    read = parsed.groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("v").isNull()).alias("malformed_lines"), F.max(landed).alias("received_at")
    )
    found["ingest_log"] = read.withColumn("source", F.lit("transcript"))
    return found, quarantine


def telemetry_records(payloads: DataFrame, batch_id: int) -> dict[str, DataFrame]:
    """Requests and errors of log payloads, and points of metric payloads, by table.

    Every report of a request is a delivery of its own, numbered by arrival: the range shuffle splits a request that
    repeats without end, and ids grow from one range to the next.
    """
    records = otlp.log_records(payloads)
    arrival = ["received_at", "ts", "request_id", F.xxhash64("session_id", "output")]
    rows = otlp.requests(records).repartitionByRange(*arrival).sortWithinPartitions(*arrival)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    deliveries = as_deliveries(numbered.withColumn("source", F.lit("otel")).withColumn("batch_id", F.lit(str(batch_id))).withColumn("seq", F.col("row")))
    errors = otlp.errors(records).withColumn("source", F.lit("otel")).dropDuplicates(["workspace_id", "id"])
    received = payloads.groupBy("workspace_id", "device_id").agg(F.count(F.lit(1)).alias("records"), F.max("received_at").alias("received_at"))
    return {
        "requests": deliveries.withColumn("row", F.col("seq")),
        "error_events": errors,
        "otel_metrics": otlp.metrics(otlp.metric_points(payloads)),
        "ingest_log": received.withColumn("source", F.lit("otel")),
    }


def _deliveries(spark: SparkSession, folder: str, source: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/log/requests/stream={source}/batch={batch_id}")


def ingest_sessions(
    spark: SparkSession,
    root: str,
    folder: str,
    checkpoint: str,
    workspace_of: Callable[[DataFrame], DataFrame],
    project_salt: str | None = None,
    after: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Tail landed session files.

    Each micro-batch appends its records of all kinds to the log and has the log folded into the tables; records that fail
    validation go to ``quarantine`` with their reason. All steps give the same result when repeated, so at-least-once input
    has an exactly-once effect. ``workspace_of`` adds ``workspace_id`` to lines; ``after`` runs once the batch is folded (for
    example ``alerts.after_batch``).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # All record kinds come out of one parse; a lost executor only re-parses its part.
        parsed = parse.parse_lines(workspace_of(with_position(batch))).persist()
        records, quarantine = session_records(parsed, batch_id, project_salt)
        write_batch(quarantine, f"{folder}/quarantine", batch_id)
        write_batch(parse.unknown_counts(parsed, ["workspace_id"]), f"{folder}/unknown_types", batch_id)
        log.append(folder, "sessions", batch_id, records)
        parsed.unpersist()
        log.compact(batch.sparkSession, folder)
        if after is not None:
            after(_deliveries(batch.sparkSession, folder, "sessions", batch_id), batch_id)

    lines = stream_lines(spark, root, max_files)
    writer = lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingest_telemetry(
    spark: SparkSession,
    payloads: DataFrame,
    folder: str,
    checkpoint: str,
    after: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append streamed telemetry payloads, logs and metrics (``workspace_id, device_id, body, received_at``), to the same log.

    Reports of a request are merged in order of arrival.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        log.append(folder, "telemetry", batch_id, telemetry_records(batch, batch_id))
        log.compact(batch.sparkSession, folder)
        if after is not None:
            after(_deliveries(batch.sparkSession, folder, "telemetry", batch_id), batch_id)

    writer = payloads.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
