"""Streaming deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import not_yet_sent

KEYS = ["workspace_id", "request_id"]


def first_events(stream: DataFrame, delay: str = "3 days", key: str = "id") -> DataFrame:
    """First arrival of each (workspace, id). State is dropped once the watermark has passed."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["workspace_id", key])


def grown(batch: DataFrame, sent: DataFrame, arrived: str = "ts") -> DataFrame:
    """Largest output per request in a batch, where it exceeds what was sent before.

    The maximum is partially aggregated before it shuffles, so a request repeated without end costs one row
    per task.
    """
    best = batch.groupBy(*KEYS).agg(F.max("output").alias("output"), F.max(F.to_date(arrived)).alias("day"))
    return not_yet_sent(best, sent, KEYS)


def send_growing(
    stream: DataFrame, folder: str, checkpoint: str, ttl_days: int = 3, trigger: dict | None = None,
    arrived: str | None = None,
) -> StreamingQuery:
    """Pass requests on only when their output grew; memory of what was sent lasts ``ttl_days`` from arrival.

    ``arrived`` names the column that holds the arrival time; without it, a row arrives when its batch runs. Times
    that clients set are not used, so an event dated in the future does not empty the memory.

    What was sent is a table by day and batch. A batch reads the days still remembered, without its own
    earlier attempt, and writes its own folder, so a replay gives the same rows.
    """
    schema = "workspace_id string, request_id string, output bigint, batch bigint, day date"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("_arrived", F.current_timestamp() if arrived is None else F.col(arrived))
        newest = batch.agg(F.max(F.to_date("_arrived"))).first()[0]
        if newest is None:
            return
        sent = spark.createDataFrame([], schema)
        if batch_id > 0:
            sent = spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(folder).filter(
                (F.col("day") >= F.date_sub(F.lit(newest), ttl_days)) & (F.col("batch") < batch_id)
            )
        rows = grown(batch, sent.select(*KEYS, "output"), "_arrived").withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(
            folder
        )

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
