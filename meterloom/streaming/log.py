"""One append-only log for all streams, and the one job that folds it into the fact tables.

A stream never rewrites a table. A micro-batch writes its records below ``log/<table>/stream=<s>/batch=<n>`` and then commits:
an empty file whose name holds source, batch and time of arrival. Repeating a batch replaces its folders and keeps its first
commit, so at-least-once input stands in the log once.

``compact`` takes the committed batches that no earlier generation took, orders them by arrival, and folds them:

1. it writes which batches it takes and stages the new content of every table folder they touch (``tables.stage_upsert``);
2. it marks the generation as staged; from here on a repeated call only does the rest;
3. it swaps the staged folders in, adds the generation's changes of the usage tiles, and marks it as done.

A lease, a file that only one caller can create, keeps a second compactor out, so streams may all call ``compact`` after each
batch: who comes second leaves the work to the first, or to the next call.
"""

from __future__ import annotations

import json
import os
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import as_ts
from ..operators import tiles
from ..schemas import DELIVERIES, INGEST_LOG, OTEL_METRICS
from ..sources.tables import (
    KEYED,
    exists,
    listed,
    read_text,
    remove,
    write_text,
    apply_upsert,
    stage_upsert,
    staged,
    write_facts,
)

#: Tables that only grow, with their clocks.
APPENDED = {"otel_metrics": (OTEL_METRICS, "ts"), "ingest_log": (INGEST_LOG, "received_at")}
TABLES = (*KEYED, *APPENDED)
MAX_BATCHES = 4096  # of a generation; more wait for the next one
_ROWS = 1 << 50  # positions inside a batch stay below it
LEASE_SECONDS = 3600


def append(folder: str, source: str, batch_id: int, records: dict[str, DataFrame], arrived_us: int | None = None) -> None:
    """Write the records of a micro-batch and commit it. Rows may have ``row``, their order within the batch."""
    spark = next(iter(records.values())).sparkSession
    for table, rows in records.items():
        ordered = rows if "row" in rows.columns else rows.withColumn("row", F.lit(0).cast("long"))
        ordered.write.mode("overwrite").parquet(f"{folder}/log/{table}/stream={source}/batch={batch_id}")
    commit = f"{folder}/log/_commits/{source}"
    if not any(int(name.split("-")[0]) == batch_id for name in listed(spark, commit)):
        at = time.time_ns() // 1000 if arrived_us is None else arrived_us
        write_text(spark, f"{commit}/{batch_id:012d}-{at:018d}", "")


def _waiting(spark: SparkSession, folder: str, taken: dict[str, int]) -> list[tuple[int, str, int]]:
    """(arrival, source, batch) of committed batches beyond those taken; each stream commits its batches in order."""
    found = []
    for source in listed(spark, f"{folder}/log/_commits"):
        for name in listed(spark, f"{folder}/log/_commits/{source}"):
            batch, at = map(int, name.split("-"))
            if batch > taken.get(source, -1):
                found.append((at, source, batch))
    return sorted(found)[:MAX_BATCHES]


def _records(spark: SparkSession, folder: str, table: str, batches: list[tuple[int, str, int]]) -> DataFrame | None:
    """Records of a table in the given batches, with ``seq`` that orders them by arrival."""
    places = [(f"{folder}/log/{table}/stream={source}/batch={batch}", source, batch, i) for i, (_, source, batch) in enumerate(batches)]
    places = [p for p in places if exists(spark, p[0])]
    if not places:
        return None
    rows = spark.read.option("basePath", f"{folder}/log/{table}").option("mergeSchema", "true").parquet(*(p[0] for p in places))
    order = spark.createDataFrame([p[1:] for p in places], "stream string, batch int, nth long")
    # At most MAX_BATCHES rows.
    met = rows.join(F.broadcast(order), ["stream", "batch"]).withColumn("seq", F.col("nth") * _ROWS + F.col("row"))
    schema = DELIVERIES if table == "requests" else KEYED[table].schema if table in KEYED else APPENDED[table][0]
    fields = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema if f.name != "seq"]
    return met.select(*fields, "seq")


class Lease:
    """Held by at most one caller at a time; one that was left behind runs out."""

    def __init__(self, spark: SparkSession, path: str, seconds: int = LEASE_SECONDS) -> None:
        self.spark, self.path, self.seconds = spark, path, seconds
        self.mark = f"{os.urandom(8).hex()} {time.time():.0f}"
        self.held = False

    def __enter__(self) -> bool:
        try:
            if exists(self.spark, self.path) and time.time() - float(read_text(self.spark, self.path).split()[1]) > self.seconds:
                remove(self.spark, self.path)
            write_text(self.spark, self.path, self.mark, replace=False)
            self.held = True
        except Exception as e:  # the file is there: another caller works
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e) and "IndexError" not in type(e).__name__:
                raise
        return self.held

    def __exit__(self, *_) -> None:
        if self.held and exists(self.spark, self.path) and read_text(self.spark, self.path) == self.mark:
            remove(self.spark, self.path)


def _generations(spark: SparkSession, folder: str) -> tuple[int, dict[str, int], str]:
    """Next generation, the last batch taken of each source, and where the next one stands ('', 'staged')."""
    names = listed(spark, f"{folder}/generations")
    done = [n for n in names if n.endswith(".done")]
    taken = json.loads(read_text(spark, f"{folder}/generations/{done[-1]}")) if done else {}
    number = int(done[-1].split(".")[0]) + 1 if done else 0
    return number, taken, "staged" if f"{number:012d}.staged" in names else ""


def compact(spark: SparkSession, folder: str) -> bool:
    """Fold what has been committed into the tables. False if another caller is at work or nothing waits."""
    with Lease(spark, f"{folder}/_lease") as held:
        if not held:
            return False
        number, taken, stands = _generations(spark, folder)
        mark, work = f"{folder}/generations/{number:012d}", f"{folder}/generations/work-{number:012d}"
        if not stands:
            batches = _waiting(spark, folder, taken)
            if not batches:
                return False
            _stage(spark, folder, work, batches)
            now_taken = dict(taken)
            for _, source, batch in batches:
                now_taken[source] = max(batch, now_taken.get(source, -1))
            write_text(spark, f"{mark}.staged", json.dumps(now_taken))
        _apply(spark, folder, work, number)
        write_text(spark, f"{mark}.done", read_text(spark, f"{mark}.staged"))
        remove(spark, f"{mark}.staged")
        remove(spark, work)
        _forget(spark, folder, number)
        return True


def _forget(spark: SparkSession, folder: str, number: int) -> None:
    """Remove marks that the newest one covers, so that listings stay short however many batches there were."""
    for name in listed(spark, f"{folder}/generations"):
        if name.endswith(".done") and name != f"{number:012d}.done":
            remove(spark, f"{folder}/generations/{name}")
    taken = json.loads(read_text(spark, f"{folder}/generations/{number:012d}.done"))
    for source, last in taken.items():
        for name in listed(spark, f"{folder}/log/_commits/{source}"):
            if int(name.split("-")[0]) <= last:
                remove(spark, f"{folder}/log/_commits/{source}/{name}")


def _stage(spark: SparkSession, folder: str, work: str, batches: list[tuple[int, str, int]]) -> None:
    changes = {}
    for table in TABLES:
        rows = _records(spark, folder, table, batches)
        if rows is None or rows.isEmpty():
            continue
        if table in KEYED:
            changes[table] = stage_upsert(spark, KEYED[table], f"{folder}/{table}", rows, f"{work}/{table}")
        else:
            rows.drop("seq").write.mode("overwrite").parquet(f"{work}/{table}")
    if "requests" in changes:
        change = changes["requests"]
        tiles.request_changes(change.before, change.after).write.mode("overwrite").parquet(f"{work}/request_tiles")
    if "limit_events" in changes:
        change = changes["limit_events"]
        new = change.after.join(change.before.select("workspace_id", "id"), ["workspace_id", "id"], "left_anti")
        tiles.limit_tiles(new).write.mode("overwrite").parquet(f"{work}/limit_tiles")


def _apply(spark: SparkSession, folder: str, work: str, number: int) -> None:
    for table in KEYED:
        if exists(spark, f"{work}/{table}/changed"):
            apply_upsert(spark, staged(spark, KEYED[table], f"{folder}/{table}", f"{work}/{table}"))
    for table, (schema, clock) in APPENDED.items():
        if exists(spark, f"{work}/{table}"):
            # A folder of its own per generation, so that a repeated call replaces what it wrote before.
            write_facts(spark.read.schema(schema).parquet(f"{work}/{table}"), f"{folder}/{table}/generation={number}", clock, mode="overwrite")
    for name in ("request_tiles", "limit_tiles"):
        if exists(spark, f"{work}/{name}"):
            spark.read.parquet(f"{work}/{name}").write.mode("overwrite").parquet(f"{folder}/{name}/generation={number}")


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Current rows of a fact table."""
    if table in KEYED:
        return KEYED[table].read(spark, f"{folder}/{table}").select(*KEYED[table].schema.names)
    schema = APPENDED[table][0]
    if not exists(spark, f"{folder}/{table}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{table}").select(*schema.names)


def read_tiles(spark: SparkSession, folder: str, name: str, since: datetime | None = None) -> DataFrame:
    """Changes of the tiles of all generations; ``tiles`` sums them."""
    schema = tiles.REQUEST_TILES if name == "request_tiles" else tiles.LIMIT_TILES
    if not exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return found if since is None else found.where(F.col("slot") >= F.floor(F.unix_seconds(as_ts(since)) / tiles.SECONDS))
