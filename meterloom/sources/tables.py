"""Fact tables on Parquet.

A table with a clock has one folder per UTC day, a table with keys also one per hash bucket of its key, so that an upsert
opens only the buckets of days that hold touched rows. Which day a key is in says a narrow index beside the table (hash and
day, in the same buckets): an upsert reads the index of its buckets, never the facts of other days.

Files are laid out by (workspace, time) within a folder, so row-group statistics prune a workspace's reads. The layout of
tables without keys is produced by a range shuffle, which also cuts a very busy workspace into several files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranges import in_range
from ..operators import merge
from ..operators.maintenance import RETENTION, cutoff_day, kept
from ..operators.merge import REQUEST, SESSION
from ..schemas import (
    ERROR_EVENTS,
    LIMIT_EVENTS,
    REQUESTS,
    SESSION_EVENTS,
    SESSION_META,
    SESSION_SNAPSHOTS,
)
from ..session import shared_dir

DAY = "day"
BUCKET = "bucket"
BUCKETS = 16  # of a day; a table keeps the number it was begun with


def _laid_out(df: DataFrame, ts: str) -> DataFrame:
    with_day = df.withColumn(DAY, F.to_date(ts))
    return with_day.repartitionByRange(DAY, "workspace_id", ts).sortWithinPartitions(DAY, "workspace_id", ts)


def write_facts(df: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Write rows into their day folders; ``overwrite`` replaces only the days present in ``df``."""
    writer = _laid_out(df, ts).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DAY, *([BUCKET] if BUCKET in df.columns else [])).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_facts(
    spark: SparkSession, path: str, schema: T.StructType, start: datetime | None = None, end: datetime | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Facts in a half-open range: day folders outside it are never listed, the rest is filtered by time."""
    with_day = T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])
    df = spark.read.schema(with_day).parquet(path).select(*with_day.names)
    if start is not None:
        df = df.filter(F.col(DAY) >= F.lit(start.date()))
    if end is not None:
        df = df.filter(F.col(DAY) <= F.lit(end.date()))
    if start is not None and end is not None:
        df = df.filter(in_range(start, end, ts))
    return df.drop(DAY)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small file; without ``replace`` it is an error if the file is there already, whoever made it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, replace)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
    finally:
        found.close()


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _drop_days(spark: SparkSession, path: str, days: list[str]) -> None:
    for day in days:
        remove(spark, f"{path}/{DAY}={day}")


@dataclass(frozen=True)
class Keyed:
    """How a stored table with one row per key takes in new records.

    ``fold(stored, incoming)`` gives the new rows of all keys in ``incoming``; repeating it changes nothing.
    """

    keys: list[str]
    schema: T.StructType
    fold: Callable[[DataFrame, DataFrame], DataFrame]
    ts: str | None = None  # the clock that places a row in a day
    buckets: int = BUCKETS

    @property
    def folders(self) -> list[str]:
        return [*([DAY] if self.ts else []), BUCKET]

    def placed(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumn(BUCKET, self.bucket())
        return out.withColumn(DAY, F.to_date(self.ts)) if self.ts else out

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        kinds = {DAY: T.DateType(), BUCKET: T.IntegerType()}
        schema = T.StructType([*self.schema.fields, *(T.StructField(f, kinds[f]) for f in self.folders)])
        if not exists(spark, path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path)


def _fold_requests(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge.merge_deliveries(merge.stored_as_deliveries(stored).unionByName(merge.as_deliveries(incoming)))


def _after(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows as the first records, then the incoming ones."""
    return stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(incoming, allowMissingColumns=True)


def _first_wins(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge.first_wins(_after(stored, incoming))


KEYED = {
    "requests": Keyed(REQUEST, REQUESTS, _fold_requests, "ts"),
    "session_meta": Keyed(SESSION, SESSION_META, lambda stored, new: merge.merge_meta(_after(stored, new))),
    "session_snapshots": Keyed(SESSION, SESSION_SNAPSHOTS, lambda stored, new: merge.merge_snapshots(_after(stored, new))),
    "session_events": Keyed(["workspace_id", "id"], SESSION_EVENTS, _first_wins, "ts"),
    "error_events": Keyed(["workspace_id", "id"], ERROR_EVENTS, _first_wins, "ts"),
    "limit_events": Keyed(["workspace_id", "id"], LIMIT_EVENTS, _first_wins, "ts"),
}


def _index(spark: SparkSession, path: str) -> DataFrame:
    schema = "key long, day date, bucket int"
    # Folders that begin with an underscore are no part of the table.
    where = f"{path}/_index"
    return spark.read.schema(schema).parquet(where) if exists(spark, where) else spark.createDataFrame([], schema)


def _among(table: Keyed, folders: list[tuple]) -> Column:
    """Partition filter for a list of folders: by day, those with the same buckets together."""
    if not table.ts:
        return F.col(BUCKET).isin([b for (b,) in folders])
    by_day: dict = {}
    for day, bucket in folders:
        by_day.setdefault(day, set()).add(bucket)
    by_buckets: dict = {}
    for day, buckets in by_day.items():
        by_buckets.setdefault(tuple(sorted(buckets)), []).append(day)
    found = F.lit(False)
    for buckets, days in by_buckets.items():
        found = found | (F.col(DAY).isin(days) & F.col(BUCKET).isin(list(buckets)))
    return found


@dataclass
class Staged:
    """New content of some folders of a table, written in full below ``at``; ``before`` and ``after`` are the touched rows."""

    table: Keyed
    path: str
    at: str
    before: DataFrame
    after: DataFrame


def folders_of(spark: SparkSession, table: Keyed, path: str, touched: DataFrame) -> list[tuple]:
    """Folders that may hold stored rows of the touched keys, found in the index of their buckets."""
    # At most one value per bucket, then at most one folder per day and bucket.
    buckets = [r[0] for r in touched.select(BUCKET).distinct().collect()]
    if not table.ts:
        return [(b,) for b in buckets]
    hashed = touched.select(F.xxhash64(*table.keys).alias("key"), BUCKET)
    old = _index(spark, path).where(F.col(BUCKET).isin(buckets)).join(hashed, ["key", BUCKET], "left_semi")
    return [tuple(r) for r in old.select(DAY, BUCKET).distinct().collect()]


def stage_upsert(spark: SparkSession, table: Keyed, path: str, incoming: DataFrame, at: str) -> Staged:
    """Fold ``incoming`` into the stored rows it touches. Nothing below ``path`` changes yet."""
    touched = incoming.select(*table.keys).distinct().withColumn(BUCKET, table.bucket())
    folders = folders_of(spark, table, path, touched)
    stored = table.read(spark, path)
    opened = stored.where(_among(table, folders))
    names = table.schema.names
    opened.join(touched, table.keys, "left_semi").select(*names).write.mode("overwrite").parquet(f"{at}/before")
    before = spark.read.schema(table.schema).parquet(f"{at}/before")
    folded = table.fold(before, incoming).select(*(F.col(f.name).cast(f.dataType) for f in table.schema.fields))
    table.placed(folded).write.mode("overwrite").parquet(f"{at}/after")
    after = spark.read.parquet(f"{at}/after")
    changed = sorted({*folders, *(tuple(r) for r in after.select(*table.folders).distinct().collect())})
    rest = stored.where(_among(table, changed)).join(touched, table.keys, "left_anti")
    whole = rest.select(*names, *table.folders).unionByName(after.select(*names, *table.folders))
    order = [*table.folders, "workspace_id", *([table.ts] if table.ts else table.keys)]
    laid = whole.repartition(*table.folders).sortWithinPartitions(*order)
    laid.write.mode("overwrite").partitionBy(*table.folders).parquet(f"{at}/folders")
    write_text(spark, f"{at}/changed", "\n".join("/".join(f"{f}={x}" for f, x in zip(table.folders, folder, strict=True)) for folder in changed))
    return Staged(table, path, at, before, after)


def staged(spark: SparkSession, table: Keyed, path: str, at: str) -> Staged:
    """What ``stage_upsert`` wrote below ``at`` earlier."""
    return Staged(table, path, at, spark.read.schema(table.schema).parquet(f"{at}/before"), spark.read.parquet(f"{at}/after"))


def apply_upsert(spark: SparkSession, change: Staged) -> None:
    """Swap staged folders in. Reads staged files only, so it may be repeated after any failure.

    The index learns of new places first: an entry without a row does no harm, a row without an entry would be missed.
    """
    table, path = change.table, change.path
    if table.ts:
        places = change.after.select(F.xxhash64(*table.keys).alias("key"), DAY, BUCKET)
        known = _index(spark, path).join(change.after.select(BUCKET).distinct(), BUCKET, "left_semi")
        new = places.join(known, ["key", DAY, BUCKET], "left_anti")
        new.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(f"{path}/_index")
    kinds = {DAY: T.DateType(), BUCKET: T.IntegerType()}
    schema = T.StructType([*table.schema.fields, *(T.StructField(f, kinds[f]) for f in table.folders)])
    ready = spark.read.schema(schema).parquet(f"{change.at}/folders")
    order = [*table.folders, "workspace_id", *([table.ts] if table.ts else table.keys)]
    writer = ready.repartition(*table.folders).sortWithinPartitions(*order).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*table.folders).parquet(path)
    # Folders that have lost their last row are not among the staged ones.
    for folder in read_text(spark, f"{change.at}/changed").split("\n"):
        if folder and not exists(spark, f"{change.at}/folders/{folder}"):
            remove(spark, f"{path}/{folder}")


def upsert_request_table(spark: SparkSession, path: str, incoming: DataFrame, table: Keyed = KEYED["requests"]) -> None:
    """Merge new deliveries into the stored request table.

    Only folders that hold touched requests are read and rewritten. Their new content is staged in full first and then
    swapped in, so a lost executor or a repeated call leaves the same table.
    """
    at = shared_dir(spark, "upsert")
    apply_upsert(spark, stage_upsert(spark, table, path, incoming, at))
    remove(spark, at)


def drop_expired(spark: SparkSession, path: str, table: str, now: datetime) -> None:
    """Retention: remove expired day folders whole and rewrite the cut-off day without its expired rows.

    The day's remaining rows are staged in full before they replace it, so a lost executor leaves the same table.
    """
    if not exists(spark, path):
        return
    cutoff = cutoff_day(table, now).date()
    stored = spark.read.parquet(path)
    # At most one entry per calendar day. Index entries of removed rows point nowhere, which an upsert passes over.
    days = {str(r[0]) for r in stored.select(DAY).distinct().filter(F.col(DAY) <= F.lit(cutoff)).collect()}
    _drop_days(spark, path, sorted(days - {str(cutoff)}))
    if str(cutoff) not in days:
        return
    edge = spark.read.parquet(path).filter(F.col(DAY) == F.lit(cutoff)).drop(DAY)
    staging = shared_dir(spark, "retention")
    kept(edge, table, now).write.parquet(staging)
    left = spark.read.schema(edge.schema).parquet(staging)
    if left.isEmpty():
        _drop_days(spark, path, [str(cutoff)])
    else:
        write_facts(left, path, RETENTION[table][0], mode="overwrite")
    remove(spark, staging)
