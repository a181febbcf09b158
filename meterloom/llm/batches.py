"""Arrow helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step inside a task works on at a time.
SLICE_CHARS = 2_000_000
#: Bytes of a batch between the JVM and Python. An executor's C heap keeps the largest buffers of each of its threads after
#: they are freed, so 10,000 long rows at once cost memory long after their task.
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches by the bytes of a string column, so that a task holds one slice in Python at a time.

    A single longer text is a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        edges = np.cumsum(sizes, dtype=np.int64)
        at, done = 0, 0
        while at < len(edges):
            upto = max(at + 1, int(np.searchsorted(edges, done + limit, "right")))
            yield batch.slice(at, upto - at)
            at, done = upto, int(edges[upto - 1])


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def binary_column(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([memoryview(np.ascontiguousarray(r)).cast("B") if r.size else b"" for r in rows], pa.binary())


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``start .. start + length`` of all rows."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that all executors share (``spark.checkpoint.dir``).

    A session on one machine without that setting gets a folder of its own; elsewhere there is none that every executor
    is known to see, so the caller's mistake is reported.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{os.urandom(6).hex()}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand rows to Python in batches of up to ``BATCH_BYTES``; the caller's setting comes back afterwards."""
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, and a lost executor loses nothing."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def doc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, by which held-out rows are chosen; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
