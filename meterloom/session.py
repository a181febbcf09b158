"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Needed on every session: wall-clock maths assumes UTC, attribute maps keep the last value.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Wide projections (a parsed session line has some 30 columns) otherwise compile to methods the JVM only
    # interprets; beyond this size Spark splits them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Sensible cluster defaults, only applied to sessions we build ourselves.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Workspaces and devices join by broadcast only while their measured size stays under this bound;
    # beyond it AQE plans a shuffled join and splits skewed partitions.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.parquet.filterPushdown": "true",
}


# Keyed state with timers needs this store.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """Settings that a stream with keyed state reads when it starts; the caller's own come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in STREAM_CONF}
    for key, value in STREAM_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to an existing session."""
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "meterloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **TUNING_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder.

    Clusters name that folder in ``spark.checkpoint.dir``. Without the setting, a session on one machine gets a
    scratch folder; elsewhere no folder is known to be shared, so the call fails instead of losing rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix=f"{name}-")
    return f"{root.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder: computed once, whatever reads them, and safe from lost executors."""
    folder = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
