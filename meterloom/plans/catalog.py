"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ingest_queries, session_queries, usage_queries  # noqa: F401
from .registry import ORACLES, QUERIES, oracle_text, spark_query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: spark_query(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: oracle_text(sql) for name, sql in ORACLES.items()}
