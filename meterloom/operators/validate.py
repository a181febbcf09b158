"""Record validation: every record is either valid or quarantined with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import LIMIT_KINDS, MAX_RECORDS_PER_BATCH, REASON_CLASSES, SESSION_EVENT_KINDS, TITLE_SOURCES

_HASH = "^[a-f0-9]{64}$"


def _id(name: str, nullable: bool = False) -> Column:
    bad = ~F.length(name).between(1, 200)
    return F.when(_bad(name, bad, nullable), f"{name}: length")


def _bad(name: str, bad: Column, nullable: bool) -> Column:
    bad = F.coalesce(bad, F.lit(False))
    return bad if nullable else bad | F.col(name).isNull()


def _text(name: str, size: int = 200, nullable: bool = True, smallest: int = 0) -> Column:
    bad = ~F.length(name).between(smallest, size)
    return F.when(_bad(name, bad, nullable), f"{name}: length")


def _count(name: str, nullable: bool = False) -> Column:
    return F.when(_bad(name, F.col(name) < 0, nullable), f"{name}: negative or missing")


def _amount(name: str) -> Column:
    return F.when(_bad(name, ~(F.col(name) >= 0), False), f"{name}: negative or missing")


def _given(name: str) -> Column:
    return F.when(F.col(name).isNull(), f"{name}: missing")


def _one_of(name: str, allowed: Sequence[str], nullable: bool = False) -> Column:
    return F.when(_bad(name, ~F.col(name).isin(*allowed), nullable), f"{name}: not allowed")


def _checks(kind: str) -> list[Column]:
    if kind == "usage":
        return [
            _id("request_id"), _id("message_id", True), _id("session_id"), _given("ts"), _text("model", 100, False, 1),
            _given("is_subagent"), _id("agent_id", True),
            *[_count(c) for c in ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")],
            _count("thinking", True), _count("web_search"), _count("web_fetch"),
            *[
                _text(c)
                for c in ("service_tier", "speed", "inference_geo", "effort", "agent_type", "skill", "plugin",
                          "entrypoint", "cc_version", "project", "git_branch")
            ],
        ]
    if kind == "error":
        return [_id("id"), _id("session_id"), _given("ts"), _text("code"), _one_of("reason_class", REASON_CLASSES)]
    if kind == "limit":
        return [_id("id"), _id("session_id"), _given("ts"), _one_of("limit_kind", LIMIT_KINDS)]
    if kind == "session_meta":
        return [
            _id("session_id"), _text("title", 300), _one_of("title_source", TITLE_SOURCES, True), _text("agent_name")
        ]
    if kind == "session_snapshot":
        counts = [_count(c) for c in ("api_ms", "tool_ms", "lines_added", "lines_removed")]
        entries = F.map_entries("model_usage")

        def entry_bad(e: Column) -> Column:
            u = e["value"]
            fields = ("inputTokens", "outputTokens", "thinkingTokens", "cacheReadInputTokens",
                      "cacheCreationInputTokens", "webSearchRequests", "costUSD")
            bad = F.length(e["key"]) > 100
            for name in fields:
                bad = bad | u[name].isNull() | (u[name] < 0)
            return bad

        usage = F.when(_bad("model_usage", F.exists(entries, entry_bad), False), "model_usage: entry")
        return [_id("session_id"), _amount("total_cost_usd"), *counts, usage]
    if kind == "session_event":
        return [
            _id("id"), _id("session_id"), _given("ts"), _one_of("event", SESSION_EVENT_KINDS),
            _count("duration_ms", True), _count("pre_tokens", True), _text("trigger"),
        ]
    raise ValueError(f"unknown record kind {kind!r}")


def with_reason(records: DataFrame, kind: str) -> DataFrame:
    """Add ``reason``: the failed checks joined by ``; ``, null for valid records."""
    failed = F.array_compact(F.array(*_checks(kind)))
    return records.withColumn("reason", F.when(F.size(failed) > 0, F.array_join(failed, "; ")))


def split_records(records: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): row-level split; quarantine keeps its ``reason``."""
    checked = with_reason(records, kind)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def split_batches(records: DataFrame, kind: str, batch: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """Strict mode: one bad record quarantines its whole batch.

    Records meet in their batch, so either side reads them once. Records of no batch stand alone: bad ones are in neither.
    """
    worst = F.min("reason").over(W.partitionBy(batch))
    checked = with_reason(records, kind).withColumn("batch_reason", F.when(F.col(batch).isNotNull(), worst))
    columns = [batch, *(c for c in records.columns if c != batch)]
    good = F.col("reason").isNull() & F.col("batch_reason").isNull()
    return checked.filter(good).select(*columns), checked.filter(F.col("batch_reason").isNotNull()).select(*columns, "batch_reason")


def batch_reason(batches: DataFrame) -> DataFrame:
    """Check batch headers: schema version, hashes, sizes. Adds ``reason``."""
    failed = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("schema_version") != 1, F.lit(True)), "schema_version"),
            F.when(F.coalesce(~F.col("account_hash").rlike(_HASH), F.lit(True)), "account_hash"),
            F.when(F.coalesce(~F.col("email_proof").rlike(_HASH), F.lit(False)), "email_proof"),
            F.when(F.coalesce(F.length("os") > 200, F.lit(True)), "os"),
            F.when(F.size("cc_versions") > 50, "cc_versions"),
            F.when(F.coalesce(F.col("malformed_lines") < 0, F.lit(True)), "malformed_lines"),
            F.when(F.col("n_records") > MAX_RECORDS_PER_BATCH, "records"),
        )
    )
    return batches.withColumn("reason", F.when(F.size(failed) > 0, F.array_join(failed, "; ")))
