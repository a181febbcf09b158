"""Upload gates and bookkeeping: account pin, e-mail check, refusals, heartbeat, upload log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import email_proof
from .rollups import WS, top_n

EMAIL_PREFIX = "account-email:"


def account_gate(uploads: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Verdict per upload: the first account a workspace sees is pinned, any other is a mismatch.

    The pin is an aggregate (the account of the smallest ``seq``) joined back, so a busy workspace is never
    sorted in one task.
    """
    pins = uploads.groupBy(WS).agg(
        F.min("seq").alias("_pin_seq"), F.min_by("account_hash", "seq").alias("_first_hash")
    )
    stored = workspaces.select(F.col("id").alias(WS), F.col("account_hash").alias("_stored"))
    joined = uploads.join(pins.join(stored, WS, "left"), WS)
    pinned = F.coalesce("_stored", "_first_hash")
    verdict = (
        F.when(F.col("_stored").isNull() & (F.col("seq") == F.col("_pin_seq")), "pinned")
        .when(F.col("account_hash") == pinned, "ok")
        .otherwise("mismatch")
    )
    return joined.select(*uploads.columns, verdict.alias("verdict"))


def pinned_accounts(uploads: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Workspaces after the pin: account hash and detected tier of the first upload where none was stored."""
    first = uploads.groupBy(WS).agg(
        F.min_by(F.struct("account_hash", "tier"), "seq").alias("_f")
    ).select(F.col(WS).alias("id"), F.col("_f.account_hash").alias("_hash"), F.col("_f.tier").alias("_tier"))
    joined = workspaces.join(first, "id", "left")
    fresh = F.col("account_hash").isNull()
    return joined.withColumn("detected_tier", F.when(fresh, F.col("_tier")).otherwise(F.col("detected_tier"))).withColumn(
        "account_hash", F.coalesce("account_hash", "_hash")
    ).select(*workspaces.columns)


def allowed_proofs(
    workspaces: DataFrame, memberships: DataFrame, users: DataFrame, prefix: str = EMAIL_PREFIX
) -> DataFrame:
    """Proofs accepted per workspace: its owners' addresses plus the extra list."""
    owners = (
        memberships.filter(F.col("role") == "owner")
        .join(users.select(F.col("id").alias("user_id"), "email"), "user_id")
        .select(WS, "email")
    )
    extra = workspaces.select(F.col("id").alias(WS), F.explode("extra_emails").alias("email"))
    return owners.unionByName(extra).select(WS, email_proof(prefix, F.col("email")).alias("proof")).distinct()


def email_gate(uploads: DataFrame, workspaces: DataFrame, allowed: DataFrame) -> DataFrame:
    """Verdict per upload. ``proofs`` is the upload's array of e-mail proofs.

    ``ok`` when the workspace does not check or every proof is allowed, ``missing`` without any proof,
    ``mismatch`` otherwise.
    """
    checks = workspaces.select(F.col("id").alias(WS), F.col("require_email_match").alias("_check"))
    proofs = uploads.select(WS, "upload_id", F.explode("proofs").alias("proof"))
    refused = proofs.join(allowed, [WS, "proof"], "left_anti").select(WS, "upload_id").distinct()
    joined = uploads.join(checks, WS).join(refused.withColumn("_bad", F.lit(True)), [WS, "upload_id"], "left")
    verdict = (
        F.when(~F.col("_check"), "ok")
        .when(F.coalesce(F.size("proofs"), F.lit(0)) <= 0, "missing")
        .when(F.col("_bad"), "mismatch")
        .otherwise("ok")
    )
    return joined.select(*uploads.columns, verdict.alias("verdict"))


def refusals(verdicts: DataFrame, devices: DataFrame) -> DataFrame:
    """Per-device refusal counters after adding the refused uploads (``verdict`` = mismatch)."""
    bad = verdicts.filter(F.col("verdict") == "mismatch")
    new = bad.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("ts").alias("_at"),
        F.max_by("reason", F.struct("ts", "upload_id")).alias("_why"),
    ).withColumnRenamed("device_id", "id")
    joined = devices.join(new, "id", "left")
    later = F.col("_at").isNotNull()
    return joined.select(
        "id", WS,
        (F.coalesce("refused_uploads", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("refused_uploads"),
        F.when(later, F.col("_at")).otherwise(F.col("last_refused_at")).alias("last_refused_at"),
        F.when(later, F.col("_why")).otherwise(F.col("last_refused_reason")).alias("last_refused_reason"),
    )


def recently_refused(now: Column, days: int = 7) -> Column:
    """Device flag: an upload was refused in the last week."""
    age = F.unix_micros(now) - F.unix_micros("last_refused_at")
    return F.coalesce(age < days * 86_400_000_000, F.lit(False))


def heartbeat(uploads: DataFrame, devices: DataFrame) -> DataFrame:
    """Device state after uploads: last seen, parser version, OS, and the last ten versions by name."""
    seen = uploads.groupBy(F.col("device_id").alias("id")).agg(
        F.max("ts").alias("_seen"),
        F.max_by("parser_version", F.when(F.col("parser_version").isNotNull(), F.struct("ts", "upload_id"))).alias("_p"),
        F.max_by("os", F.when(F.col("os").isNotNull(), F.struct("ts", "upload_id"))).alias("_os"),
    )
    named = (
        uploads.select(F.col("device_id").alias("id"), F.explode("cc_versions").alias("v"))
        .union(devices.select("id", F.explode("cc_versions").alias("v")))
        .distinct()
    )
    versions = top_n(named, [F.desc("v")], 10, ("id",)).groupBy("id").agg(
        F.array_sort(F.collect_list("v")).alias("_last_ten")
    )
    return devices.join(seen, "id", "left").join(versions, "id", "left").select(
        "id", WS,
        F.coalesce("_seen", "last_seen_at").alias("last_seen_at"),
        F.coalesce("_p", "parser_version").alias("parser_version"),
        F.coalesce("_os", "os").alias("os"),
        F.when(F.col("_seen").isNotNull(), F.coalesce("_last_ten", F.array().cast("array<string>")))
        .otherwise(F.col("cc_versions"))
        .alias("cc_versions"),
    )


def upload_log(counts: DataFrame, uploads: DataFrame) -> DataFrame:
    """Log rows: one per upload with its record counts, parser version and unknown record types."""
    header = uploads.select(
        "upload_id", WS, "device_id", "source", F.col("ts").alias("received_at"), "parser_version",
        F.when(F.size("unknown_types") > 0, F.col("unknown_types")).alias("unknown_types"), "malformed_lines",
    )
    return header.join(counts, "upload_id").select(
        WS, "device_id", "source", "received_at", "records", "accepted", "deduplicated", "parser_version",
        "unknown_types", F.coalesce("malformed_lines", F.lit(0)).alias("malformed_lines"),
    )


def fill_missing_proofs(queued: DataFrame, proofs: DataFrame) -> DataFrame:
    """Give queued batches without an e-mail proof the proof of the same account, if there is one."""
    known = proofs.select("account_hash", F.col("email_proof").alias("_proof"))
    joined = queued.join(known, "account_hash", "left")
    return joined.withColumn("email_proof", F.coalesce("email_proof", "_proof")).select(*queued.columns)
