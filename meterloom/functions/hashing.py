"""Pseudonyms: SHA-256 proofs and HMAC-SHA-256 built from Catalyst expressions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(key: str) -> tuple[bytearray, bytearray]:
    raw = key.encode()
    if len(raw) > _BLOCK:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(_BLOCK, b"\0")
    return bytearray(b ^ 0x36 for b in raw), bytearray(b ^ 0x5C for b in raw)


def _nested(inner: Column, outer: Column, message: Column) -> Column:
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC-SHA-256 under one literal key."""
    inner, outer = _pads(key)
    return _nested(F.lit(inner), F.lit(outer), message)


def hmac_pads(key: Column) -> tuple[Column, Column]:
    """Inner and outer pad of a key column.

    Compute these once on the small table that holds the keys (one row per workspace), then join them to
    the rows to be hashed.
    """
    raw = key.cast("binary")
    raw = F.when(F.octet_length(raw) > _BLOCK, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    digits = F.rpad(F.hex(raw), 2 * _BLOCK, "0")

    def pad(mask: int) -> Column:
        octets = F.transform(
            F.sequence(F.lit(0), F.lit(_BLOCK - 1)),
            lambda i: F.lpad(
                F.hex(F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(mask))),
                2, "0",
            ),
        )
        return F.unhex(F.array_join(octets, ""))

    return pad(0x36), pad(0x5C)


def hmac_with_pads(inner: Column, outer: Column, message: Column) -> Column:
    return _nested(inner, outer, message)


def account_message(account: Column) -> Column:
    return F.concat(F.lit("account:"), account)


def email_proof(prefix: str, email: Column) -> Column:
    """One-way proof of an e-mail address; ``prefix`` is the deployment's own domain separator."""
    return F.sha2(F.concat(F.lit(prefix), F.lower(F.trim(email))).cast("binary"), 256)


def line_id(key: str, session: Column, uuid: Column, fallback: Column) -> Column:
    """Stable opaque id of a session line: 32 hex digits."""
    return F.substring(hmac_sha256(key, F.concat(session, F.lit(":"), F.coalesce(uuid, fallback))), 1, 32)


def project_name(cwd: Column, hash_salt: str | None = None) -> Column:
    """Last path component of the working directory, or its salted hash when a salt is given."""
    base = F.nullif(F.regexp_extract(F.regexp_replace(cwd, r"[\\/]+$", ""), r"([^/\\]*)$", 1), F.lit(""))
    if hash_salt is not None:
        digest = hmac_sha256(hash_salt, F.concat(F.lit("project:"), base))
        base = F.concat(F.lit("h:"), F.substring(digest, 1, 12))
    return F.substring(base, 1, 200)
