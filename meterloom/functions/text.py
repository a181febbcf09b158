"""Classifiers and small text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What error and limit messages look like. Order matters, the first match decides.
_TOO_LONG = r"(?i)prompt is too long|context.{0,20}(too long|exceed)"
_AUTH = r"(?i)/login|log ?in|authenticat|oauth|token (expired|revoked)"
_OVERLOADED = r"(?i)overloaded|\b529\b"
_RATE_LIMIT = r"(?i)rate.?limit|\b429\b"
_NETWORK = (
    r"(?i)socket|network|ECONN|ETIMEDOUT|ENOTFOUND|fetch failed|timed? ?out|closed unexpectedly|connection"
)
_AUTH_STATUS = r"(?i)auth|login|oauth"
_OVERLOADED_STATUS = r"(?i)overloaded"
_RATE_STATUS = r"(?i)rate.?limit"
_NETWORK_STATUS = r"(?i)socket|network|ECONN|timed? ?out|fetch failed|connection"
_LIMIT = (
    r"(?i)(usage|session|weekly|5[- ]hour|five[- ]hour|opus)\s+limit|limit\s+(reached|hit|exceeded)"
    r"|hit your limit|out of (extra )?usage|claude ai usage limit"
)
_WEEKLY = r"(?i)week"
_FIVE_HOUR = r"(?i)5[- ]hour|five[- ]hour|session limit|claude ai usage limit"
_RESET_EPOCH = r"\|(\d{10})\b"
_RESET_CLOCK = r"(?i)resets?\s+(?:at\s+)?(\d{1,2})(?::(\d{2}))?\s*(am|pm)?"
_FORMULA_START = r"^([=+\-@\t\r])"


def classify_reason(code: Column, text: Column) -> Column:
    """Reason class of an error found in a session file."""
    c = F.lower(F.coalesce(code, F.lit("")))
    return (
        F.when(text.rlike(_TOO_LONG), "prompt_too_long")
        .when(c.contains("auth") | text.rlike(_AUTH), "auth")
        .when(c.contains("overload") | text.rlike(_OVERLOADED), "overloaded")
        .when(c.contains("rate_limit") | text.rlike(_RATE_LIMIT), "rate_limit")
        .when(text.rlike(_NETWORK), "network")
        .otherwise("other")
    )


def classify_status(status: Column, text: Column) -> Column:
    """Reason class of a telemetry error; a missing status means the request never got an answer."""
    s = F.coalesce(status, F.lit(""))
    return (
        F.when(text.rlike(_TOO_LONG), "prompt_too_long")
        .when(s.isin("401", "403") | text.rlike(_AUTH_STATUS), "auth")
        .when((s == "529") | text.rlike(_OVERLOADED_STATUS), "overloaded")
        .when((s == "429") | text.rlike(_RATE_STATUS), "rate_limit")
        .when((s == "") | text.rlike(_NETWORK_STATUS), "network")
        .otherwise("other")
    )


def is_limit(text: Column) -> Column:
    return text.rlike(_LIMIT)


def limit_kind(text: Column) -> Column:
    """Kind of a usage-limit message, null for other messages."""
    kind = F.when(text.rlike(_WEEKLY), "weekly").when(text.rlike(_FIVE_HOUR), "five_hour").otherwise("unknown")
    return F.when(is_limit(text), kind)


def resets_at(text: Column, ts: Column, zone: str = "UTC") -> Column:
    """When a limit resets: an epoch after a bar, or the next occurrence of a wall-clock time in ``zone``."""
    epoch = F.nullif(F.regexp_extract(text, _RESET_EPOCH, 1), F.lit(""))
    hour_text = F.nullif(F.regexp_extract(text, _RESET_CLOCK, 1), F.lit(""))
    minute_text = F.nullif(F.regexp_extract(text, _RESET_CLOCK, 2), F.lit(""))
    half = F.lower(F.regexp_extract(text, _RESET_CLOCK, 3))
    raw = hour_text.cast("int")
    hour = F.when((half == "pm") & (raw < 12), raw + 12).when((half == "am") & (raw == 12), 0).otherwise(raw)
    minute = F.coalesce(minute_text.cast("int"), F.lit(0))
    local = F.from_utc_timestamp(ts, zone)
    # Wall-clock arithmetic happens before going back to UTC, so a day with a clock change stays right.
    at = F.date_trunc("DAY", local) + F.make_dt_interval(F.lit(0), hour, minute)
    later = at + F.expr("interval 1 day")
    first = F.to_utc_timestamp(at, zone)
    clock = F.when((hour <= 23) & (minute <= 59), F.when(first > ts, first).otherwise(F.to_utc_timestamp(later, zone)))
    return F.coalesce(F.timestamp_seconds(epoch.cast("long")), clock)


def csv_cell(value: Column) -> Column:
    """Neutralise spreadsheet formulas in an exported cell."""
    return F.regexp_replace(value.cast("string"), _FORMULA_START, "'$1")


def contains_ci(column: Column, needle: str) -> Column:
    """Case-insensitive search; ``%`` and ``_`` typed by the user keep their wildcard meaning."""
    return column.ilike(f"%{needle}%")
