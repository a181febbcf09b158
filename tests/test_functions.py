import hashlib
import hmac
import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from meterloom.functions import hashing, ordered, quantiles, ranges, text


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# ---- hashing ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("key", ["salt", "k" * 64, "long key " * 20, "ключ"])
def test_hmac_matches_the_standard_library(spark, key):
    want = hmac.new(key.encode(), b"account:acct-1", hashlib.sha256).hexdigest()
    assert one(spark, hashing.hmac_sha256(key, F.lit("account:acct-1"))) == want
    df = spark.createDataFrame([(key,)], "key string")
    inner, outer = hashing.hmac_pads(F.col("key"))
    padded = df.select(inner.alias("i"), outer.alias("o"))
    got = padded.select(hashing.hmac_with_pads(F.col("i"), F.col("o"), F.lit("account:acct-1"))).first()[0]
    assert got == want


def test_email_proof_ignores_case_and_blanks(spark):
    want = hashlib.sha256(b"p:test@example.com").hexdigest()
    assert one(spark, hashing.email_proof("p:", F.lit("  TEST@example.com "))) == want


@pytest.mark.parametrize(
    "cwd, name", [("/a/b/harness-api", "harness-api"), ("/a/b/c///", "c"), ("C:\\x\\y\\", "y"), ("/", None), (None, None)]
)
def test_project_name(spark, cwd, name):
    assert one(spark, hashing.project_name(F.lit(cwd).cast("string"))) == name


def test_hashed_project(spark):
    got = one(spark, hashing.project_name(F.lit("/a/proj"), "salt"))
    want = hmac.new(b"salt", b"project:proj", hashlib.sha256).hexdigest()[:12]
    assert got == f"h:{want}"


# ---- ranges ----------------------------------------------------------------------------------------


def cycle_by_days(now, day):
    """Walk back from today to the day of the month on which a cycle begins."""
    at = now.replace(hour=0, minute=0, second=0, microsecond=0)
    while at.day != min(day, 28):
        at -= timedelta(days=1)
    return at


def test_cycle_start_is_the_last_billing_day(spark):
    rng = random.Random(51)
    cases = [(datetime(2023, 1, 1) + timedelta(minutes=rng.randrange(3 * 525_600)), rng.randrange(1, 32)) for _ in range(120)]
    cases += [(datetime(2024, 2, 29, 12), 29), (datetime(2024, 3, 1), 28), (datetime(2025, 5, 14), 14), (datetime(2025, 1, 3), 20)]
    df = spark.createDataFrame(cases, "now timestamp, day int").withColumn("start", ranges.cycle_start_col(F.col("now"), F.col("day")))
    for (now, day), start in zip(cases, [r.start for r in df.collect()], strict=True):
        assert ranges.cycle_start(now, day) == start == cycle_by_days(now, day)


@pytest.mark.parametrize("name, length", [("24h", 1), ("7d", 7), ("30d", 30), ("all", 60), ("never heard of", 30), (None, 30)])
def test_named_ranges_of_days(name, length):
    now = datetime(2024, 7, 19, 13, 45)
    span = ranges.resolve_range(name, 4, now)
    assert span.end == span.start + timedelta(days=length) == now
    assert span.prev_end == span.start and span.prev_start == span.start - timedelta(days=length)


@pytest.mark.parametrize("name, day", [("mtd", 1), ("cycle", 23)])
def test_named_ranges_of_the_calendar(name, day):
    now = datetime(2024, 7, 19, 13, 45)
    span = ranges.resolve_range(name, day, now)
    assert span.start == cycle_by_days(now, day) and span.start - span.prev_start == span.end - span.start


def test_local_day_across_a_clock_change(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 10, 4, 30),), (datetime(2024, 3, 11, 3, 59),)], "ts timestamp")
    got = [r[0] for r in rows(df.select(ranges.local_day(F.col("ts"), "America/New_York")))]
    assert got == ["2024-03-09", "2024-03-10"]


# ---- text ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("answer", ["reason", "status"])
def test_what_a_message_says_decides_before_its_rank(spark, answer):
    """Classes in the order in which they are looked for: a message that names two belongs to the earlier one."""
    signs = [("prompt_too_long", "we saw: prompt is too long; cut it"), ("auth", "please authenticate first"), ("overloaded", "model overloaded, wait"), ("rate_limit", "hit the rate limit, code 429")]
    classify = text.classify_reason if answer == "reason" else text.classify_status
    code = F.lit("unclear") if answer == "reason" else F.lit("418")
    single = {want: one(spark, classify(code, F.lit(message))) for want, message in signs}
    assert {k: v for k, v in single.items() if v != "other"}.items() <= {k: k for k, _ in signs}.items() and single["prompt_too_long"] == "prompt_too_long"
    for i, (want, message) in enumerate(signs):
        for _, other in signs[i + 1 :]:
            if single[want] == want:
                assert one(spark, classify(code, F.lit(f"{other} / {message}"))) == want
    assert one(spark, classify(code, F.lit("nothing of the sort"))) == "other"


@pytest.mark.parametrize("code, want", [("AUTH_EXPIRED", "auth"), ("my_overload_signal", "overloaded"), ("api_rate_limit", "rate_limit"), ("unheard of", "other")])
def test_codes_of_session_files(spark, code, want):
    assert one(spark, text.classify_reason(F.lit(code), F.lit("-"))) == want


@pytest.mark.parametrize("status, want", [("403", "auth"), ("529", "overloaded"), ("429", "rate_limit"), ("418", "other"), (None, "network")])
def test_status_numbers_of_telemetry(spark, status, want):
    assert one(spark, text.classify_status(F.lit(status).cast("string"), F.lit(""))) == want


def test_limit_kinds(spark):
    """Only limit messages have a kind; the week counts before the five hours."""
    said = {"your {} limit exceeded": True, "{} limit reached again": True, "no word on {}": False}
    spans = {"weekly": "weekly", "5-hour": "five_hour", "five hour": "five_hour", "weekly 5-hour": "weekly", "daily": "unknown"}
    for frame, is_limit in said.items():
        for span, kind in spans.items():
            message = F.lit(frame.format(span))
            assert one(spark, text.limit_kind(message)) == (kind if is_limit else None), (frame, span)


def test_reset_times_are_the_next_on_the_clock(spark):
    rng = random.Random(61)
    cases = []
    for _ in range(60):
        zone = rng.choice(["UTC", "Asia/Kolkata", "America/Sao_Paulo", "Europe/Paris"])
        now = datetime(2025, 6, 1) + timedelta(minutes=rng.randrange(60 * 24 * 60))
        hour, minute, half = rng.randrange(0, 24), rng.choice([None, 0, 7, 59]), rng.choice(["am", "pm", ""])
        shown = hour if not half else rng.randrange(1, 13)
        message = f"pause; resets {rng.choice(['', 'at '])}{shown}" + ("" if minute is None else f":{minute:02d}") + rng.choice(["", " "]) * bool(half) + half.upper()
        wanted = shown if not half else shown % 12 + 12 * (half == "pm")
        local = now.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone))
        at = local.replace(hour=wanted, minute=minute or 0, second=0, microsecond=0)
        at = at if at > local else at + timedelta(days=1)
        cases.append((message, zone, now, at.astimezone(ZoneInfo("UTC")).replace(tzinfo=None)))
    for zone in {z for _, z, *_ in cases}:
        mine = [c for c in cases if c[1] == zone]
        df = spark.createDataFrame(mine, "message string, zone string, now timestamp, want timestamp")
        for r in df.withColumn("got", text.resets_at(F.col("message"), F.col("now"), zone)).collect():
            assert r.got == r.want, r
    now = ranges.as_ts(datetime(2025, 6, 1))
    assert one(spark, text.resets_at(F.lit("stopped|1750000007 for now"), now)) == datetime.fromtimestamp(1_750_000_007, ZoneInfo("UTC")).replace(tzinfo=None)
    assert [one(spark, text.resets_at(F.lit(m), now)) for m in ("resets 24", "resets 7:60", "no reset")] == [None, None, None]


def test_csv_cell(spark):
    assert one(spark, text.csv_cell(F.lit("=SUM(A1)"))) == "'=SUM(A1)"
    assert one(spark, text.csv_cell(F.lit("plain"))) == "plain"


# ---- quantiles and ordered scans -------------------------------------------------------------------


def test_quantiles_match_numpy_with_a_hot_group(spark):
    rng = random.Random(7)
    data = {
        "hot": [0.0] * 3000 + [rng.lognormvariate(0, 3) for _ in range(2000)],
        "negative": [rng.uniform(-5, 5) for _ in range(501)],
        "packed": [1.0 + i * 1e-12 for i in range(700)] + [1.001] * 5,
        "one": [4.25],
        "two": [1.0, 2.0],
        "tiny": [rng.uniform(0, 1e-12) for _ in range(40)],
    }
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("one", None)], "k string, v double")
    got = quantiles.exact_quantiles(df, ["k"], "v", {"median": 0.5, "p95": 0.95, "top": 1.0, "low": 0.0})
    found = {r["k"]: r for r in got.collect()}
    assert set(found) == set(data)
    for k, vs in data.items():
        assert found[k]["n"] == len(vs)
        for name, q in (("median", 0.5), ("p95", 0.95), ("top", 1.0), ("low", 0.0)):
            assert found[k][name] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-15)


def test_running_totals_match_a_plain_scan(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    data = [
        (rng.choice(["a", "a", "a", "b"]), start + timedelta(seconds=rng.randrange(20_000)), i, rng.randrange(5))
        for i in range(600)
    ]
    df = spark.createDataFrame(data, "k string, ts timestamp, id int, x int")
    got = ordered.running_totals(df, ["k"], "ts", ["id"], {"n": F.lit(1), "total": F.col("x")}, slice_seconds=600)
    want = {}
    for k in ("a", "b"):
        n = total = 0
        for _, ts, i, x in sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2])):
            n, total = n + 1, total + x
            want[i] = (n, total)
    assert {r["id"]: (r["n"], r["total"]) for r in got.collect()} == want


def test_hot_keys_finds_heavy_hitters(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    hot = ordered.hot_keys(df, ["k"], 5_000)
    want = one(spark, F.xxhash64(F.lit(1).cast("long")))
    assert rows(hot) == [(want,)]
