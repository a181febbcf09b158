"""Five-hour usage blocks, the learned ceiling and the live block.

A block opens at the hour of the first activity after the previous block ended and lasts five hours. Starts
and ends are whole hours, so which block an event belongs to depends only on the set of active hours. All
heavy work therefore happens once, when requests collapse to (workspace, hour); after that a workspace has at
most 24 rows per day, however many requests it sent.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pricing import PRICE_BOOK, model_family, with_prices
from ..functions.ranges import as_ts, hour_of, hour_start, in_range
from ..schemas import RETENTION_DAYS
from ..session import shared_dir
from .rollups import WS

BLOCK_HOURS = 5


def hourly_points(requests: DataFrame, limits: DataFrame, book=PRICE_BOOK) -> DataFrame:
    """Requests and limit hits summed per workspace and hour.

    ``value_to_limit`` is the hour's value up to its first limit hit (requests at the same instant count). A
    block is made of whole hours, so the first hit of a block is the first hit of its first limited hour.
    """
    hits = (
        limits.withColumn("hour", hour_of(F.col("ts")))
        .groupBy(WS, "hour")
        .agg(
            F.min("ts").alias("first_limit_ts"),
            F.count(F.lit(1)).alias("limits"),
            F.count_if(F.col("limit_kind") != "weekly").alias("block_limits"),
            F.max("ts").alias("last_limit_ts"),
            F.max(F.struct("ts", "id", "limit_kind")).alias("last_limit"),
        )
    )
    points = requests.select(WS, "ts", "model", "value_usd", hour_of(F.col("ts")).alias("hour"))
    with_hits = points.join(hits.select(WS, "hour", "first_limit_ts"), [WS, "hour"], "left")
    per_model = with_hits.groupBy(WS, "hour", "model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("value_usd").alias("value"),
        F.sum(F.when(F.col("ts") <= F.col("first_limit_ts"), F.col("value_usd")).otherwise(0.0)).alias(
            "value_to_limit"
        ),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    used = with_prices(per_model, book).groupBy(WS, "hour").agg(
        F.sum("requests").alias("requests"),
        F.sum("value").alias("value"),
        F.sum(F.when(model_family() == "opus", F.col("value")).otherwise(0.0)).alias("opus_value"),
        F.sum("value_to_limit").alias("value_to_limit"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    both = used.join(hits, [WS, "hour"], "full")
    zero = F.lit(0.0)
    return both.select(
        WS, "hour",
        F.coalesce("requests", F.lit(0)).alias("requests"),
        F.coalesce("value", zero).alias("value"),
        F.coalesce("opus_value", zero).alias("opus_value"),
        F.coalesce("value_to_limit", zero).alias("value_to_limit"),
        F.least("first_ts", "first_limit_ts").alias("first_ts"),
        F.greatest("last_ts", "last_limit_ts").alias("last_ts"),
        F.coalesce("limits", F.lit(0)).alias("limits"),
        F.coalesce("block_limits", F.lit(0)).alias("block_limits"),
        F.col("first_limit_ts"),
        F.col("last_limit"),
    )


def compact_points(requests: DataFrame, limits: DataFrame, now: datetime, recent_hours: int = 12) -> DataFrame:
    """Points for a client that rebuilds blocks itself: old hours without a limit hit are one row per model,
    recent hours and hours holding a hit stay one row per request. Totals per hour are unchanged."""
    cut = (now - timedelta(hours=recent_hours)).replace(minute=0, second=0, microsecond=0)
    points = requests.select(
        WS, "ts", hour_of(F.col("ts")).alias("hour"), "model", F.col("value_usd").alias("value")
    )
    hit_hours = limits.select(WS, hour_of(F.col("ts")).alias("hour")).distinct()
    recent = F.col("ts") >= as_ts(cut)
    quiet = points.filter(~recent).join(hit_hours, [WS, "hour"], "left_anti")
    summed = quiet.groupBy(WS, "hour", "model").agg(
        hour_start(F.col("hour")).alias("ts"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")
    )
    exact = points.filter(recent).unionByName(points.filter(~recent).join(hit_hours, [WS, "hour"], "left_semi").select(*points.columns))
    return summed.unionByName(exact.withColumn("n", F.lit(1).cast("long")))


_POINT = (
    "hour", "requests", "value", "opus_value", "value_to_limit", "first_ts", "last_ts", "limits", "block_limits",
    "first_limit_ts", "last_limit",
)


def _block_positions(hours: Column) -> Column:
    """Indexes (from 1) in the sorted hour array at which a block opens."""
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit(None).cast("bigint").alias("open"),
        F.array().cast("array<int>").alias("at"),
    )

    def step(acc: Column, h: Column) -> Column:
        opens = acc["open"].isNull() | (h["hour"] >= acc["open"] + BLOCK_HOURS)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(opens, h["hour"]).otherwise(acc["open"]).alias("open"),
            F.when(opens, F.concat(acc["at"], F.array(acc["i"] + 1))).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(hours, start, step, lambda acc: acc["at"])


def blocks_from_points(points: DataFrame) -> DataFrame:
    """Blocks from hourly points: one shuffle by workspace, no join.

    The hours of a workspace form an array bounded by the calendar. A fold finds where blocks open; a block
    is then the slice of at most five entries that starts there.
    """
    hours = points.groupBy(WS).agg(F.array_sort(F.collect_list(F.struct(*_POINT))).alias("hours"))
    opened = hours.select(WS, "hours", F.explode(_block_positions(F.col("hours"))).alias("at"))
    start_hour = F.element_at("hours", F.col("at"))["hour"]
    block = opened.select(WS, start_hour.alias("start_hour"), F.slice("hours", F.col("at"), BLOCK_HOURS).alias("h"))
    block = block.withColumn("h", F.filter("h", lambda x: x["hour"] < F.col("start_hour") + BLOCK_HOURS))

    def total(field: str, zero: int | float) -> Column:
        kind = "long" if isinstance(zero, int) else "double"
        return F.aggregate("h", F.lit(zero).cast(kind), lambda acc, x: acc + x[field])

    def each(field: str) -> Column:
        return F.transform("h", lambda x: x[field])

    limit_hour = F.array_min(F.transform("h", lambda x: F.when(x["limits"] > 0, x["hour"])))
    reached = F.aggregate(
        "h",
        F.lit(0.0),
        lambda acc, x: acc
        + F.when(x["hour"] < F.col("limit_hour"), x["value"])
        .when(x["hour"] == F.col("limit_hour"), x["value_to_limit"])
        .otherwise(0.0),
    )
    return block.withColumn("limit_hour", limit_hour).select(
        WS,
        hour_start(F.col("start_hour")).alias("block_start"),
        hour_start(F.col("start_hour") + BLOCK_HOURS).alias("block_end"),
        F.array_min(each("first_ts")).alias("first_ts"),
        F.array_max(each("last_ts")).alias("last_ts"),
        total("requests", 0).alias("requests"),
        total("value", 0.0).alias("value"),
        total("opus_value", 0.0).alias("opus_value"),
        total("limits", 0).alias("limits"),
        total("block_limits", 0).alias("block_limits"),
        F.array_min(each("first_limit_ts")).alias("first_limit_ts"),
        F.array_max(each("last_limit")).alias("last_limit"),
        F.when(F.col("limit_hour").isNotNull(), reached).alias("value_at_limit"),
    )


def build_blocks(requests: DataFrame, limits: DataFrame, book=PRICE_BOOK) -> DataFrame:
    return blocks_from_points(hourly_points(requests, limits, book))


def blocks_between(requests, limits, start: datetime, end: datetime, book=PRICE_BOOK) -> DataFrame:
    """Blocks that end after ``start``. Reading begins five hours earlier, and the chain of blocks starts at
    the first event read, so different windows may draw different borders."""
    seed = start - timedelta(hours=BLOCK_HOURS)
    found = build_blocks(requests.filter(in_range(seed, end)), limits.filter(in_range(seed, end)), book)
    return found.filter(F.col("block_end") > as_ts(start))


_US = 1_000_000
_BIN_US = 60 * _US
_BLOCK_US = BLOCK_HOURS * 3600 * _US


def next_starts(instants: DataFrame) -> DataFrame:
    """For each instant (workspace, us) the first instant at least five hours later: the block that follows one opened here.

    Instants fall into bins of a minute. The answer is in the bin five hours on, found by one ordered scan of each bin, or
    else it is the least instant of the next bin that has any; a workspace has at most 1,440 of these a day.
    """
    bin_of = lambda c: F.floor(c / _BIN_US).cast("long")
    found = instants.select(WS, F.col("us").alias("at"), F.lit(None).cast("long").alias("us"))
    probes = instants.select(WS, (F.col("us") + _BLOCK_US).alias("at"), "us")
    # From late to early; of equal instants the found ones come first, as a probe may meet its own instant.
    back = W.partitionBy(WS, "bin").orderBy(F.desc("at"), F.asc_nulls_first("us")).rowsBetween(W.unboundedPreceding, W.currentRow)
    scanned = found.unionByName(probes).withColumn("bin", bin_of(F.col("at")))
    within = scanned.withColumn("same", F.last(F.when(F.col("us").isNull(), F.col("at")), True).over(back)).filter("us is not null")
    firsts = instants.groupBy(WS, bin_of(F.col("us")).alias("bin")).agg(F.min("us").alias("first"))
    asked = within.select(WS, "bin").distinct().withColumn("first", F.lit(None).cast("long"))
    # Bins strictly later than the one asked for: its own row, if it has one, does not count.
    after = W.partitionBy(WS).orderBy(F.desc("bin")).rangeBetween(W.unboundedPreceding, -1)
    later = firsts.unionByName(asked).withColumn("later", F.last("first", True).over(after)).filter("first is null").select(WS, "bin", "later")
    return within.join(later, [WS, "bin"]).select(WS, "us", F.coalesce("same", "later").alias("next"))


def chain_starts(instants: DataFrame, firsts: DataFrame, rounds: int, folder: str) -> DataFrame:
    """Instants reached from the first of their workspace by following ``next``: the starts of its blocks.

    Pointer doubling: round r knows the jumps over 2 ** r blocks, so log2 of the number of blocks rounds reach all, each a
    join, whatever the number of workspaces. Tables of a round are written, which cuts the lineage.
    """
    spark = instants.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    links = kept(next_starts(instants).filter("next is not null"), "links")
    # No chain passes through an instant that nothing leads to.
    led = links.select(WS, F.col("next").alias("us")).union(firsts).distinct()
    jumps = kept(links.join(led, [WS, "us"], "left_semi"), "jump-0")
    reached = firsts
    for r in range(rounds):
        reached = kept(reached.union(reached.join(jumps, [WS, "us"]).select(WS, "next")), f"reached-{r}")
        further = jumps.select(WS, F.col("us").alias("next"), F.col("next").alias("beyond"))
        jumps = kept(jumps.join(further, [WS, "next"]).select(WS, "us", F.col("beyond").alias("next")), f"jump-{r + 1}")
        if jumps.isEmpty():
            break
    return reached


def exact_start_blocks(
    requests: DataFrame, limits: DataFrame, start: datetime, end: datetime, folder: str | None = None
) -> DataFrame:
    """Variant whose blocks start at the first event itself instead of the full hour.

    Borders now hang on single events. Each distinct instant points to the one at which the next block would open; the
    starts are those on the way from the first instant of the workspace, found by pointer doubling.
    """
    spark = requests.sparkSession
    folder = folder or shared_dir(spark, "block-starts")
    events = requests.select(WS, "ts").unionByName(limits.select(WS, "ts")).filter(in_range(start, end))
    instants = events.select(WS, F.unix_micros("ts").alias("us")).distinct()
    instants.write.mode("overwrite").parquet(f"{folder}/instants")
    instants = spark.read.schema(instants.schema).parquet(f"{folder}/instants")
    firsts = instants.groupBy(WS).agg(F.min("us").alias("us"))
    most = max(int((end - start).total_seconds() * _US // _BLOCK_US), 1) + 1
    found = chain_starts(instants, firsts, most.bit_length(), folder)
    offset = (F.col("us") - F.unix_micros(as_ts(start))) / _BLOCK_US
    # Starts are five hours apart, so a slice of five hours holds at most one of a workspace.
    starts = found.select(WS, F.timestamp_micros("us").alias("start_ts"), F.floor(offset).cast("int").alias("slice"))
    own = starts.withColumnRenamed("start_ts", "own")
    earlier = starts.select(WS, (F.col("slice") + 1).alias("slice"), F.col("start_ts").alias("earlier"))
    offset = (F.unix_micros("ts") - F.unix_micros(as_ts(start))) / (BLOCK_HOURS * 3_600_000_000)
    slice_no = F.floor(offset).cast("int").alias("slice")
    points = requests.filter(in_range(start, end)).select(WS, "ts", slice_no, "value_usd", F.lit(0).alias("limit"))
    marks = limits.filter(in_range(start, end)).select(
        WS, "ts", slice_no, F.lit(0.0).alias("value_usd"), F.lit(1).alias("limit")
    )
    placed = points.unionByName(marks).join(own, [WS, "slice"], "left").join(earlier, [WS, "slice"], "left")
    block_start = F.when(F.col("ts") >= F.col("own"), F.col("own")).otherwise(F.col("earlier"))
    return placed.groupBy(WS, block_start.alias("block_start")).agg(
        F.count_if(F.col("limit") == 0).alias("requests"),
        F.sum("value_usd").alias("value"),
        F.sum("limit").alias("limits"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def learn_ceiling(blocks: DataFrame, min_value: float = 1.0) -> DataFrame:
    """Median and 10th percentile of the value at which a five-hour limit was hit.

    A workspace has at most five blocks a day, so these groups stay small.
    """
    usable = blocks.filter((F.col("value_at_limit") >= min_value) & (F.col("block_limits") > 0))
    q = F.percentile("value_at_limit", F.array(F.lit(0.5), F.lit(0.1)))
    return usable.groupBy(WS).agg(q.alias("_q"), F.count(F.lit(1)).alias("samples")).select(
        WS, F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p10"), "samples"
    )


def ceiling_key(limits: DataFrame, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Changes whenever the set of limit hits changes: number of kept hits and the newest hit."""
    kept = F.col("ts") >= as_ts(now - timedelta(days=days))
    n = limits.groupBy(WS).agg(F.count_if(kept).alias("n"), F.max("ts").alias("last"))
    return n.filter(F.col("n") > 0).select(
        WS, F.concat_ws(":", F.col("n").cast("string"), F.unix_micros(F.col("last")).cast("string")).alias("key")
    )


def learned_ceiling(requests, limits, now: datetime, days: int = RETENTION_DAYS, book=PRICE_BOOK) -> DataFrame:
    """Ceiling over everything kept; workspaces without a limit hit have no row."""
    start = now - timedelta(days=days)
    blocks = build_blocks(requests.filter(in_range(start, now)), limits.filter(in_range(start, now)), book)
    return learn_ceiling(blocks)


def refresh_ceilings(
    cached: DataFrame, requests, limits, now: datetime, ttl_hours: int = 24, days: int = RETENTION_DAYS,
    book=PRICE_BOOK,
) -> DataFrame:
    """Next state of the ceiling table: rows still valid are kept, all others are recomputed.

    A row is valid while the key of its workspace is unchanged and it is younger than ``ttl_hours``. Only the
    requests of stale workspaces are read again.
    """
    keys = ceiling_key(limits, now, days)
    fresh = F.col("computed_at") > as_ts(now - timedelta(hours=ttl_hours))
    valid = cached.filter(fresh).join(keys, [WS, "key"], "left_semi")
    stale = keys.join(valid, WS, "left_anti")
    need = stale.select(WS)
    learned = learned_ceiling(
        requests.join(need, WS, "left_semi"), limits.join(need, WS, "left_semi"), now, days, book
    )
    computed = stale.join(learned, WS, "left").select(
        WS, "key", as_ts(now).alias("computed_at"), "median", "p10", "samples"
    )
    return valid.select(computed.columns).unionByName(computed)


def active_block(blocks: DataFrame, ceilings: DataFrame, now: datetime) -> DataFrame:
    """The block ``now`` falls in, its burn rate, projection and share of the learned ceiling."""
    at = as_ts(now)
    # Blocks never overlap, so at most one block per workspace contains now; it must be the newest one.
    newest = blocks.groupBy(WS).agg(F.max("block_start").alias("block_start"))
    live = blocks.join(newest, [WS, "block_start"], "left_semi").filter(
        (at >= F.col("block_start")) & (at < F.col("block_end"))
    )
    now_us = F.unix_micros(at)
    hours = F.greatest(now_us - F.unix_micros("first_ts"), F.lit(15 * 60 * 1_000_000)) / 3_600_000_000
    remaining = (F.unix_micros("block_end") - now_us) / 1000
    rated = (
        live.join(ceilings, WS, "left")
        .withColumn("elapsed_ms", (now_us - F.unix_micros("block_start")) / 1000)
        .withColumn("remaining_ms", remaining)
        .withColumn("burn_per_hour", F.col("value") / hours)
        .withColumn("projected", F.col("value") + F.col("burn_per_hour") * F.col("remaining_ms") / 3_600_000)
    )
    return rated.select(
        WS, "block_start", "block_end", "requests", "value", "elapsed_ms", "remaining_ms", "burn_per_hour",
        "projected",
        (F.col("value") / F.col("median")).alias("pct_of_ceiling"),
        (F.col("projected") / F.col("median")).alias("projected_pct"),
        F.col("median").alias("ceiling"),
        F.coalesce("samples", F.lit(0)).alias("ceiling_samples"),
    )


def unseen_usage() -> Column:
    """A limit hit far below the conservative ceiling: usage that does not report here."""
    return F.coalesce(
        (F.col("samples") >= 3) & (F.col("value_at_limit") < F.col("p10") * 0.6), F.lit(False)
    )


def tagged_blocks(blocks: DataFrame, ceilings: DataFrame, now: datetime) -> DataFrame:
    """Blocks with the labels shown on the chart."""
    at = as_ts(now)
    limited = F.col("limits") > 0
    joined = blocks.join(ceilings, WS, "left").withColumn("unseen", unseen_usage())
    tag = (
        F.when(limited & F.col("unseen"), "limit ?")
        .when(limited, "limit")
        .when((at >= F.col("block_start")) & (at < F.col("block_end")), "now")
        .otherwise("")
    )
    return joined.select(
        WS, "block_start", "block_end", "requests", "value", limited.alias("limited"), "unseen", tag.alias("tag")
    )


def block_stats(blocks: DataFrame) -> DataFrame:
    limited = F.col("limits") > 0
    return blocks.groupBy(WS).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.avg("value").alias("avg_value"),
        F.count_if(limited).alias("limited"),
        (F.count_if(limited) / F.count(F.lit(1))).alias("limited_share"),
    )


def add_manual_limits(limits: DataFrame, marks: DataFrame, now: datetime) -> DataFrame:
    """Limit series with hand-made marks added. Marks in the future are dropped; any kind but weekly means
    a five-hour limit."""
    past = marks.filter(F.col("ts").isNotNull() & (F.col("ts") <= as_ts(now)))
    kind = F.when(F.col("limit_kind") == "weekly", "weekly").otherwise("five_hour")
    rows = past.select(
        WS, "id", F.lit(None).cast("string").alias("session_id"), "ts", kind.alias("limit_kind"),
        F.lit("manual").alias("source"),
    )
    return limits.select(rows.columns).unionByName(rows)
