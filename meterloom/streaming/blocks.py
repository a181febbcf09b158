"""Streaming five-hour blocks.

Block membership depends only on active hours, so the stream first collapses to closed hours with native windowed
aggregates (partial aggregation spreads a busy workspace over all tasks):

* limit hits collapse to one row per workspace and hour, with the instant of the first;
* requests meet the limit row of their hour in a stream-stream join, so the value up to that instant is an ordinary sum.
  The join is salted, so the requests of one workspace and hour are held by many tasks; limit rows are copied to each salt;
* both sides collapse to one row per workspace and hour, also for hours that hold limits only.

The stateful step then sees at most one row per workspace and hour. It keeps one open block per workspace, emits its totals
whenever an hour is added, and closes it by an event-time timer at the block's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.pricing import PRICE_BOOK, model_family, with_prices
from ..operators.blocks import BLOCK_HOURS, build_blocks
from ..operators.rollups import WS

SALTS = 16
_HOUR_MS = 3_600_000

# Times travel through the state as microseconds; -1 stands for none.
_SUMS = ("requests", "limits", "block_limits")
_VALUES = ("value", "opus_value")
_STATE = "start_hour long, last_hour long, limit_hour long, first_us long, last_us long, first_limit_us long, last_limit_us long, requests long, limits long, block_limits long, value double, opus_value double, reached double"
_KEPT = T.StructType([T.StructField(n, T.DoubleType() if kind == "double" else T.LongType()) for n, kind in (f.split() for f in _STATE.split(", "))])
_OUT = f"{WS} string, {_STATE}, final boolean"


class _OpenBlock(StatefulProcessor):
    """Keeps the open block of a workspace; emits its running totals whenever an hour is added, and once more at its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", _KEPT)
        self._names = [f.split()[0] for f in _STATE.split(", ")]

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[WS, *self._names, "final"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hours = pd.concat(list(rows)).sort_values("hour")  # closed hours of one workspace: a handful per batch
        block = dict(zip(self._names, self._open.get(), strict=True)) if self._open.exists() else None
        out = {}
        for row in hours.to_dict("records"):
            hour = int(row["hour"])
            if block is None or hour >= block["start_hour"] + BLOCK_HOURS:
                if block is not None:
                    self._handle.deleteTimer((block["start_hour"] + BLOCK_HOURS) * _HOUR_MS)
                    out[block["start_hour"]] = (key[0], *block.values(), True)
                block = {n: 0 for n in self._names} | {n: -1 for n in self._names if n.endswith("_us")}
                block |= {"start_hour": hour, "limit_hour": -1, "value": 0.0, "opus_value": 0.0, "reached": 0.0}
                self._handle.registerTimer((hour + BLOCK_HOURS) * _HOUR_MS)
            if block["limit_hour"] < 0:  # up to its first limit hit the block's value is what a limit was reached at
                if row["limits"]:
                    block["limit_hour"], block["first_limit_us"] = hour, int(row["first_limit_us"])
                block["reached"] += float(row["value_to_limit"] if row["limits"] else row["value"])
            if row["limits"]:
                block["last_limit_us"] = max(block["last_limit_us"], int(row["last_limit_us"]))
            block["first_us"] = int(row["first_us"]) if block["first_us"] < 0 else min(block["first_us"], int(row["first_us"]))
            block["last_us"] = max(block["last_us"], int(row["last_us"]))
            block["last_hour"] = hour
            for name in _SUMS:
                block[name] += int(row[name])
            for name in _VALUES:
                block[name] += float(row[name])
            out[block["start_hour"]] = (key[0], *block.values(), False)
        if block is not None:
            self._open.update(tuple(block.values()))
        yield self._out(list(out.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the end of the open block: no hour can be added to it any more."""
        rows = []
        if self._open.exists():
            block = self._open.get()
            if (block[0] + BLOCK_HOURS) * _HOUR_MS <= expiredTimerInfo.getExpiryTimeInMs():
                rows.append((key[0], *block, True))
                self._open.clear()
        yield self._out(rows)

    def close(self) -> None:
        pass


def hourly_limits(limits: DataFrame) -> DataFrame:
    """Limit hits (watermarked) per workspace and hour."""
    return limits.groupBy(WS, F.window("ts", "1 hour").alias("span")).agg(
        F.min(F.unix_micros("ts")).alias("first_limit_us"),
        F.max(F.unix_micros("ts")).alias("last_limit_us"),
        F.count(F.lit(1)).alias("limits"),
        F.count_if(F.col("limit_kind") != "weekly").alias("block_limits"),
    )


def closed_hours(requests: DataFrame, limits: DataFrame, delay: str, book=PRICE_BOOK, salts: int = SALTS) -> DataFrame:
    """Requests and limit hits per workspace and hour, emitted once the watermark has passed the hour."""
    hits = hourly_limits(limits.withWatermark("ts", delay))
    copies = hits.select(
        F.col(WS).alias("_ws"), F.col("span").alias("_span"), "first_limit_us", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    used = with_prices(requests.withWatermark("ts", delay), book).select(
        WS, F.window("ts", "1 hour").alias("span"), F.unix_micros("ts").alias("at"), "value_usd",
        F.when(model_family() == "opus", F.col("value_usd")).otherwise(0.0).alias("opus_usd"),
        F.pmod(F.xxhash64("ts", "value_usd", "request_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    met = used.join(copies, (F.col(WS) == F.col("_ws")) & (F.col("span") == F.col("_span")) & (F.col("salt") == F.col("_salt")), "left")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    used = met.select(
        WS, "span", "at", "value_usd", "opus_usd", F.when(F.col("at") <= F.col("first_limit_us"), F.col("value_usd")).alias("to_limit"),
        none("long", "first_limit_us"), none("long", "last_limit_us"), none("long", "limits"), none("long", "block_limits"),
    )
    hits = hits.select(
        WS, "span", none("long", "at"), *(none("double", n) for n in ("value_usd", "opus_usd", "to_limit")),
        "first_limit_us", "last_limit_us", "limits", "block_limits",
    )
    both = used.union(hits)
    hours = both.groupBy(WS, "span").agg(
        F.count("at").alias("requests"),
        F.coalesce(F.sum("value_usd"), F.lit(0.0)).alias("value"),
        F.coalesce(F.sum("opus_usd"), F.lit(0.0)).alias("opus_value"),
        F.coalesce(F.sum("to_limit"), F.lit(0.0)).alias("value_to_limit"),
        F.least(F.min("at"), F.min("first_limit_us")).alias("first_us"),
        F.greatest(F.max("at"), F.max("last_limit_us")).alias("last_us"),
        F.coalesce(F.sum("limits"), F.lit(0).cast("long")).alias("limits"),
        F.coalesce(F.sum("block_limits"), F.lit(0).cast("long")).alias("block_limits"),
        F.coalesce(F.min("first_limit_us"), F.lit(-1).cast("long")).alias("first_limit_us"),
        F.coalesce(F.max("last_limit_us"), F.lit(-1).cast("long")).alias("last_limit_us"),
    )
    hour = F.floor(F.unix_seconds("span.start") / 3600).cast("long")
    return hours.select(WS, "span", hour.alias("hour"), *[c for c in hours.columns if c not in (WS, "span")])


def stream_blocks(requests: DataFrame, limits: DataFrame, delay: str = "10 minutes", book=PRICE_BOOK) -> DataFrame:
    """Block updates of two streams; ``current_blocks`` gives the state of each block. Events later than the watermark are
    left to the batch rebuild of their workspace (``rebuild_late``).

    Start the query within ``session.stream_settings``, as keyed state with timers needs the store named there.
    """
    return closed_hours(requests, limits, delay, book).drop("span").groupBy(WS).transformWithStateInPandas(
        statefulProcessor=_OpenBlock(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime"
    )


def current_blocks(updates: DataFrame) -> DataFrame:
    """Latest state of every block from the update log, with the columns of the batch form, and whether it is closed."""
    names = [f.split()[0] for f in _STATE.split(", ") if not f.startswith("start_hour")]
    newest = F.max_by(F.struct(*names), F.struct("last_hour", "final")).alias("b")
    rows = updates.groupBy(WS, "start_hour").agg(newest, F.max("final").alias("final")).select(WS, "start_hour", "b.*", "final")
    instant = lambda c: F.when(F.col(c) >= 0, F.timestamp_micros(c))
    return rows.select(
        WS, F.timestamp_seconds(F.col("start_hour") * 3600).alias("block_start"), F.timestamp_seconds((F.col("start_hour") + BLOCK_HOURS) * 3600).alias("block_end"),
        instant("first_us").alias("first_ts"), instant("last_us").alias("last_ts"), "requests", "value", "opus_value", "limits", "block_limits",
        instant("first_limit_us").alias("first_limit_ts"), F.when(F.col("limits") > 0, F.col("reached")).alias("value_at_limit"), "final",
    )


def rebuild_late(requests: DataFrame, limits: DataFrame, late: DataFrame) -> DataFrame:
    """Blocks of every workspace a late event touched. One late event can move all later borders, so the
    workspace's chain is rebuilt from its start (over hours, not over requests)."""
    touched = late.select("workspace_id").distinct()
    return build_blocks(
        requests.join(touched, "workspace_id", "left_semi"), limits.join(touched, "workspace_id", "left_semi")
    )
