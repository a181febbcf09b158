"""Usage per workspace and quarter hour, kept as a log of changes.

Every zone's midnight falls on a quarter hour of UTC, so sums since local midnight and over whole days come from tiles alone.
A merge that replaces rows adds what the new rows hold and takes away what the old ones held; summing all changes gives the
tiles of the current table, whatever the order and number of merges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollups import WS

SECONDS = 900
REQUEST_TILES = f"{WS} string, slot long, model string, requests long, value double"
LIMIT_TILES = f"{WS} string, slot long, limits long, block_limits long, last_limit struct<ts:timestamp,id:string,limit_kind:string>"


def slot_of(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / SECONDS).cast("long")


def request_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of the tiles when rows ``before`` give way to rows ``after``."""
    rows = before.select(WS, "ts", "model", "value_usd", F.lit(-1).cast("long").alias("n")).unionByName(
        after.select(WS, "ts", "model", "value_usd", F.lit(1).cast("long").alias("n"))
    )
    summed = rows.groupBy(WS, slot_of(F.col("ts")).alias("slot"), "model").agg(
        F.sum("n").alias("requests"), F.sum(F.col("n") * F.col("value_usd")).alias("value")
    )
    return summed.where("requests <> 0 or value <> 0")


def limit_tiles(new: DataFrame) -> DataFrame:
    """Tiles of limit hits that were not stored before."""
    return new.groupBy(WS, slot_of(F.col("ts")).alias("slot")).agg(
        F.count(F.lit(1)).alias("limits"),
        F.count_if(F.col("limit_kind") != "weekly").alias("block_limits"),
        F.max(F.struct("ts", "id", "limit_kind")).alias("last_limit"),
    )
