"""Ordered computations over groups of any size.

A plain window sorts a whole group in one task. When one key may hold a large part of all rows, the group is
cut into ordered slices instead: each slice is summarised with a normal (partially aggregated) group-by, the
summaries are scanned in order (one row per slice), and every slice is then processed on its own, starting
from what came before it. The results are exactly those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    measures: Mapping[str, Column],
    slice_seconds: int = 3600,
) -> DataFrame:
    """Add inclusive running sums of ``measures`` within ``keys``, in ``(ts, *order)`` order.

    Slices are fixed time intervals, so their number per key is bounded by the calendar.
    """
    sliced = df.withColumn("_slice", F.floor(F.unix_seconds(F.col(ts)) / slice_seconds).cast("long"))
    for name, expr in measures.items():
        sliced = sliced.withColumn(name, expr)
    per_slice = sliced.groupBy(*keys, "_slice").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = per_slice.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}") for m in measures]
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(ts, *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = sliced.join(before, [*keys, "_slice"])
    plain = [c for c in df.columns if c not in measures]
    return joined.select(*plain, *[(F.sum(m).over(inside) + F.col(f"_{m}")).alias(m) for m in measures])


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Hashes of all keys that hold at least ``min_rows`` rows, by exact counts.

    Rows are counted before they shuffle, as a hash and a number each. There are at most rows / ``min_rows`` such keys,
    so their hashes are safe to broadcast.
    """
    counts = df.groupBy(F.xxhash64(*keys).alias("_hot_hash")).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") >= min_rows).select("_hot_hash")


def split_hot(df: DataFrame, keys: Sequence[str], seq: str, hot_rows: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(ordinary rows, rows of hot keys with ``_slice``): slices are up to ``parts`` ranges of ``seq`` of about equal numbers of
    rows, whatever the spacing of ``seq``. Where the cuts fall decides how even the work is, never what is computed."""
    hot = hot_keys(df, keys, hot_rows)
    named = df.withColumn("_hot_hash", F.xxhash64(*keys))
    cold = named.join(F.broadcast(hot), "_hot_hash", "left_anti").select(*df.columns)
    rows = named.join(F.broadcast(hot), "_hot_hash", "left_semi")
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = rows.groupBy("_hot_hash").agg(F.percentile_approx(seq, shares, 10_000).alias("_cuts"))
    cut = F.size(F.filter("_cuts", lambda c: c < F.col(seq))).cast("long")
    return cold, rows.join(cuts, "_hot_hash").withColumn("_slice", cut).select(*df.columns, "_slice")
