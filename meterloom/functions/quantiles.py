"""Exact interpolated quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. Here equal values collapse first, a
histogram with monotone buckets locates the one or two buckets that hold the wanted ranks, those are cut into
equal parts the same way, and only the parts holding a wanted rank are ranked value by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

_BUCKETS_PER_E = 256
_PARTS = 4096
_ZERO_GAP = 1_000_000  # keeps log-scale buckets of tiny magnitudes on the right side of zero


def _bucket(v: Column) -> Column:
    """A non-decreasing integer function of ``v``: about 0.4 % wide buckets on a log scale, both signs."""
    scale = F.floor(F.log(F.abs(v)) * _BUCKETS_PER_E) + _ZERO_GAP
    return F.when(v > 0, scale).when(v < 0, -scale).otherwise(F.lit(0)).cast("long")


def _holds(rank: Column, first: str, end: str) -> Column:
    return (rank >= F.col(first)) & (rank < F.col(end))


def wanted(quantiles: Mapping[str, float], low, high, first: str, end: str) -> Column:
    """Whether a range of ranks holds one that some quantile needs."""
    hit = F.lit(False)
    for q in quantiles.values():
        hit = hit | _holds(low(q), first, end) | _holds(high(q), first, end)
    return hit


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], count: str = "n"
) -> DataFrame:
    """One row per group: ``count`` of non-null values and each linearly interpolated quantile.

    ``df`` is read once: its distinct values with their counts are written down, and all levels read that table.
    """
    distinct = written(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", _bucket(F.col("_v"))),
        "quantiles",
    )
    histogram = distinct.groupBy(*keys, "_b").agg(
        F.sum("_c").alias("_bc"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    # One row per occupied bucket; a group has a bounded number of buckets whatever its size.
    up_to = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = histogram.select(
        *keys, "_b", "_bc", "_lo", "_hi",
        F.sum("_bc").over(up_to).alias("_upto"),
        F.sum("_bc").over(W.partitionBy(*keys)).alias(count),
    ).withColumn("_before", F.col("_upto") - F.col("_bc"))

    def low(q: float) -> Column:
        return F.floor((F.col(count) - 1) * F.lit(float(q)))

    def high(q: float) -> Column:
        return F.ceil((F.col(count) - 1) * F.lit(float(q)))

    targets = ranked.filter(wanted(quantiles, low, high, "_before", "_upto")).select(
        *keys, "_b", "_before", "_lo", "_hi", count
    )
    # Second level: the chosen buckets are cut into equal parts, so that even values packed closely together
    # are only ranked within a small part.
    width = F.col("_hi") - F.col("_lo")
    part = F.least(F.floor((F.col("_v") - F.col("_lo")) / width * _PARTS), F.lit(_PARTS - 1))
    inside = distinct.join(targets, [*keys, "_b"]).withColumn("_p", F.when(width > 0, part).otherwise(0).cast("long"))
    parts = inside.groupBy(*keys, "_b", "_p").agg(
        F.sum("_c").alias("_pc"), F.max("_before").alias("_base"), F.max(count).alias(count)
    )
    parts_up_to = W.partitionBy(*keys, "_b").orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = parts.withColumn("_pupto", F.col("_base") + F.sum("_pc").over(parts_up_to)).withColumn(
        "_pbefore", F.col("_pupto") - F.col("_pc")
    )
    chosen = placed.filter(wanted(quantiles, low, high, "_pbefore", "_pupto")).select(
        *keys, "_b", "_p", "_pbefore", count
    )
    within = W.partitionBy(*keys, "_b", "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    candidates = (
        inside.drop(count)
        .join(chosen, [*keys, "_b", "_p"])
        .withColumn("_end", F.col("_pbefore") + F.sum("_c").over(within))
        .withColumn("_first", F.col("_end") - F.col("_c"))
    )
    picks = [F.max(count).alias(count)]
    for name, q in quantiles.items():
        picks.append(F.max(F.when(_holds(low(q), "_first", "_end"), F.col("_v"))).alias(f"_{name}_lo"))
        picks.append(F.max(F.when(_holds(high(q), "_first", "_end"), F.col("_v"))).alias(f"_{name}_hi"))
    found = candidates.groupBy(*keys).agg(*picks)

    def interpolate(name: str, q: float) -> Column:
        position = (F.col(count) - 1) * F.lit(float(q))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return lo + (hi - lo) * (position - F.floor(position))

    return found.select(*keys, count, *[interpolate(n, q).alias(n) for n, q in quantiles.items()])
