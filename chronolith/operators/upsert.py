"""Keyed series: latest-wins union and cached readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import epoch_ms


def latest_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union by key in which rows of ``new`` replace those of ``old``; one aggregation, partial first.

    Within one side, repeated keys keep their largest row.
    """
    values = [c for c in old.columns if c != key]
    both = old.select(key, *values, F.lit(0).alias("_turn")).unionByName(new.select(key, *values, F.lit(1).alias("_turn")))
    best = both.groupBy(key).agg(F.max(F.struct("_turn", *values)).alias("_best"))
    return best.select(key, *[F.col("_best")[c].alias(c) for c in values])


def merge_traffic(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """One reading from a cached and a fresh one: the fresh totals, and the days of both, oldest first."""
    days = latest_wins(cached.select(F.inline("clones")), fresh.select(F.inline("clones")), "timestamp")
    series = days.agg(F.array_sort(F.collect_list(F.struct("timestamp", "count", "uniques"))).alias("clones"))
    return fresh.drop("clones").limit(1).crossJoin(series)


def must_fetch(fetched_at: Column, now_ms: Column, ttl_ms: int = 6 * 3_600_000, force: bool = False) -> Column:
    """Whether a cached reading is too old (a lifetime of six hours is this library's choice)."""
    return F.lit(force) | F.coalesce(now_ms - epoch_ms(fetched_at) >= ttl_ms, F.lit(True))


def fresh_or_cached(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fresh reading, or the cached one where fetching gave no row."""
    ranked = fresh.withColumn("_turn", F.lit(0)).unionByName(cached.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    return ranked.orderBy("_turn").limit(1).drop("_turn")
