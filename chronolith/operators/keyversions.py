"""Versioned cache keys: reading the version, telling stale keys, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPT_VERSION, PLAIN_VERSION, ROLLUP_VERSION, VERIFY_VERSION = 11, 7, 12, 1
VERSIONED = r":(eli5:)?v([0-9]+):"
BARE = r"^[0-9a-f]{40}:"


def version_kind(key: Column) -> Column:
    return F.when(key.rlike(VERSIONED), F.when(F.regexp_extract(key, VERSIONED, 1) != "", "eli5").otherwise("summary"))


def version_number(key: Column) -> Column:
    """Decimal, so that a long version compares by value; one of more than 38 digits is the largest."""
    digits = F.regexp_extract(key, VERSIONED, 2)
    return F.when(key.rlike(VERSIONED), F.coalesce(digits.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)")))


def is_stale(key: Column, prompt: int = PROMPT_VERSION, plain: int = PLAIN_VERSION) -> Column:
    """Older than its kind's version, or without one under a 40-digit id; other shapes are live."""
    kind, v = version_kind(key), version_number(key)
    return F.when(key.isNull(), False).when(kind == "eli5", v < plain).when(kind == "summary", v < prompt).otherwise(F.coalesce(key.rlike(BARE), F.lit(False)))


def owner(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def mark(cache: DataFrame, keep: DataFrame | None = None, *, prompt: int = PROMPT_VERSION, plain: int = PLAIN_VERSION) -> DataFrame:
    """``stale`` and ``removed`` for every row with a ``key``; ids in ``keep`` (``sha``) protect their keys."""
    marked = cache.withColumn("stale", is_stale(F.col("key"), prompt, plain))
    if keep is None:
        return marked.withColumn("removed", F.col("stale"))
    kept = keep.select(F.col("sha").alias("_keep")).where("_keep is not null").distinct()
    joined = marked.join(kept, owner(F.col("key")) == F.col("_keep"), "left")
    return joined.withColumn("removed", F.col("stale") & F.col("_keep").isNull()).drop("_keep")


def prune(cache: DataFrame, keep: DataFrame | None = None, **versions: int) -> DataFrame:
    return mark(cache, keep, **versions).where("not removed").drop("stale", "removed")


def to_refresh(cache: DataFrame, n: int = 10, **versions: int) -> DataFrame:
    """The first ``n`` stale rows by key: a cycle's share of the backlog."""
    return mark(cache, **versions).where("stale").orderBy("key").limit(n).drop("stale", "removed")
