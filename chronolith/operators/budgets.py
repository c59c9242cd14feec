"""File listings against budgets: tracked files by size, deployed assets by number and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import MIB, grouped, rounded, size_text
from ..settings import ASSET_CAP_BYTES, MARGIN_SHARE, AssetLimits
from . import ordering

WARN_BYTES, MAX_BYTES = 60 * MIB, 85 * MIB


def over_budget(listing: DataFrame, *, warn: int = WARN_BYTES, most: int = MAX_BYTES, tie: str = "path") -> DataFrame:
    """Files at or above a limit: ``bucket`` over or near, and ``rank`` by size within it.

    Rows without a numeric size, or with NaN, are in no bucket.
    """
    size = F.col("bytes")
    bucket = F.when(F.isnan(size.cast("double")), F.lit(None)).when(size >= most, F.lit("over")).when(size >= warn, F.lit("near"))
    named = listing.withColumn("bucket", bucket).where("bucket is not null")
    ranked = ordering.placed(named, [-size, F.col(tie).isNull(), F.col(tie)], by="bucket")
    return ranked.withColumn("rank", F.col("place").cast("int")).drop("place")


def read_assets(listing: DataFrame, limits: AssetLimits) -> DataFrame:
    """One row: number, total and largest of the files, number and worst of those above the size cap, and the flags.

    Of equally large files the first by path counts. Partial and final aggregation only; :func:`oversized` lists the files.
    """
    size = F.col("bytes")
    first = F.struct((-size).alias("s"), F.col("path"))
    above = F.col("bytes") > ASSET_CAP_BYTES
    readings = listing.where(size.isNotNull()).agg(
        F.count("bytes").alias("count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.min_by("path", first).alias("largest"),
        F.coalesce(F.max("bytes"), F.lit(0)).alias("largest_bytes"),
        F.count_if(above).cast("int").alias("n_oversized"),
        F.min_by(F.struct("bytes", "path"), F.when(above, first)).alias("worst"),
    )
    tight = limits.margin < limits.cap * MARGIN_SHARE
    return readings.select(
        "*",
        ((F.col("count") > limits.cap) | (F.col("n_oversized") > 0)).alias("over_cap"),
        (F.col("count") > limits.budget).alias("over_budget"),
        F.lit(tight).alias("tight_margin"),
    )


def oversized(listing: DataFrame) -> DataFrame:
    """The files above the size that one asset may have, as rows."""
    return listing.where(F.col("bytes") > ASSET_CAP_BYTES)


def verdict(reading: DataFrame) -> DataFrame:
    word = F.when(F.col("n_oversized") > 0, "oversized").when(F.col("over_cap"), "over_cap").when(F.col("over_budget"), "over_budget").when(F.col("tight_margin"), "tight_margin").otherwise("ok")
    return reading.withColumn("verdict", word)


class OverBudget(ValueError):
    """A listing breaks a budget."""


def require_size_budget(listing: DataFrame, *, warn: int = WARN_BYTES, most: int = MAX_BYTES) -> DataFrame:
    """The files near the limit; raises OverBudget, naming the ten largest, if any is over it."""
    found = over_budget(listing, warn=warn, most=most)
    worst = found.where("bucket = 'over'").orderBy("rank").limit(10).select("path", size_text(F.col("bytes")).alias("size")).collect()
    if worst:
        raise OverBudget("; ".join(f"{r['path']} has {r['size']}" for r in worst))
    return found.where("bucket = 'near'")


def require_dist_budget(listing: DataFrame, limits: AssetLimits, label: str = "dist/") -> str:
    """The message of a listing within its budget, a tight margin included; raises OverBudget with it otherwise."""
    row = message(read_assets(listing, limits), limits, label).first()
    if row["verdict"] in ("oversized", "over_cap", "over_budget"):
        raise OverBudget(row["message"])
    return row["message"]


def message(reading: DataFrame, limits: AssetLimits, label: str = "dist/") -> DataFrame:
    """A line per reading: files, size and share of the cap, and what the first broken limit means."""
    count = F.col("count")
    head = F.concat(
        F.lit(label + " "), grouped(count), F.when(count == 1, " file (").otherwise(" files ("), size_text(F.col("bytes")),
        F.lit(", "), rounded(count / F.lit(float(limits.cap)) * 100).cast("string"), F.lit(f"% of the {limits.cap:,}-file cap): "),
    )
    worst = F.col("worst")
    tail = (
        F.when(F.col("verdict") == "oversized", F.concat(worst["path"], F.lit(" is "), size_text(worst["bytes"]), F.lit(f", more than the {ASSET_CAP_BYTES // MIB} MiB that one asset may have")))
        .when(F.col("verdict") == "over_cap", F.lit(f"above the cap of {limits.cap:,} assets, so the next upload fails"))
        .when(F.col("verdict") == "over_budget", F.lit(f"above the budget of {limits.budget:,}"))
        .when(F.col("verdict") == "tight_margin", F.lit(f"within the budget of {limits.budget:,}, which leaves a margin of {limits.margin:,} only"))
        .otherwise(F.lit(f"within the budget of {limits.budget:,}, with a margin of {limits.margin:,}"))
    )
    return verdict(reading).withColumn("message", F.concat(head, tail))


def retained(listing: DataFrame, budget: int, *, newest: str = "date") -> DataFrame:
    """The newest files up to ``budget`` of them. ``limit`` keeps each task to as many rows at most."""
    return listing.orderBy(F.col(newest).desc_nulls_last(), F.col("path")).limit(budget)


def retention_plan(listing: DataFrame, *, files: int | None = None, size: int | None = None, newest: str = "date", pieces: int | None = None) -> DataFrame:
    """``listing`` with ``place`` (from 1, the newest first), ``running`` (bytes up to it) and ``kept``.

    A file is kept while the files up to it are at most ``files`` and their bytes at most ``size``, so what is kept is a run of
    the newest. Order is by ``newest``, then path; files without a date are last, unknown sizes are 0. The cut is found from
    sums of pieces of the order (see ``ordering``), whatever the number of files that are kept.
    """
    age = F.coalesce(-F.unix_micros(F.col(newest).try_cast("timestamp")), F.lit((1 << 63) - 1))
    out = ordering.placed(listing, [age, F.col("path")], sums={"running": F.coalesce(F.col("bytes").cast("long"), F.lit(0))}, pieces=pieces)
    fits = F.lit(True) if files is None else F.col("place") <= files
    return out.withColumn("kept", fits if size is None else fits & (F.col("running") <= size))
