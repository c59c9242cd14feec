"""Day shards: partitioning, canonical order, change detection and the table on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import day_key
from . import ordering

LAYOUT = "day-shards"
SHARD_DIR = "changelog"


def with_day(entries: DataFrame, day: str = "day", date: str = "date") -> DataFrame:
    """The records with ``shard``, the partition that each belongs to."""
    return entries.withColumn("shard", day_key(F.col(day), F.col(date)))


def canonical_order(date: str = "date", sha: str = "sha", tie: str | None = None) -> list[Column]:
    """By date and id as text, nulls first; ``tie`` decides between equal ones."""
    return [F.col(date).asc_nulls_first(), F.col(sha).asc_nulls_first(), *([F.col(tie).asc_nulls_first()] if tie else [])]


def canonical_sort(entries: DataFrame, **names: str) -> DataFrame:
    return entries.orderBy(*canonical_order(**names))


def ranked(entries: DataFrame, n: int, **names: str) -> DataFrame:
    """The first ``n`` in canonical order, with ``rank``; the order is taken from n rows, not from all."""
    first = entries.orderBy(*canonical_order(**names)).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*canonical_order(**names))))


def ranked_all(entries: DataFrame, *, pieces: int | None = None, date: str = "date", sha: str = "sha", tie: str | None = None) -> DataFrame:
    """Every record with its ``rank`` in canonical order, which is sorted in pieces (see ``ordering``)."""
    keys = [F.col(date), F.col(sha), *([F.col(tie)] if tie else [])]
    return ordering.placed(entries, keys, pieces=pieces).withColumnRenamed("place", "rank")


def shard_summary(entries: DataFrame, size: Column) -> DataFrame:
    """Records and bytes of every shard."""
    return with_day(entries).groupBy("shard").agg(F.count(F.lit(1)).alias("entries"), F.sum(size).alias("bytes"))


def digests(entries: DataFrame, row: Column, by: str = "shard") -> DataFrame:
    """``shard, digest, entries``: equal contents have equal digests, whatever the order of rows.

    Rows are hashed one by one and the hashes combined by sum and exclusive or, so the aggregation is partial
    and no task holds a shard. Both are kept, as each alone misses some changes.
    """
    return combined(entries.select(by, *hashes(row)), by)


def hashes(row: Column) -> list[Column]:
    """``h, g``: what the digest of a shard is made of, for each row."""
    return [F.xxhash64(row).alias("h"), F.xxhash64(F.lit("shard"), row).alias("g")]


def combined(hashed: DataFrame, by: str = "shard") -> DataFrame:
    """:func:`digests` of rows whose hashes are known."""
    agg = hashed.groupBy(by).agg(F.count("h").alias("entries"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("g").alias("x"))
    return agg.select(by, F.md5(F.concat_ws("|", "entries", "s", "x")).alias("digest"), "entries")


def shard_changes(stored: DataFrame, wanted: DataFrame, by: str = "shard") -> DataFrame:
    """``shard, action`` from two digest tables: keep, rewrite, write (new) or delete (vanished)."""
    old = stored.select(by, F.col("digest").alias("old"))
    new = wanted.select(by, F.col("digest").alias("new"))
    action = F.when(F.col("old").isNull(), "write").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "keep").otherwise("rewrite")
    return old.join(new, by, "full").select(by, action.alias("action"))


def is_legacy(document: DataFrame) -> Column:
    """Whether a document holds its entries inline."""
    return F.col("entries").isNotNull()


def inline_entries(documents: DataFrame, *keep: str) -> DataFrame:
    """The entries of documents, one row each."""
    return documents.select(*keep, F.inline("entries"))
