"""Change records as a stream: the store as a sink, latest-wins series, windows by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import changelog
from ..sources.entries import opened


def read_entries(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON-lines files of records as a stream, with fields of any kind in ``more``; lines that can't be read give none."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return opened(lines.select(F.try_parse_json("value").alias("_entry")).where(F.schema_of_variant("_entry").startswith("OBJECT")), "_entry")


def keep_store(stream: DataFrame, root: str, checkpoint: str, manifest: dict, on_save: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Merge each batch into the store by sha, the later row winning, and save.

    A batch reads the days that its records belong to or lay in until now, whatever else the store holds, and writes those
    that change. Late records rewrite the shard of their own day; there is no watermark, and a batch that is replayed after
    a failure changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        actions = changelog.merge(batch.sparkSession, root, batch, manifest)
        if on_save:
            on_save(number, actions)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, *, time: str = "ts", keys: tuple[str, ...] = (), length: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows per event-time window and keys; state of windows older than the watermark is dropped (an extension)."""
    window = F.window(time, length, slide or length)
    counted = stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "rows")


def sessions(stream: DataFrame, *, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Rows per session of a key (an extension)."""
    counted = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")
