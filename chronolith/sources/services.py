"""Readings that come from outside, by functions that the caller injects; nothing here opens a connection."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filled
from ..operators import upsert
from ..schemas import STATUS, TRAFFIC
from .changelog import exists
from .files import read_traffic


def refresh_traffic(spark: SparkSession, path: str, fetch: Callable[[], dict | None], now_ms: int, *, ttl_ms: int = 6 * 3_600_000, force: bool = False) -> DataFrame:
    """A traffic reading from a cache that is young enough, or fetched, merged with the cache and stored.

    ``fetch`` returns the reading as a dict; if it fails in any way or returns nothing the cached reading is used, and without
    one there are no rows. The call is made on the driver: one reading, whatever the size of the data.
    """
    cached = spark.createDataFrame(read_traffic(spark, path).limit(1).collect(), TRAFFIC) if exists(spark, path) else spark.createDataFrame([], TRAFFIC)
    stale = cached.select(upsert.must_fetch(F.col("fetchedAt"), F.lit(now_ms), ttl_ms, force)).first()
    if stale is not None and not stale[0]:
        return cached
    try:
        got = fetch()
    except Exception:  # whatever the injected call raises, the cache is what is left
        got = None
    if not got:
        return cached
    stamp = F.date_format(F.timestamp_millis(F.lit(now_ms)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fresh = spark.createDataFrame([{f.name: got.get(f.name) for f in TRAFFIC.fields}], TRAFFIC).withColumn("fetchedAt", stamp)
    merged = upsert.merge_traffic(cached, fresh).select(TRAFFIC.names)
    kept = spark.createDataFrame(merged.collect(), TRAFFIC)  # one row; the file that was read is overwritten
    kept.coalesce(1).write.mode("overwrite").json(path)
    return kept


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """``sha`` and the sparse fields of an override map kept as one JSON object per file."""
    kind = "map<string,struct<title:string,summary:string,note:string,noise:boolean>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return text.select(F.explode("m").alias("sha", "fields")).select("sha", "fields.*")


def override_map(overrides: DataFrame) -> str:
    """The JSON object of an override table, keys sorted, without null fields. Overrides are written by hand."""
    rows = {r["sha"]: {k: v for k, v in r.asDict().items() if k != "sha" and v is not None} for r in overrides.orderBy("sha").collect()}
    return json.dumps(rows, indent=2, ensure_ascii=False) + "\n"


def status(manifest: DataFrame, traffic: DataFrame | None = None) -> DataFrame:
    """The row that a site shows of its state: head, time of generation, traffic if there is any."""
    row = manifest.select(*STATUS.names).limit(1)
    return row if traffic is None else row.join(traffic.limit(1).select(F.struct(*TRAFFIC.names).alias("traffic")), F.lit(True), "left")


def append_reading(spark: SparkSession, path: str, listing: DataFrame, stamp: str, *, warn: int, most: int) -> None:
    """Append one JSON line on the size of a listing to a series of readings."""
    size = F.col("bytes")
    listing.agg(
        F.lit(stamp).alias("ts"), F.floor(F.coalesce(F.sum("bytes"), F.lit(0)) / 1024).alias("sizeKiB"), F.count("bytes").alias("dataFiles"),
        F.count(F.when(size >= most, 1)).alias("overBudget"), F.count(F.when((size >= warn) & (size < most), 1)).alias("nearBudget"),
    ).coalesce(1).write.mode("append").json(path)


def commits_since(entries: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """``count`` of the records dated within the last days."""
    from ..functions import epoch_ms

    age = F.lit(now_ms) - epoch_ms(F.col("date"))
    return entries.where((age >= 0) & (age < days * 86_400_000)).agg(F.count(F.lit(1)).alias("count"))


def golden_sample(entries: DataFrame, n: int, seed: int = 40) -> DataFrame:
    """The ``n`` records of the lowest hashes: the same ones in every run, whatever the partitioning."""
    return entries.orderBy(F.xxhash64(F.lit(seed), "sha"), "sha").limit(n)


def enrich(entries: DataFrame, call: Callable[[str, str], str | None], *, id_col: str = "sha", text_col: str = "summary", out: str = "enriched") -> DataFrame:
    """Each record with what an injected function makes of it, in batches on the executors; null where it fails or there
    is no id. Rows pass through as they are, so repeated ids stay as many rows as they were."""
    whole = entries.select(F.struct("*").alias("row"), filled(F.col(id_col)).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(ident, text):
            try:
                return None if ident is None else call(ident, text)
            except (OSError, ValueError):
                return None

        for batch in batches:
            made = [one(*x) for x in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.string())], names=["row", "made"])

    return whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, made string").select("row.*", F.col("made").alias(out))
