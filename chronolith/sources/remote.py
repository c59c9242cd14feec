"""Readings and feeds from outside as Spark data sources, over functions that the caller injects; nothing here opens a connection.

:func:`read_targets` asks one function for each of many targets, a task for some of them at a time, with a cache that has a
lifetime and is what remains where asking fails. :func:`read_feed` streams a feed that is known by positions: a batch is a
range of positions, cut into partitions, and is asked for again if it is replayed. Functions go to the executors, so they
must be of a module that these have, or pickle by value.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import STATUS, TRAFFIC

READINGS = "target string, ok boolean, code int, body string, fetched_ms long, cached boolean"
RECORDS = "position long, value string"

#: Asks one target: its code as in HTTP, and its body.
Fetch = Callable[[str], tuple[int, str]]


class Feed(Protocol):
    """A feed of records at positions from 0 on; what was told of a position stays."""

    def end(self) -> int: ...

    def between(self, start: int, end: int) -> Iterator[str]: ...


@dataclass
class Targets(InputPartition):
    names: list[str]


@dataclass
class Range(InputPartition):
    start: int
    end: int


class Cache:
    """The last good reading of each target, a JSON file each, in a folder that all executors reach."""

    def __init__(self, path: str):
        self.path = path

    def _file(self, target: str) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.path)
        return system, f"{base.rstrip('/')}/{hashlib.sha256(target.encode()).hexdigest()}.json"

    def get(self, target: str) -> dict | None:
        system, path = self._file(target)
        try:
            with system.open_input_stream(path) as file:
                return json.loads(file.read())
        except (OSError, ValueError):
            return None

    def put(self, target: str, reading: dict) -> None:
        system, path = self._file(target)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        temporary = f"{path}.{time.monotonic_ns()}"
        with system.open_output_stream(temporary) as file:
            file.write(json.dumps(reading).encode())
        system.move(temporary, path)


class TargetReader(DataSourceReader):
    def __init__(self, fetch: Fetch, options: dict):
        self.fetch, self.names = fetch, json.loads(options["targets"])
        self.per_task, self.now, self.ttl = int(options["targetsPerTask"]), int(options["nowMs"]), int(options["ttlMs"])
        self.cache = Cache(options["cache"]) if options.get("cache") else None

    def partitions(self) -> list[Targets]:
        return [Targets(self.names[k : k + self.per_task]) for k in range(0, len(self.names), self.per_task)] or [Targets([])]

    def read(self, partition: Targets) -> Iterator[tuple]:
        for name in partition.names:
            held = self.cache.get(name) if self.cache else None
            if held and 0 <= self.now - held["fetched_ms"] < self.ttl:
                yield name, True, held["code"], held["body"], held["fetched_ms"], True
                continue
            try:
                code, body = self.fetch(name)
            except Exception:  # whatever the injected call raises, the cache is what is left
                code, body = None, None
            if code is not None and 200 <= code < 300:
                if self.cache:
                    self.cache.put(name, {"code": code, "body": body, "fetched_ms": self.now})
                yield name, True, code, body, self.now, False
            elif held:
                yield name, True, held["code"], held["body"], held["fetched_ms"], True
            else:
                yield name, False, code, None, None, False


class FeedReader(DataSourceStreamReader):
    def __init__(self, feed: Feed, options: dict):
        self.feed, self.first = feed, int(options["first"])
        self.per_task, self.per_batch = int(options["recordsPerTask"]), int(options["recordsPerBatch"])
        self.told = self.first

    def initialOffset(self) -> dict:
        return {"position": self.first}

    def latestOffset(self) -> dict:
        """No further than a batch beyond what was told last, so that a long feed comes in batches of a bounded size."""
        self.told = min(max(self.told, self.feed.end()), self.told + self.per_batch)
        return {"position": self.told}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.told = max(self.told, end["position"])
        cuts = range(start["position"], end["position"], self.per_task)
        return [Range(a, min(a + self.per_task, end["position"])) for a in cuts]

    def read(self, partition: Range) -> Iterator[tuple]:
        for position, value in enumerate(self.feed.between(partition.start, partition.end), partition.start):
            yield position, value


def _source(name: str, kind: str, make: Callable[[dict], object], stream: bool) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return kind

        if stream:

            def streamReader(self, schema):
                return make(self.options)
        else:

            def reader(self, schema):
                return make(self.options)

    return Source


class _Options(dict):
    """Options by name in any case, as Spark keeps them."""

    def __init__(self, options):
        super().__init__({k.lower(): v for k, v in options.items()})

    def __getitem__(self, key: str):
        return super().__getitem__(key.lower())

    def get(self, key: str, default=None):
        return super().get(key.lower(), default)


def register(spark: SparkSession, name: str, *, fetch: Fetch | None = None, feed: Feed | None = None) -> None:
    """Make ``spark.read.format(name)`` ask ``fetch``, or ``spark.readStream.format(name)`` follow ``feed``."""
    if (fetch is None) == (feed is None):
        raise ValueError("either fetch or feed")
    if fetch is not None:
        spark.dataSource.register(_source(name, READINGS, lambda o: TargetReader(fetch, _Options(o)), False))
    else:
        spark.dataSource.register(_source(name, RECORDS, lambda o: FeedReader(feed, _Options(o)), True))


def read_targets(spark: SparkSession, fetch: Fetch, targets: list[str], now_ms: int, *, cache: str | None = None, ttl_ms: int = 0, per_task: int = 16, name: str = "chronolith_targets") -> DataFrame:
    """One reading a target: fresh, or of the cache while it is younger than ``ttl_ms`` or where asking fails; else not ok."""
    register(spark, name, fetch=fetch)
    reader = spark.read.format(name).option("targets", json.dumps(list(targets))).option("nowMs", now_ms).option("ttlMs", ttl_ms).option("targetsPerTask", per_task)
    return (reader.option("cache", cache) if cache else reader).load()


def statuses(readings: DataFrame) -> DataFrame:
    """Readings of status targets with ``headSha`` and ``generatedAt``, for ``freshness.check_status``."""
    return readings.select("target", "ok", "code", "cached", F.from_json("body", STATUS).alias("s")).select("target", "ok", "code", "cached", "s.*")


def traffic(readings: DataFrame) -> DataFrame:
    """Readings of traffic targets in the shape of ``schemas.TRAFFIC``, stamped with the time of asking; failures give no row."""
    stamp = F.date_format(F.timestamp_millis("fetched_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parsed = readings.where("ok").select("target", F.from_json("body", TRAFFIC).alias("t"), stamp.alias("fetchedAt"))
    return parsed.select("target", *[F.col("t")[n].alias(n) for n in TRAFFIC.names if n != "fetchedAt"], "fetchedAt")


def read_feed(spark: SparkSession, feed: Feed, *, first: int = 0, per_batch: int = 100_000, per_task: int = 10_000, name: str = "chronolith_feed") -> DataFrame:
    """The records of a feed as a stream ``position, value``."""
    register(spark, name, feed=feed)
    return spark.readStream.format(name).option("first", first).option("recordsPerBatch", per_batch).option("recordsPerTask", per_task).load()
