"""The poll decision as a stream: when a source has to be read again, with one state for each source.

A poll tells the head that a source has at a time. The state is what was last taken in: its head and when. A poll is
compared with it as in ``freshness.sync_reason_ms``; if there is a reason, the source is read and the state becomes the poll.
While a source is quiet, a timer of its state fires as soon as event time passes the floor, so that a source of which no
poll comes is due as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import freshness

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMPARED = "source string, id long, head string, last string, then long, now long, timer boolean"


class Decide(StatefulProcessor):
    """Rows of polls (source, id, head, now in milliseconds) with what was last taken in; of a timer, with its time as now.

    ``each``: every poll is taken in, whether it was due or not.
    """

    def __init__(self, stale_ms: int, floor: bool, each: bool):
        self.stale_ms, self.floor, self.each = stale_ms, floor, each

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "head string, at long")

    def _taken(self) -> tuple[str | None, int | None]:
        return self.last.get() if self.last.exists() else (None, None)

    def _take(self, head: str | None, now: int) -> None:
        self.last.update((head, now))
        if self.floor:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.stale_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        head, at = self._taken()
        out, taken = [], False
        for ident, seen, now in zip(polls["id"], polls["head"], polls["now"]):
            out.append((key[0], ident, seen, head, at, now, False))
            due = bool(seen) and (not head or head != seen or not at or now - at >= self.stale_ms)
            if due or self.each:
                head, at, taken = seen, int(now), True
        if taken:
            self._take(head, at)
        yield self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head, at = self._taken()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if at is not None and now - at >= self.stale_ms:
            yield self._table([(key[0], None, head, head, at, now, True)])
            self._take(head, now)

    @staticmethod
    def _table(rows: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(rows, columns=["source", "id", "head", "last", "then", "now", "timer"])
        return table.astype({"id": "Int64", "then": "Int64", "now": "Int64"})

    def close(self) -> None:
        pass


def decisions(polls: DataFrame, *, stale_ms: int = 300_000, floor: bool = True, each: bool = False, late: str = "0 seconds") -> DataFrame:
    """``source, id, now_ms, timer, reason`` for a stream of polls ``source, id, head, at`` (timestamp); an empty reason is none.

    Polls of a source are compared in the order of their times within a batch, and batches in theirs; event time is
    ``late`` behind the latest poll. ``floor`` also gives rows of the timer (``id`` is null). Sources without a name are one.
    """
    named = polls.select(F.coalesce("source", F.lit("")).alias("source"), F.col("id").cast("long").alias("id"), "head", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    asked = named.withColumn("now", F.unix_millis("at"))
    compared = asked.groupBy("source").transformWithStateInPandas(Decide(stale_ms, floor, each), COMPARED, "append", "EventTime" if floor else "None")
    reason = freshness.sync_reason_ms(F.col("head"), F.col("last"), F.col("then"), F.col("now"), F.lit(stale_ms))
    return compared.select("source", "id", F.col("now").alias("now_ms"), "timer", reason.alias("reason"))


def keep_decisions(polls: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Append the decisions of a stream to a Parquet table; a run that begins again goes on with the states that it had."""
    spark: SparkSession = polls.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # timers and typed states need this store; the query keeps the setting, the session does not
    try:
        return decisions(polls, **how).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
