"""Whether a source has to be read again, and whether what is deployed is what was built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import epoch_ms, filled, rounded

MAX_AGE_MS, AHEAD_MS = 600_000, 60_000


def sync_reason(head: Column, last: Column, generated_at: Column, now_ms: Column, stale_ms: Column) -> Column:
    """Why to synchronise, empty if there is no reason. Ages are compared in milliseconds, not minutes."""
    then = F.coalesce(epoch_ms(generated_at), F.lit(0))
    return _reason(head, last, then, now_ms, stale_ms)


#: The sentences of the reasons.
def _reason(head: Column, last: Column, then: Column, now_ms: Column, stale_ms: Column) -> Column:
    age = now_ms - then
    return (
        F.when(filled(head).isNull(), "")
        .when(filled(last).isNull(), "no prior sync recorded")
        .when(last != head, F.concat(F.lit("upstream advanced "), F.substring(last, 1, 8), F.lit(" -> "), F.substring(head, 1, 8)))
        .when(then == 0, "last sync timestamp unreadable")
        .when(age >= stale_ms, F.concat(F.lit("last sync "), F.floor(age / 60_000).cast("string"), F.lit("m ago exceeded "), rounded(stale_ms / 60_000).cast("string"), F.lit("m budget")))
        .otherwise("")
    )


def sync_reason_ms(head: Column, last: Column, then_ms: Column, now_ms: Column, stale_ms: Column) -> Column:
    """The same for a time that is known in milliseconds already; null or 0 is unreadable."""
    return _reason(head, last, F.coalesce(then_ms, F.lit(0)), now_ms, stale_ms)


def check_status(status: DataFrame, *, expected: Column, now_ms: Column, max_age_ms: int = MAX_AGE_MS, not_before: Column | None = None, http_ok: Column | None = None, http_code: Column | None = None) -> DataFrame:
    """``failure`` (null if none, the first that applies) and ``age_ms`` for rows of headSha and generatedAt."""
    stamp = epoch_ms(F.col("generatedAt"))
    floor = F.lit(None).cast("string") if not_before is None else not_before
    floor_ms = epoch_ms(floor)
    old = filled(floor).isNotNull() & (floor_ms.isNull() | (stamp < floor_ms))
    code = F.lit("") if http_code is None else F.coalesce(http_code.cast("string"), F.lit("nothing"))
    failure = (
        F.when(~F.coalesce(F.lit(True) if http_ok is None else http_ok, F.lit(False)), F.concat(F.lit("status answered HTTP "), code))
        .when(stamp.isNull() | (now_ms - stamp >= max_age_ms) | (stamp > now_ms + AHEAD_MS), F.lit("status stamp is stale or invalid"))
        .when(old, F.lit("status stamp is older than the upload"))
        .when(filled(expected).isNull() | ~F.col("headSha").eqNullSafe(expected), F.concat(F.lit("deployed head "), F.coalesce(filled(F.col("headSha")), F.lit("missing")), F.lit(" differs from expected "), F.coalesce(filled(expected), F.lit("missing"))))
    )
    return status.withColumn("failure", failure).withColumn("age_ms", F.when(failure.isNull(), F.greatest(F.lit(0), now_ms - stamp)))


def deployed_head(status: DataFrame, **check) -> DataFrame:
    """headSha and age_ms of rows that pass; evaluating a row that does not raises its failure."""
    seen = check_status(status, **check)
    return seen.select(F.when(F.col("failure").isNotNull(), F.raise_error(F.col("failure"))).otherwise(F.col("headSha")).alias("headSha"), "age_ms")
