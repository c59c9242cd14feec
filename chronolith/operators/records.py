"""Records by identifier prefix, sparse overrides, and the datasets that a site is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filled
from .shards import with_day

def _hits(records: DataFrame, probes: DataFrame, id_col: str, probe_col: str) -> DataFrame:
    """``prefix, id`` of all matches: an equi-join of each probe with the ids cut to the length of a probe.

    Ids are cut to the lengths that probes have and to no others, so a join key is a whole prefix, however many
    ids begin alike. The lengths are one number for each, of which an id has as many as characters.
    """
    known = records.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    asked = probes.select(F.col(probe_col).alias("prefix")).where("prefix != ''").distinct()
    lengths = asked.agg(F.array_sort(F.collect_set(F.char_length("prefix"))).alias("lengths"))
    cut = known.join(F.broadcast(lengths)).select("id", F.explode("lengths").alias("n")).where(F.char_length("id") >= F.col("n"))
    return asked.join(cut.select("id", F.substring(F.col("id"), F.lit(1), F.col("n")).alias("prefix")), "prefix")


def by_prefix(records: DataFrame, probes: DataFrame, *, id_col: str = "sha", probe_col: str = "prefix") -> DataFrame:
    """Each probe with its matches and ``status``: found, ambiguous or missing. Empty and null probes miss."""
    asked = probes.select(F.col(probe_col).alias("prefix")).distinct()
    found = _hits(records, probes, id_col, probe_col).groupBy("prefix").agg(F.count("id").alias("matches"), F.min("id").alias("first_match"))
    status = F.when(F.col("matches").isNull(), "missing").when(F.col("matches") == 1, "found").otherwise("ambiguous")
    return asked.join(found.withColumnRenamed("prefix", "_p"), F.col("prefix").eqNullSafe(F.col("_p")), "left").drop("_p").select(
        "prefix", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("first_match")).alias("sha"), status.alias("status")
    )


def write_index(records: DataFrame, path: str, *, id_col: str = "sha", row_group_bytes: int = 1 << 20) -> None:
    """The distinct ids as a Parquet table ``id``, sorted in ranges, so that a range of ids lies in few row groups."""
    ids = records.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    ids.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def in_ranges(index: DataFrame, probes: DataFrame, *, probe_col: str = "prefix", most: int = 64) -> DataFrame:
    """The ids of a sorted index that can begin as one of the probes: those in ranges from a probe to the end of its prefix.

    The probes are covered by at most ``most`` ranges, each of probes that are neighbours in order; the driver reads these,
    and the scan skips every row group outside of them. Ids do not hold the last code point, U+10FFFF.
    """
    asked = probes.select(F.col(probe_col).alias("p")).where("p != ''").distinct()
    dealt = asked.repartitionByRange(most, "p").groupBy(F.spark_partition_id().alias("n")).agg(F.min("p").alias("low"), F.max(F.concat("p", F.lit("\U0010FFFF"))).alias("high"))
    bounds = dealt.collect()
    inside = F.lit(False)
    for r in bounds:
        inside = inside | ((F.col("id") >= r["low"]) & (F.col("id") < r["high"]))
    return index.where(inside)


def by_prefix_in(index: DataFrame, probes: DataFrame, *, probe_col: str = "prefix") -> DataFrame:
    """:func:`by_prefix` over an index of :func:`write_index`, of which only the row groups near the probes are read."""
    return by_prefix(in_ranges(index, probes, probe_col=probe_col), probes, id_col="id", probe_col=probe_col)


def _placed(index: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The probes with their first characters, as many as a key has, and the days of each by these."""
    size = index.agg(F.max(F.char_length("key"))).first()[0] or 0
    asked = probes.select("prefix", F.substring("prefix", 1, size).alias("short")).distinct() if size else probes.select("prefix", F.col("prefix").alias("short")).distinct()
    return asked, _hits(index, asked, "key", "short").withColumnRenamed("prefix", "short").join(index.withColumnRenamed("key", "id"), "id").select("short", "day").distinct()


def days_of(index: DataFrame, probes: DataFrame) -> DataFrame:
    """The days that hold an id which begins as one of ``probes`` (column ``prefix``)."""
    return _placed(index, probes)[1].select("day").distinct()


def lookup(records: DataFrame, index: DataFrame, probes: DataFrame, *, id_col: str = "sha") -> DataFrame:
    """``prefix, status, record``: the record that each probe names, null where it is missing or ambiguous.

    ``index`` (see :func:`day_index`) tells the day of each id, so that a table of records partitioned by day is read for
    the days found only. Probes longer than the keys of the index are compared in full with the record's id.
    """
    asked, days = _placed(index, probes)
    some = records.join(F.broadcast(days.select("day").distinct()), "day", "left_semi")
    places = _hits(some, asked, id_col, "prefix")
    one = places.groupBy("prefix").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    row = F.struct(*[F.col(c) for c in records.columns])
    found = some.select(row.alias("record")).withColumn("id", F.col("record").getField(id_col)).groupBy("id").agg(F.max("record").alias("record"))
    named = one.join(found, "id").select(F.col("prefix").alias("_p"), "n", F.when(F.col("n") == 1, F.col("record")).alias("record"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return asked.join(named, F.col("prefix") == F.col("_p"), "left").select("prefix", status.alias("status"), "record")


def as_markdown(title: Column, summary: Column, date: Column, sha: Column) -> Column:
    """A record as a markdown text: title, date and short id, summary; parts without content are left out."""
    head = F.concat(F.lit("# "), F.coalesce(filled(title), sha))
    line = F.concat_ws(" ", filled(date), F.concat(F.lit("`"), F.substring(sha, 1, 12), F.lit("`")))
    return F.concat(F.concat_ws("\n\n", head, line, filled(summary)), F.lit("\n"))


def day_records(entries: DataFrame) -> DataFrame:
    """``day, records, first, last``: number of the records of each day that are no noise, and the first and last by date and sha."""
    place = F.struct("date", "sha")
    shown = with_day(entries.where(~F.coalesce("noise", F.lit(False))))
    return shown.groupBy(F.col("shard").alias("day")).agg(F.count(F.lit(1)).alias("records"), F.min_by("sha", place).alias("first"), F.max_by("sha", place).alias("last"))


def effective(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Records as shown: override fields (sha, title, summary, note, noise) before those of ``ai`` before their own."""
    named = overrides.select(F.col("sha").alias("_sha"), *[F.col(c).alias(f"_{c}") for c in ("title", "summary", "note", "noise") if c in overrides.columns])
    joined = entries.join(named, F.col("sha") == F.col("_sha"), "left")
    has = set(joined.columns)

    def pick(field: str, ai: bool = True) -> Column:
        parts = [F.col(f"_{field}")] if f"_{field}" in has else []
        return F.coalesce(*parts, *([filled(F.col("ai")[field])] if ai else []), F.col(field))

    shown = {"title": pick("title"), "summary": pick("summary"), "noise": pick("noise", False)}
    if "_note" in has:
        shown["note"] = F.col("_note")
    return joined.withColumns(shown).select(*entries.columns, *[c for c in shown if c not in entries.columns])


def draft(entries: DataFrame, sha: Column) -> DataFrame:
    """What an override of a record starts from: the values shown today, plain words flattened."""
    return entries.where(F.col("sha") == sha).select("sha", F.coalesce(filled(F.col("ai.title")), F.col("title")).alias("title"), F.coalesce(filled(F.col("ai.summary")), F.col("summary")).alias("summary"), F.col("eli5.text").alias("eli5"))


def put_override(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields of ``changes`` over those stored, by sha; a null field leaves what is stored."""
    names = list(dict.fromkeys([*overrides.columns, *changes.columns]))
    both = overrides.withColumn("_turn", F.lit(0)).unionByName(changes.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    fields = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_turn"))).alias(c) for c in names if c != "sha"]
    return both.groupBy("sha").agg(*fields)


def clear_override(overrides: DataFrame, cleared: DataFrame) -> DataFrame:
    return overrides.join(cleared.select("sha").distinct(), "sha", "left_anti")


def between(records: DataFrame, first: str, last: str, day_col: str = "day") -> DataFrame:
    """Records of a range of days, both included; prunes partitions of a table that is partitioned by day."""
    return records.where(F.col(day_col).between(first, last))


def feed(entries: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` records as feed rows."""
    order = [F.col("date").desc_nulls_last(), F.col("sha").desc_nulls_last()]
    return entries.where(~F.coalesce("noise", F.lit(False))).orderBy(*order).limit(n).select(F.col("sha").alias("id"), "date", "title", F.coalesce(filled(F.col("eli5.text")), F.col("summary")).alias("summary"))


def day_index(entries: DataFrame) -> DataFrame:
    """``key, day``: the first 12 characters of every sha, for lookups that read one partition."""
    return entries.select(F.substring("sha", 1, 12).alias("key"), "day").distinct()
