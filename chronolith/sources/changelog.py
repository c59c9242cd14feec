"""The store of change records: a manifest and records by day.

Two layouts lie in ``<root>/changelog/`` beside the manifest ``<root>/changelog.json``, also mixed: partitions
``shard=<day>/`` of JSON rows, of which a large day has several files (the one that scales), and files ``<day>.json`` of
one ``{day, entries}`` object each, for other readers. A manifest with inline entries is a store of its own.

A save stages its rows and a plan of what to do, below ``<root>/pending``; then it replaces the days that change
in either layout, removes vanished ones, and writes the manifest last. A save that was cut off before the plan
was complete has changed nothing; one that was cut off later is finished by the next save or :func:`recover`. There
is one writer at a time. Entries keep fields that the schema does not know (see ``entries``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import records, shards
from ..operators.upsert import latest_wins
from ..schemas import DOCUMENT, ENTRY, MANIFEST
from . import dayfiles
from .entries import MORE, OPEN_ENTRY, as_text, as_variant, opened, row_text, with_more

MANIFEST_NAME = "changelog.json"
DIGESTS = "digests"
#: Where each record lies: ``sha, shard`` by a bucket of the sha. :func:`merge` keeps it, :func:`save` drops it.
INDEX = "index"
PENDING = "pending"
PARTITIONS, FILES = "partitions", "files"
CORRUPT = "_corrupt_record"
#: Records of a day that one task writes; a larger day becomes several files.
FILE_RECORDS = 100_000


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, one per day in that of the shards; none if it is not there."""
    fs, jpath = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []


def _manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest as an object; None if there is none or it can't be read. The driver reads it whole."""
    path = f"{root}/{MANIFEST_NAME}"
    text = spark.read.text(path, wholetext=True).first() if exists(spark, path) else None
    try:
        fields = json.loads(text[0]) if text else None
    except ValueError:
        return None
    return fields if isinstance(fields, dict) else None


def manifest_fields(spark: SparkSession, root: str) -> dict:
    """All fields of the manifest, those that the schema does not know included, without inline entries."""
    return {k: v for k, v in (_manifest(spark, root) or {}).items() if k != "entries"}


def read_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The manifest alone, without touching a shard; None if there is none."""
    path = f"{root}/{MANIFEST_NAME}"
    return spark.read.schema(MANIFEST).json(path) if exists(spark, path) else None


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A document in one JSON file, with inline entries or without (then ``entries`` is null)."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def _objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``entries`` of files of one JSON object each, as variants, and the text of those that can't be read."""
    schema = f"day string, entries array<variant>, {CORRUPT} string"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(paths)


def _open_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return opened(_objects(spark, paths).where("entries is not null").select(F.explode("entries").alias("_entry")), "_entry")


def read_shard_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries of files of one ``{day, entries}`` object each; files that can't be read that way give none."""
    return _open_objects(spark, path)


def _layouts(spark: SparkSession, root: str) -> dict[str, dict[str, str]]:
    """The days that are stored in each layout, with the names that they have in the folder of shards."""
    names = names_in(spark, f"{root}/{shards.SHARD_DIR}")
    days = {dayfiles.file_name(n[:-5]): n for n in names if n.endswith(".json")}
    return {PARTITIONS: {_unescaped(spark, n[6:]): n for n in names if n.startswith("shard=")}, FILES: {dayfiles.day_of(n): n for n in days.values()}}


def _partition_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all partitions with ``shard``; the scan lists every folder and reads those that a plan asks for."""
    table = f"{root}/{shards.SHARD_DIR}"
    return spark.read.schema("value string, shard string").option("pathGlobFilter", "*.json").option("basePath", table).text(f"{table}/shard=*")


def _parsed() -> F.Column:
    """The entry of a line, with the line in ``_corrupt_record`` if it is none."""
    return F.from_json("value", T.StructType([*OPEN_ENTRY.fields, T.StructField(CORRUPT, T.StringType())]), {"columnNameOfCorruptRecord": CORRUPT})


def stored_entries(spark: SparkSession, root: str, days: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """The records of all shards with their ``shard``, in no order, from both layouts. Lines and files that can't be read
    give none (see :func:`broken`).

    ``days``, or the range from ``first`` to ``last`` (both included), leaves all other folders and files unread. A
    filter on ``shard``, also by a join, prunes partitions as well.
    """
    layouts = _layouts(spark, root)
    wanted = lambda d: (days is None or d in set(days)) and (first is None or d >= first) and (last is None or d <= last)
    found = spark.createDataFrame([], OPEN_ENTRY).withColumn("shard", F.lit(""))
    if layouts[PARTITIONS]:
        rows = _partition_lines(spark, root)
        if days is not None:
            rows = rows.where(F.col("shard").isin(list(days)))
        rows = rows.where(F.col("shard") >= first) if first is not None else rows
        rows = rows.where(F.col("shard") <= last) if last is not None else rows
        # Through a generator, so that a line is parsed once and not by a filter and a projection each.
        good = F.filter(F.array(_parsed()), lambda e: e.isNotNull() & e[CORRUPT].isNull())
        found = rows.select("shard", F.inline(good)).select(*OPEN_ENTRY.names, "shard")
    if chosen := sorted(n for d, n in layouts[FILES].items() if wanted(d)):
        table = f"{root}/{shards.SHARD_DIR}"
        paths = f"{table}/*.json" if len(chosen) == len(layouts[FILES]) else [f"{table}/{n}" for n in chosen]
        found = found.unionByName(shards.with_day(_open_objects(spark, paths)))
    return found


def broken(spark: SparkSession, root: str) -> DataFrame:
    """``path, _corrupt_record``: the lines and files of the shards that can't be read."""
    layouts, table = _layouts(spark, root), f"{root}/{shards.SHARD_DIR}"
    path = F.col("_metadata.file_path").alias("path")
    found = spark.createDataFrame([], f"path string, {CORRUPT} string")
    if layouts[PARTITIONS]:
        found = _partition_lines(spark, root).where(_parsed().isNull() | _parsed()[CORRUPT].isNotNull()).select(path, F.col("value").alias(CORRUPT))
    if layouts[FILES]:
        whole = spark.read.text(f"{table}/*.json", wholetext=True)
        unread = F.from_json("value", f"entries array<variant>, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})[CORRUPT]
        found = found.unionByName(whole.where(unread.isNotNull()).select(path, F.col("value").alias(CORRUPT)))
    return found


def load(spark: SparkSession, root: str, first: str | None = None, last: str | None = None) -> DataFrame | None:
    """All records: None without a manifest or with one that can't be read, those of a document with inline entries as they
    are, else those of the shards in canonical order, of the days from ``first`` to ``last`` only if those are given."""
    path = f"{root}/{MANIFEST_NAME}"
    if not exists(spark, path):
        return None
    if _objects(spark, path).select("entries", "day").where("entries is not null").limit(1).count():
        return load_document(spark, path)
    if _manifest(spark, root) is None:
        return None
    return shards.canonical_sort(stored_entries(spark, root, None, first, last).drop("shard"))


def find(spark: SparkSession, root: str, probes: DataFrame, probe_col: str = "prefix") -> DataFrame:
    """``prefix, status, record`` (see ``records.lookup``) from the days that hold a match, and from no others.

    The index tells the days; the driver reads their names, as the plan lists their folders and files.
    """
    asked = probes.select(F.col(probe_col).alias("prefix"))
    index = _where(spark, root, None).select(F.col("sha").alias("key"), F.col("shard").alias("day"))
    days = records.days_of(index, asked).distinct().collect()
    rows = stored_entries(spark, root, sorted(r[0] for r in days)).drop("day").withColumnRenamed("shard", "day")
    return records.lookup(as_text(rows), index, asked)


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """Records of a document with inline entries, as they are (unsorted)."""
    return _open_objects(spark, path)


def _known_digests(spark: SparkSession, root: str) -> dict[str, dict]:
    """What was last written of each day: digest, number of records and, of a file, its stamp. One row a day."""
    path = f"{root}/{DIGESTS}"
    kind = "shard string, digest string, entries long, stamp string"
    return {r["shard"]: r.asDict() for r in spark.read.schema(kind).json(path).collect()} if exists(spark, path) else {}


def _stamps(spark: SparkSession, root: str) -> dict[str, str]:
    """Size and time of each file of a day, by which a file that another writer replaced is known."""
    fs, jpath = _fs(spark, f"{root}/{shards.SHARD_DIR}")
    if not fs.exists(jpath):
        return {}
    found = [s for s in fs.listStatus(jpath) if s.getPath().getName().endswith(".json")]
    return {dayfiles.day_of(s.getPath().getName()): f"{s.getLen()}:{s.getModificationTime()}" for s in found}


def _staged(spark: SparkSession, root: str, rows: DataFrame) -> dict[str, tuple[str, int]]:
    """Stage rows with their hashes, so that they are made once; digest and number of records of each day."""
    path = f"{root}/{PENDING}/rows"
    rows.withColumn("_row", row_text()).select(*rows.columns, *shards.hashes(F.col("_row"))).write.mode("overwrite").parquet(path)
    return {r["shard"]: (r["digest"], r["entries"]) for r in shards.combined(spark.read.schema("shard string, h long, g long").parquet(path)).collect()}


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save(spark: SparkSession, root: str, entries: DataFrame, manifest: dict, layout: str = PARTITIONS) -> dict[str, list[str]]:
    """Write records by day in ``layout``; returns the shards by action. Fields of ``manifest`` pass through, known or not, except
    that its entries are dropped, its layout is set and its number of entries is recounted; other counts stay.

    A day is kept if it has the content that was last written and lies in this layout alone; every other day of the
    records is written, and every day that they do not have is removed, whichever layout it lies in. The driver reads
    the list of days, one row each.
    """
    recover(spark, root)
    full = shards.with_day(with_more(entries))
    new, known, layouts, stamps = _staged(spark, root, full), _known_digests(spark, root), _layouts(spark, root), _stamps(spark, root)
    stored = set(layouts[PARTITIONS]) | set(layouts[FILES])
    other = layouts[FILES if layout == PARTITIONS else PARTITIONS]

    def same(day: str) -> bool:
        last = known.get(day)
        return last is not None and last["digest"] == new[day][0] and day in layouts[layout] and day not in other and (layout == PARTITIONS or last["stamp"] == stamps.get(day))

    actions: dict[str, list[str]] = {"keep": [], "rewrite": [], "write": [], "delete": sorted(stored - set(new))}
    for day in sorted(new):
        actions["write" if day not in stored else "keep" if same(day) else "rewrite"].append(day)
    changed = actions["write"] + actions["rewrite"]
    counts = {**(manifest.get("counts") or {}), "entries": sum(n for _, n in new.values())}
    plan = {
        "layout": layout, "changed": changed, "delete": actions["delete"], "index": None,
        "digests": {d: [*new[d]] for d in sorted(new)}, "manifest": {**{k: v for k, v in manifest.items() if k != "entries"}, "layout": shards.LAYOUT, "counts": counts},
    }
    _settle(spark, root, plan)
    _apply(spark, root, plan)
    return actions


def _settle(spark: SparkSession, root: str, plan: dict) -> None:
    """Write the plan beside the rows; until that is there, nothing has happened."""
    _put_text(spark, f"{root}/{PENDING}/plan.tmp", json.dumps(plan, ensure_ascii=False))
    fs, jpath = _fs(spark, f"{root}/{PENDING}/plan.tmp")
    fs.rename(jpath, _fs(spark, f"{root}/{PENDING}/plan")[1])


def recover(spark: SparkSession, root: str) -> bool:
    """Finish a save that was cut off after its plan was written; what was staged without a plan is dropped."""
    path = f"{root}/{PENDING}"
    found = exists(spark, f"{path}/plan")
    if found:
        _apply(spark, root, json.loads(spark.read.text(f"{path}/plan", wholetext=True).first()[0]))
    elif exists(spark, path):
        delete(spark, path)
    return found


def _apply(spark: SparkSession, root: str, plan: dict) -> None:
    """Carry out a plan from what was staged; doing it again from the start gives the same."""
    table, pending, changed = f"{root}/{shards.SHARD_DIR}", f"{root}/{PENDING}", plan["changed"]
    if changed:
        pieces = spark.createDataFrame([(d, -(-plan["digests"][d][1] // FILE_RECORDS)) for d in changed], "shard string, pieces long")
        staged = spark.read.parquet(f"{pending}/rows").select(*OPEN_ENTRY.names, "shard")
        rows = staged.join(F.broadcast(pieces) if len(changed) <= 10_000 else pieces, "shard")
        rows = rows.withColumn("_piece", F.pmod(F.xxhash64("sha", "date"), F.col("pieces"))).drop("pieces")
        order = ["shard", *shards.canonical_order()]
        if plan["layout"] == PARTITIONS:
            out = rows.repartition("shard", "_piece").sortWithinPartitions(*order).drop("_piece")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").json(table)
        else:
            rows = rows.repartition("shard").sortWithinPartitions(*order)
            dayfiles.write(rows.select("shard", F.to_json(F.struct(*ENTRY.names)).alias("typed"), F.to_json(MORE).alias("more")), table)
    layouts = _layouts(spark, root)
    for day in plan["delete"]:
        for names in layouts.values():
            if day in names:
                delete(spark, f"{table}/{names[day]}")
    for day in changed:
        other = layouts[FILES if plan["layout"] == PARTITIONS else PARTITIONS]
        if day in other:
            delete(spark, f"{table}/{other[day]}")
    if plan["index"]:
        moved = spark.read.parquet(f"{pending}/index")
        moved.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/{INDEX}")
    elif changed or plan["delete"]:
        delete(spark, f"{root}/{INDEX}")
    stamps = _stamps(spark, root)
    kind = "shard string, digest string, entries long, stamp string"
    spark.createDataFrame([(d, *x, stamps.get(d)) for d, x in plan["digests"].items()], kind).coalesce(1).write.mode("overwrite").json(f"{root}/{DIGESTS}")
    path = f"{root}/{MANIFEST_NAME}"
    if names_in(spark, path) == [MANIFEST_NAME]:  # one file, as another writer leaves it
        delete(spark, path)
    _put_text(spark, path, json.dumps(plan["manifest"], ensure_ascii=False))
    delete(spark, pending)


def _bucket(sha) -> F.Column:
    return F.coalesce(F.substring(F.md5(sha), 1, 2), F.lit("none"))


def _where(spark: SparkSession, root: str, rows: DataFrame | None) -> DataFrame:
    """``bucket, sha, shard`` of the buckets that ``rows`` fall into, or of all; built from the store where there is none yet."""
    path = f"{root}/{INDEX}"
    if not exists(spark, path):
        placed = stored_entries(spark, root).select(_bucket(F.col("sha")).alias("bucket"), "sha", "shard")
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    index = spark.read.schema("sha string, shard string, bucket string").parquet(path)
    if rows is None:
        return index
    buckets = [r[0] for r in rows.select(_bucket(F.col("sha"))).distinct().collect()]  # 257 at most
    return index.where(F.col("bucket").isin(buckets))


def merge(spark: SparkSession, root: str, batch: DataFrame, manifest: dict, layout: str = PARTITIONS) -> dict[str, list[str]]:
    """Merge records into the store by sha, those of ``batch`` winning; returns the touched shards by action.

    Only the days that the batch has records of and those that held its shas until now are read, and of these only those
    that change are written, so the work follows the batch and not the store. An index tells where each sha lies; it is
    read and written by the buckets that the batch falls into. A batch that is merged again changes nothing. The driver
    reads the touched days, and one row for each day of the store of what was last written.
    """
    recover(spark, root)
    fresh, staged = as_text(with_more(batch)), f"{root}/{PENDING}/batch"
    latest_wins(fresh.limit(0), fresh, "sha").write.mode("overwrite").parquet(staged)  # a batch may be costly to read twice
    fresh = spark.read.parquet(staged)
    index = _where(spark, root, fresh)
    placed = fresh.select("sha").join(index.withColumnRenamed("sha", "_sha"), F.col("sha").eqNullSafe(F.col("_sha"))).select("shard")
    days = sorted(r[0] for r in placed.union(shards.with_day(fresh).select("shard")).distinct().collect())
    old = as_text(stored_entries(spark, root, days).drop("shard"))
    merged = shards.with_day(as_variant(latest_wins(old, fresh, "sha")))
    new, known, layouts = _staged(spark, root, merged), _known_digests(spark, root), _layouts(spark, root)
    stored = {d for names in layouts.values() for d in names}
    actions: dict[str, list[str]] = {"keep": [], "rewrite": [], "write": [], "delete": sorted((set(days) & stored) - set(new))}
    for day in sorted(new):
        actions["write" if day not in stored else "keep" if known.get(day, {}).get("digest") == new[day][0] else "rewrite"].append(day)
    changed = actions["write"] + actions["rewrite"]
    digests = {d: [x["digest"], x["entries"]] for d, x in known.items() if d not in actions["delete"]} | {d: [*x] for d, x in new.items()}
    counts = {**(manifest.get("counts") or {}), "entries": sum(n for _, n in digests.values())}
    plan = {
        "layout": layout, "changed": changed, "delete": actions["delete"], "index": True, "digests": digests,
        "manifest": {**{k: v for k, v in manifest.items() if k != "entries"}, "layout": shards.LAYOUT, "counts": counts},
    }
    moved = shards.with_day(fresh).select(_bucket(F.col("sha")).alias("bucket"), "sha", "shard")
    stay = index.join(fresh.select(F.col("sha").alias("_sha")), F.col("sha").eqNullSafe(F.col("_sha")), "left_anti").select("bucket", "sha", "shard")
    stay.unionByName(moved).write.mode("overwrite").parquet(f"{root}/{PENDING}/index")
    _settle(spark, root, plan)
    _apply(spark, root, plan)
    return actions


def _unescaped(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(value)


def stored_bytes(spark: SparkSession, root: str) -> int:
    """Bytes of the manifest and of all shard files, of whatever name; 0 where there is nothing."""
    total = 0
    for name in (MANIFEST_NAME, shards.SHARD_DIR):
        path = f"{root}/{name}"
        if exists(spark, path):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            total += files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return total
