"""Each operator on a table whose columns play the part of a change record's."""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compact_number, day_key, one_decimal, size_text
from ..operators import budgets, freshness, keyversions, patches, records, shards, stories, upsert
from ..session import scratch
from ..settings import AssetLimits
from ..sources import changelog, services
from ..sources.entries import opened
from ..streaming import decisions

TEXT_BYTES = F.octet_length


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _ms(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def shard_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Events as records: partition key, records and bytes per day."""
    events = _table(spark, sf, "events").select(F.lit(None).cast("string").alias("day"), _stamp(F.col("ts")).alias("date"), "props")
    return shards.shard_summary(events, F.octet_length("props"))


def day_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The partition key where day, date or both are missing or empty."""
    events = _table(spark, sf, "events")
    k = F.col("event_id") % 4
    day = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, "")
    date = F.when(k < 3, _stamp(F.col("ts")))
    return events.select("event_id", day_key(day, date).alias("shard"))


def canonical_sort(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 of the events in canonical order, a report of the head; :func:`canonical_ranks` has all."""
    events = _table(spark, sf, "events").select(_stamp(F.col("ts")).alias("date"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("sha"))
    return shards.ranked(events, 100)


def canonical_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """All events with their place in canonical order; :func:`canonical_sort` is its head."""
    events = _table(spark, sf, "events").select(_stamp(F.col("ts")).alias("date"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("sha"))
    return shards.ranked_all(events)


def shard_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What a save would do, between two states of the events: some days cut, one edited."""
    events = _table(spark, sf, "events").withColumn("shard", F.date_format("ts", "yyyy-MM-dd")).withColumn("n", F.dayofmonth("ts"))
    row = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    old = shards.digests(events.where("n <= 18"), row)
    edited = F.when((F.col("n") == 5) & (F.col("event_id") % 7 == 0), F.concat(row, F.lit("*"))).otherwise(row)
    return shards.shard_changes(old, shards.digests(events.where("n >= 3"), edited))


def legacy_migrate(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as inline entries of a document per conversation, and back."""
    turns = _table(spark, sf, "conversations")
    documents = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("entries"))
    return shards.inline_entries(documents.where(shards.is_legacy(documents)), "conv_id")


def size_budget(spark: SparkSession, sf: str) -> DataFrame:
    listing = _table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.octet_length("text").alias("bytes"))
    return budgets.over_budget(listing, warn=8000, most=20000).select(F.col("path").alias("doc_id"), "bytes", "bucket", "rank")


def size_texts(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text")
    return _table(spark, sf, "documents").select("doc_id", size_text(size).alias("mib"), F.concat(one_decimal(size / F.lit(1024.0)), F.lit(" KiB")).alias("kib"))


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), (F.octet_length("text") * 2048).cast("long").alias("bytes"))


def dist_budget(spark: SparkSession, sf: str) -> DataFrame:
    reading = budgets.verdict(budgets.read_assets(_listing(spark, sf), AssetLimits(1200, 900, 300)))
    return reading.select("count", "bytes", "largest", "largest_bytes", "n_oversized", "over_cap", "over_budget", "tight_margin", "verdict")


def dist_message(spark: SparkSession, sf: str) -> DataFrame:
    limits = AssetLimits(1200, 900, 300)
    return budgets.message(budgets.read_assets(_listing(spark, sf), limits), limits).select("verdict", "message")


def retention(spark: SparkSession, sf: str) -> DataFrame:
    listing = _table(spark, sf, "orders").select(F.col("o_orderdate").alias("date"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"))
    return budgets.retained(listing, 900).select("path")


def retention_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as files of a date: which stay within a number of files and of bytes, with the sums that say so."""
    path = F.concat_ws("/", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    listing = _table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("date"), path.alias("path"), F.col("l_quantity").cast("long").alias("bytes"))
    return budgets.retention_plan(listing, files=25_000, size=500_000).select("path", "place", "running", "kept")


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of all shapes: 40 digits with a version of either kind, without one, and others."""
    sha = F.concat(F.md5(F.col("doc_id").cast("string")), F.substring(F.md5(F.concat(F.lit("x"), F.col("doc_id").cast("string"))), 1, 8))
    v = (F.col("doc_id") % 15).cast("string")
    k = F.col("doc_id") % 4
    key = F.when(k == 0, F.concat(sha, F.lit(":v"), v, F.lit(":h"))).when(k == 1, F.concat(sha, F.lit(":eli5:v"), v, F.lit(":h"))).when(k == 2, F.concat(sha, F.lit(":h"))).otherwise(F.concat(F.lit("rollup:"), v))
    return _table(spark, sf, "documents").select("doc_id", sha.alias("sha"), key.alias("key"))


def cache_prune(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("key")
    return _cache(spark, sf).select("key", keyversions.version_kind(key).alias("kind"), keyversions.version_number(key).cast("long").alias("v"), keyversions.is_stale(key).alias("stale"))


def keep_list_prune(spark: SparkSession, sf: str) -> DataFrame:
    cache = _cache(spark, sf)
    keep = cache.join(_table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id").select("sha")
    return keyversions.mark(cache.select("key"), keep).select("key", "stale", "removed")


def refresh_queue(spark: SparkSession, sf: str) -> DataFrame:
    return keyversions.to_refresh(_cache(spark, sf).select("key"))


def sync_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Each event against the one before of the same user; a window per user."""
    from pyspark.sql import Window

    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    head = F.md5(F.col("event_type"))
    events = _table(spark, sf, "events").select("event_id", head.alias("head"), F.lag(head).over(before).alias("last"), F.lag(_ms(F.col("ts"))).over(before).alias("then"), _ms(F.col("ts")).alias("now"))
    return events.select("event_id", freshness.sync_reason_ms(F.col("head"), F.col("last"), F.col("then"), F.col("now"), F.lit(300 * 60_000)).alias("reason"))


def status_check(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each type as a status, the last of all as now."""
    events = _table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    last = events.groupBy("event_type").agg(F.max("ts").alias("ts"))
    now = last.agg(_ms(F.max("ts")).alias("now"))
    status = last.crossJoin(F.broadcast(now)).select("event_type", F.md5("event_type").alias("headSha"), _stamp(F.col("ts")).alias("generatedAt"), "now")
    checked = freshness.check_status(status, expected=F.md5("event_type"), now_ms=F.col("now"), max_age_ms=1_800_000)
    return checked.select("event_type", "failure", "age_ms")


def traffic_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping batches of a daily series; the second counts only every other event."""
    events = _table(spark, sf, "events").withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd")).withColumn("n", F.dayofmonth("ts"))
    agg = [F.count("event_id").alias("count"), F.count_distinct("user_id").alias("uniques")]
    old = events.where("n <= 20").groupBy("timestamp").agg(*agg)
    new = events.where("n >= 15 and event_id % 2 = 0").groupBy("timestamp").agg(*agg)
    return upsert.latest_wins(old, new, "timestamp")


def story_links(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a day that share a part; those of status P are noise."""
    orders = _table(spark, sf, "orders").where("o_orderstatus != 'P'").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    paths = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("path")).join(orders, "o_orderkey")
    sides = paths.select("day", "path", F.col("o_orderkey").alias("sha"))
    return stories.link(sides, sides).where("sha < peer")


def prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    known = _table(spark, sf, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("sha"))
    asked = _table(spark, sf, "customer").select(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 3 + (F.col("c_custkey") % 4).cast("int")).alias("prefix"))
    return records.by_prefix(known, asked)


def prefix_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`prefix_lookup` by ranges over an index that is sorted by id; probes of the first customers, all in one stretch of ids."""
    path = scratch(spark, "ids")
    records.write_index(_table(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("sha")), path, row_group_bytes=1 << 16)
    asked = _table(spark, sf, "customer").select(F.substring(F.lpad(F.col("c_custkey").cast("string"), 12, "0"), 1, 11 + (F.col("c_custkey") % 2).cast("int")).alias("prefix"))
    return records.by_prefix_in(spark.read.schema("id string").parquet(path), asked)


def override_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of toxic documents as overrides of some fields."""
    docs = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sha"), F.concat(F.lit("own "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("summary"), F.struct(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ai "), F.col("lang"))).alias("title"), F.when(F.col("doc_id") % 5 == 0, F.lit("")).alias("summary")).alias("ai"), F.lit(False).alias("noise"))
    over = _table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("sha"), F.when(F.col("doc_id") % 2 == 0, "corrected").alias("title"), F.lit("was wrong").alias("note"), F.when(F.col("quality") == 0, True).alias("noise"))
    return records.effective(docs, over).select("sha", "title", "summary", "note", "noise")


def override_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Overrides of the documents of even labels, changed by those of bad quality, cleared for the toxic ones: what an edit of
    each document then begins from, beside what is stored."""
    sha = F.col("doc_id").cast("string").alias("sha")
    labels = _table(spark, sf, "labels")
    stored = labels.where("doc_id % 2 = 0").select(sha, F.lit("stored").alias("title"), F.when(F.col("doc_id") % 4 == 0, "kept").alias("note"))
    changes = labels.where("quality = 0").select(sha, F.when(F.col("doc_id") % 3 == 0, "changed").alias("title"), F.lit(True).alias("noise"))
    left = records.clear_override(records.put_override(stored, changes), labels.where("toxic = 1").select(sha))
    docs = _table(spark, sf, "documents").select(sha, F.concat(F.lit("own "), sha).alias("title"), F.col("lang").alias("summary"), F.struct(F.when(F.col("doc_id") % 5 == 0, "by model").alias("title"), F.lit("").alias("summary")).alias("ai"), F.struct(F.col("source").alias("text")).alias("eli5"))
    begun = records.draft(docs, F.col("sha")).withColumnsRenamed({"title": "begins", "summary": "text"})
    return begun.join(left, "sha", "left").select("sha", "begins", "text", "eli5", "title", "note", "noise")


def size_reading(spark: SparkSession, sf: str) -> DataFrame:
    """The line that a series of readings gets of the documents as files, written and read back."""
    path = scratch(spark, "readings")
    services.append_reading(spark, path, _listing(spark, sf), "2026-01-01T00:00:00Z", warn=8_000_000, most=20_000_000)
    return spark.read.schema("ts string, sizeKiB long, dataFiles long, overBudget long, nearBudget long").json(path)


def commits_week(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the seven days before the 20th of the month in which they begin, for each type."""
    events = _table(spark, sf, "events").select(_stamp(F.col("ts")).alias("date"), "event_type")
    first = _table(spark, sf, "events").agg(F.min("ts")).first()[0]
    now = int(first.replace(day=20, hour=0, minute=0, second=0, microsecond=0, tzinfo=timezone.utc).timestamp() * 1000)
    found = [services.commits_since(events.where(F.col("event_type") == t), now).select(F.lit(t).alias("event_type"), "count") for t in ("click", "view", "purchase")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def store_status(spark: SparkSession, sf: str) -> DataFrame:
    """The row of state after two saves of events, the second one without those of the first days."""
    root, events = scratch(spark, "store"), _events_as_entries(spark, sf)
    for part in (events, events.where("n > 9")):
        changelog.save(spark, root, _opened(part), {**_META, "counts": {"changes": 7}})
    manifest = changelog.read_manifest(spark, root)
    return manifest.select("headSha", "layout", F.col("counts")["entries"].alias("entries"), F.col("counts")["changes"].alias("changes")).withColumn("days", F.lit(len(changelog._layouts(spark, root)["partitions"])))


def day_range(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    bounds = events.agg(F.min("day"), F.max("day")).first()
    return records.between(events, bounds[0], bounds[0][:8] + "09").groupBy("day").agg(F.count("event_id").alias("events"))


def feed_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("sha"), _stamp(F.col("ts")).alias("date"), F.col("event_type").alias("title"), F.struct(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("").alias("text")).alias("eli5"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("summary"), (F.col("event_type") == "view").alias("noise"))
    return records.feed(events, 50)


def compact_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "orders").select("o_orderkey", compact_number((F.col("o_totalprice") * 1).cast("long")).alias("short"))


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    """A diff per order: a file per line item, added, removed or modified, with a hunk of two to four lines."""
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    path = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".ts"))
    k = F.col("q") % 3
    old_len, new_len = F.when(k == 0, 0).otherwise(2), F.when(k == 1, 0).otherwise(2)
    start = F.col("q").cast("string")
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.when(k == 0, "\nnew file mode 100644").when(k == 1, "\ndeleted file mode 100644").otherwise(""), F.lit("\nindex 0123456..789abcd"), F.when(k == 2, " 100644").otherwise(""))
    sides = F.concat(F.lit("\n--- "), F.when(k == 0, "/dev/null").otherwise(F.concat(F.lit("a/"), path)), F.lit("\n+++ "), F.when(k == 1, "/dev/null").otherwise(F.concat(F.lit("b/"), path)))
    hunk = F.concat(F.lit("\n@@ -"), start, F.lit(","), old_len.cast("string"), F.lit(" +"), start, F.lit(","), new_len.cast("string"), F.lit(" @@ at "), start)
    body = F.when(k == 0, "\n+one\n++++ two").when(k == 1, "\n-one\n--- two").otherwise(F.concat(F.lit("\n-  \"version\": \"1."), start, F.lit("\"\n+  \"version\": \"2."), start, F.lit("\"\n same")))
    part = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey"), F.col("q"), F.concat(head, sides, hunk, body).alias("t"))
    parts = F.array_sort(F.collect_list(part))
    return rows.groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.concat(F.array_join(F.transform(parts, lambda x: x["t"]), "\n"), F.lit("\n")).alias("body"))


def patch_files(spark: SparkSession, sf: str) -> DataFrame:
    out = patches.files(patches.sections(_diffs(spark, sf)))
    return out.select("key", "file_no", "old_path", "new_path", "status", "mode", "additions", "deletions", "hunks")


def patch_hunks(spark: SparkSession, sf: str) -> DataFrame:
    return patches.hunks(patches.sections(_diffs(spark, sf))).select("key", "file_no", "hunk_no", "old_start", "old_len", "new_start", "new_len", "context_of", "added", "removed", "context", "reconciles")


def patch_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = patches.entry_stats(patches.files(patches.sections(_diffs(spark, sf))))
    return out.select("key", F.col("stats.additions").alias("additions"), F.col("stats.deletions").alias("deletions"), F.col("files.total").alias("total"), F.size("files.added").alias("n_added"), F.size("files.removed").alias("n_removed"), F.size("files.modified").alias("n_modified"))


def version_bumps(spark: SparkSession, sf: str) -> DataFrame:
    return patches.version_bumps(patches.placed(_diffs(spark, sf)))


def hunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as texts whose lines beginning with a capital T begin a section."""
    from pyspark.sql import Window

    lines = patches.lines_of(_table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("body")))
    order = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("section", F.sum(F.col("text").startswith("T").cast("int")).over(order))
    return numbered.groupBy("key").agg(F.count("line_no").alias("lines"), F.max("section").alias("sections"), F.max(F.when(F.col("section") == 0, F.col("line_no"))).alias("last_before"))


def line_classify(spark: SparkSession, sf: str) -> DataFrame:
    lines = patches.lines_of(_table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("body")))
    first = F.substring("text", 1, 1)
    kind = F.when(first.isin("A", "E", "I", "O", "U"), "vowel").when(first == "", "empty").otherwise("other")
    return lines.groupBy("key", kind.alias("kind")).agg(F.count("line_no").alias("lines"))


def _header_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """A diff per order of what :func:`_diffs` has not: renames with and without edits, binary files, modes, submodules,
    links, omitted lengths and missing line ends, by quantity."""
    q = F.col("l_quantity").cast("int")
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("q"))
    name, n = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.col("q").cast("string")
    k = F.col("q") % 6
    to = F.when(k < 2, F.concat(F.lit("moved/"), name)).otherwise(name)
    blobs = F.concat(F.lit("\nindex "), F.substring(F.md5(n), 1, 9), F.lit(".."), F.substring(F.md5(F.concat(n, F.lit("x"))), 1, 9))
    sides = F.concat(F.lit("\n--- a/"), name, F.lit("\n+++ b/"), to)
    renamed = F.concat(F.lit("\nrename from "), name, F.lit("\nrename to "), to)
    short = F.concat(F.lit("\n@@ -"), n, F.lit(" +"), n, F.lit(" @@"))
    body = (
        F.when(k == 0, F.concat(F.lit("\nsimilarity index 100%"), renamed))
        .when(k == 1, F.concat(F.lit("\nsimilarity index 9"), F.substring(n, 1, 1), F.lit("%"), renamed, blobs, F.lit(" 100644"), sides, short, F.lit("\n-rename from x\n+rename to y")))
        .when(k == 2, F.concat(blobs, F.lit(" 100644\nBinary files a/"), name, F.lit(" and b/"), name, F.lit(" differ")))
        .when(k == 3, F.concat(F.lit("\nold mode 100644\nnew mode 100755"), blobs, sides, short, F.lit("\n-one\n\\ No newline at end of file\n+new file mode 1\n\\ No newline at end of file")))
        .when(k == 4, F.concat(blobs, F.lit(" 160000"), sides, short, F.lit("\n-Subproject commit 1\n+Subproject commit 2")))
        .otherwise(F.concat(F.lit("\nnew file mode 120000"), blobs, F.lit("\n--- /dev/null\n+++ b/"), name, F.lit("\n@@ -0,0 +1 @@\n+target\n\\ No newline at end of file")))
    )
    text = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), to, body)
    parts = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey"), F.col("q"), text.alias("t"))))
    return rows.groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.concat(F.array_join(F.transform(parts, lambda x: x["t"]), "\n"), F.lit("\n")).alias("body"))


def patch_headers(spark: SparkSession, sf: str) -> DataFrame:
    out = patches.files(patches.sections(_header_diffs(spark, sf)))
    return out.select("key", "file_no", "old_path", "new_path", "status", "similarity", "mode", "is_submodule", "is_symlink", "is_binary", "old_blob", "new_blob", "additions", "deletions", "no_newline", "hunks")


def patch_short_hunks(spark: SparkSession, sf: str) -> DataFrame:
    """Hunks whose headers leave the lengths out."""
    return patches.hunks(patches.sections(_header_diffs(spark, sf))).select("key", "file_no", "old_start", "old_len", "new_start", "new_len", "context_of", "no_newline", "reconciles")


def patch_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each kind in the hunks of each diff."""
    return patches.changed_lines(patches.placed(_diffs(spark, sf))).groupBy("key", "kind").agg(F.count("line_no").alias("lines"), F.sum(F.char_length("text")).alias("chars"))


def _fact_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """A diff per order: a file for each line item that changes a constant, moves one, adds a variable beside a test that was
    there, or states a constant that the file may hold already, by quantity."""
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))

    def text(x: Column, at: Column) -> Column:
        n, q = at.cast("string"), x["q"].cast("string")
        path = F.concat(F.lit("p"), x["l_partkey"].cast("string"), F.lit(".ts"))
        k = x["q"] % 5
        body = (
            F.when(k == 0, F.concat(F.lit("@@ -3 +3 @@\n-const C_"), n, F.lit(" = "), q, F.lit(";\n+const C_"), n, F.lit(" = 0"), q, F.lit(";")))
            .when(k == 1, F.concat(F.lit("@@ -3 +3,0 @@\n-const M_"), n, F.lit(" = "), q, F.lit(";\n@@ -9,0 +9 @@\n+  const M_"), n, F.lit(" = "), q, F.lit(";")))
            .when(k == 2, F.concat(F.lit("@@ -3,2 +3,3 @@\n test('t "), n, F.lit("')\n+  process.env.V_"), n, F.lit("\n-old\n+it('t "), n, F.lit("')")))
            .otherwise(F.concat(F.lit("@@ -9,0 +9 @@\n+const B_"), x["l_partkey"].cast("string"), F.lit(" = 1;")))
        )
        return F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), body)

    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "q")))
    return rows.groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.array_join(F.transform(parts, text), "\n").alias("body"))


def fact_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the diffs, without those that were moved or that the file of an even part holds already."""
    part = F.col("p_partkey").cast("string")
    base = _table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), part, F.lit(".ts")).alias("path"), F.concat(F.lit("first\nconst B_"), part, F.lit(" = 1;\nlast")).alias("text"))
    return patches.fact_changes(patches.sections(_fact_diffs(spark, sf)), base)


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records of a day: facts of several kinds, parts as files, noise by status."""
    n = F.col("o_orderkey") % 7
    who = F.concat(F.lit("Group "), (F.col("o_custkey") % 9).cast("string"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    fact = (
        F.when(n == 0, F.concat(who, F.lit(" in SG left full access on "), day, F.lit(": as listed")))
        .when(n == 1, F.concat(who, F.lit(" of IL left access")))
        .when(n == 2, F.concat(who, F.lit(" has not left access")))
        .when(n == 3, F.concat(who, F.lit(" left access if asked")))
    )
    orders = _table(spark, sf, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("sha"), day.alias("day"), F.concat(day, F.lit("T10:00:00Z")).alias("date"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.struct(F.when(n != 4, F.concat(F.lit("words of "), F.col("o_orderkey").cast("string"))).alias("text")).alias("eli5"), F.array(F.lit("plain fact"), fact).alias("facts"), (F.col("o_orderstatus") == "P").alias("noise"))
    path = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("tests/p"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("src/p"), F.col("l_partkey").cast("string")))
    none = F.lit(None).cast("array<string>")
    paths = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(path).alias("modified"))
    return orders.join(paths, "o_orderkey", "left").select("sha", "day", "date", "title", "eli5", "facts", "noise", F.struct(none.alias("added"), none.alias("removed"), none.alias("renamed"), "modified").alias("files"))


def access_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf).select("sha", stories.access_evidence(F.col("facts")).alias("evidence"))


def story_notes(spark: SparkSession, sf: str) -> DataFrame:
    return stories.story_notes(_claims(spark, sf))


def day_leads(spark: SparkSession, sf: str) -> DataFrame:
    claims = _claims(spark, sf)
    return stories.day_leads(claims, stories.story_notes(claims))


def announcements(spark: SparkSession, sf: str) -> DataFrame:
    claims = _claims(spark, sf)
    return stories.announcement(claims, stories.story_notes(claims))


def day_records(spark: SparkSession, sf: str) -> DataFrame:
    return records.day_records(_claims(spark, sf))


def record_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Records by the first characters of their id, by way of an index of days."""
    sha = F.md5(F.col("o_orderkey").cast("string"))
    table = _table(spark, sf, "orders").select(sha.alias("sha"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("title"))
    asked = _table(spark, sf, "customer").select(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 4 + 4 * (F.col("c_custkey") % 4).cast("int")).alias("prefix"))
    return records.lookup(table, records.day_index(table), asked).select("prefix", "status", "record.sha", "record.day", "record.title")


def cache_age(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the reading of each event is older than six hours at noon of its day."""
    events = _table(spark, sf, "events").select("event_id", _stamp(F.col("ts")).alias("at"), F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("day"))
    return events.select("event_id", upsert.must_fetch(F.when(F.col("event_id") % 10 != 0, F.col("at")), F.col("day") + 12 * 3_600_000).alias("fetch"))


def _events_as_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON texts of entries with fields that the schema does not know, at the top and inside a known struct."""
    n = F.col("event_id")
    day = F.when(n % 3 != 0, F.date_format("ts", "yyyy-MM-dd"))
    known = [F.lpad(n.cast("string"), 12, "0").alias("sha"), _stamp(F.col("ts")).alias("date"), day.alias("day"), F.col("event_type").alias("kind"), F.col("props").alias("summary")]
    inside = F.struct(F.concat(F.lit("t"), n.cast("string")).alias("title"), F.struct((n % 5).alias("deep")).alias("odd"))
    entry = F.struct(*known, inside.alias("ai"), F.struct(F.col("user_id").alias("id")).alias("user"), F.when(n % 2 == 0, "yes").alias("noise"))
    return _table(spark, sf, "events").select("event_id", F.dayofmonth("ts").alias("n"), F.to_json(entry).alias("text"))


def _opened(texts: DataFrame) -> DataFrame:
    return opened(texts.select(F.try_parse_json("text").alias("_entry")), "_entry")


_META = {"version": 1, "repo": "r", "generatedAt": "t", "headSha": "h"}


def store_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Typed and unknown fields of all events after a save and a load."""
    root = scratch(spark, "store")
    changelog.save(spark, root, _opened(_events_as_entries(spark, sf)), _META)
    out = changelog.stored_entries(spark, root)
    part = lambda path, kind: F.try_variant_get("more", path, kind)
    return out.select("sha", "shard", "kind", F.col("ai.title").alias("title"), part("$.user.id", "bigint").alias("user_id"), part("$.ai.odd.deep", "bigint").alias("deep"), part("$.noise", "string").alias("noise"), F.col("noise").isNull().alias("misfit"))


def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Events from partitions to files of a day each and back: what each day holds in the end."""
    first, second = scratch(spark, "store"), scratch(spark, "store")
    changelog.save(spark, first, _opened(_events_as_entries(spark, sf)), _META)
    changelog.save(spark, second, changelog.stored_entries(spark, first).drop("shard"), _META, changelog.FILES)
    changelog.save(spark, first, changelog.stored_entries(spark, second).drop("shard"), _META)
    chars = F.char_length(F.concat_ws("|", "sha", "date", "day", "kind", "summary", "ai.title"))
    user = F.try_variant_get("more", "$.user.id", "bigint")
    return changelog.stored_entries(spark, first).groupBy("shard").agg(F.count(F.lit(1)).alias("entries"), F.sum(chars).alias("chars"), F.sum(user).alias("users"), F.min("sha").alias("first"), F.max("sha").alias("last"))


def store_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Events saved up to the 18th; then a batch of later ones with some that were there edited and moved to another day."""
    root, events = scratch(spark, "store"), _events_as_entries(spark, sf)
    changelog.save(spark, root, _opened(events.where("n <= 18")), _META)
    edited = F.regexp_replace(F.regexp_replace("text", '"(date|day)":"[^"]*"', '"$1":"2031-01-01"'), '"kind":"', '"kind":"edited ')
    again = events.where("n <= 18 and event_id % 11 = 0").withColumn("text", edited)
    changelog.merge(spark, root, _opened(events.where("n > 18").unionByName(again)), _META)
    user = F.try_variant_get("more", "$.user.id", "bigint")
    return changelog.stored_entries(spark, root).select("sha", "shard", "kind", user.alias("user_id"))


def sync_stream(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`sync_reason` by a stream of the events as polls, with one state for each user."""
    schema = _table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")  # a pattern, as a stream's plain path must be a folder
    polls = events.select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("id"), F.md5("event_type").alias("head"), F.col("ts").alias("at"))
    out = scratch(spark, "decisions")
    decisions.keep_decisions(polls, out, scratch(spark, "checkpoint"), stale_ms=300 * 60_000, floor=False, each=True).awaitTermination()
    return spark.read.parquet(out).select(F.col("id").alias("event_id"), "reason")


QUERIES = {
    f.__name__: f
    for f in (
        shard_manifest, day_keys, canonical_sort, canonical_ranks, shard_diff, legacy_migrate, size_budget, size_texts, dist_budget, dist_message, retention, retention_cut,
        cache_prune, keep_list_prune, refresh_queue, sync_reason, status_check, traffic_upsert, story_links, prefix_lookup, prefix_ranges, override_merge, override_edits,
        day_range, feed_rows, compact_numbers, patch_files, patch_hunks, patch_stats, version_bumps, hunk_sections, line_classify,
        patch_headers, patch_short_hunks, patch_lines, fact_changes, access_evidence, story_notes, day_leads, announcements, day_records, record_lookup, cache_age,
        store_fields, store_round_trip, store_merge, sync_stream, store_status, size_reading, commits_week,
    )
}
