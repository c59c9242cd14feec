from pyspark.sql import functions as F

from chronolith.operators import records, stories, upsert
from chronolith.schemas import ENTRY, TRAFFIC
from chronolith.sources import files


def change(c, hour, words, facts=(), **more):
    base = {"sha": c * 40, "day": "2026-01-16", "date": f"2026-01-16T{hour}:00:00Z", "title": c, "files": {"modified": ["src/countries.ts"]}, "eli5": {"text": words}, "facts": list(facts)}
    return {**base, **more}


A = change("a", "00", "Nothing changes today.", ["SG and IL left full access on 2026-01-15: figures."])
B = change("b", "01", "Subscribers keep their access.")


def notes(spark, *rows):
    return stories.story_notes(spark.createDataFrame(list(rows), ENTRY))


def test_evidence(spark):
    facts = ["SG and IL left full access on 2026-01-14.", "SG and IL left full access.", "SG and IL left full access on 2026-01-15: figures.", "SG and IL have not lost full access.", "If SG and IL left full access, plans stay.", "Added tests for full access.", None]
    got = spark.createDataFrame([(f,) for f in facts], "f string").coalesce(1).select(stories.access_evidence(F.array("f"))).collect()
    assert [r[0] for r in got] == ["Singapore and Israel left full access on 2026-01-14.", "Singapore and Israel left full access.", "Singapore and Israel left full access on 2026-01-15.", "", "", "", ""]


def test_notes_go_one_way_and_ignore_order(spark):
    one, two = notes(spark, A, B).collect(), notes(spark, B, A).collect()
    assert one == two and len(one) == 1
    assert (one[0]["sha"], one[0]["peer"]) == (A["sha"], B["sha"])
    assert one[0]["text"] == "Singapore and Israel left full access on 2026-01-15. Subscribers keep their access."
    assert notes(spark, A).count() == 0


def test_unrelated_peers_give_no_note(spark):
    for more in ({"files": {"modified": ["other.ts"]}}, {"noise": True}, {"day": "2026-01-17"}, {"eli5": None}):
        assert notes(spark, A, {**B, **more}).count() == 0
    for path in ("README.md", "README.zh-CN.md", "bun.lock", "package-lock.json", "common/tests/countries.test.ts"):
        assert notes(spark, *({**e, "files": {"modified": [path]}} for e in (A, B))).count() == 0


def test_leads_and_announcements(spark):
    rows = spark.createDataFrame([A, B], ENTRY)
    found = stories.story_notes(rows)
    assert stories.day_leads(rows, found).first()["headline"].endswith("on 2026-01-15.")
    long = rows.withColumn("title", F.repeat(F.lit("t"), 3000)).withColumn("eli5", F.struct(F.repeat(F.lit("w"), 3000).alias("text")))
    text = {r["sha"]: r["announcement"] for r in stories.announcement(long, found).collect()}
    assert all(len(t) == 2000 for t in text.values()) and "left full access on 2026-01-15." in text[A["sha"]]
    assert "left full access on 2026-01-15." in stories.announcement(rows, found, plain=True).where(F.col("sha") == A["sha"]).first()[1]


def test_latest_wins_and_merge(spark):
    days = lambda *d: [{"timestamp": f"2026-01-0{n}T00:00:00Z", "count": c, "uniques": u} for n, c, u in d]
    cached = spark.createDataFrame([{"count": 1000, "uniques": 200, "clones": days((1, 50, 10), (2, 60, 15)), "fetchedAt": "x"}], TRAFFIC)
    fresh = spark.createDataFrame([{"count": 2000, "uniques": 400, "clones": days((2, 65, 16), (3, 80, 25)), "fetchedAt": "y"}], TRAFFIC)
    got = upsert.merge_traffic(cached, fresh).first()
    assert (got["count"], got["uniques"], got["fetchedAt"]) == (2000, 400, "y")
    assert [(c["timestamp"][:10], c["count"]) for c in got["clones"]] == [("2026-01-01", 50), ("2026-01-02", 65), ("2026-01-03", 80)]
    assert upsert.fresh_or_cached(cached, fresh.where("false")).first()["count"] == 1000
    assert upsert.fresh_or_cached(cached, fresh).first()["count"] == 2000
    old = spark.createDataFrame([("k", 1)], "k string, v long")
    assert [tuple(r) for r in upsert.latest_wins(old, spark.createDataFrame([("k", None)], "k string, v long"), "k").collect()] == [("k", None)]


def test_ttl(spark):
    now = 1_700_000_000_000
    df = spark.createDataFrame([("2023-11-14T22:13:20Z",), ("2023-11-13T22:13:20Z",), (None,)], "f string").coalesce(1)
    assert [r[0] for r in df.select(upsert.must_fetch(F.col("f"), F.lit(now))).collect()] == [False, True, True]
    assert df.limit(1).select(upsert.must_fetch(F.col("f"), F.lit(now), force=True)).first()[0]


def test_prefixes(spark):
    known = spark.createDataFrame([("aaaa1111",), ("aaaa2222",), ("bbbb",), ("bbbb",), (None,)], "sha string")
    asked = spark.createDataFrame([("aaaa",), ("aaaa1",), ("b",), ("zz",), ("",), (None,), ("aa",)], "prefix string")
    got = {r["prefix"]: (r["status"], r["matches"], r["sha"]) for r in records.by_prefix(known, asked).collect()}
    assert got == {"aaaa": ("ambiguous", 2, None), "aaaa1": ("found", 1, "aaaa1111"), "b": ("found", 1, "bbbb"), "zz": ("missing", 0, None), "": ("missing", 0, None), None: ("missing", 0, None), "aa": ("ambiguous", 2, None)}


def test_overrides(spark):
    rows = spark.createDataFrame([{"sha": "s1", "title": "own", "ai": {"title": "AI title"}, "eli5": {"text": "Plain line."}}, {"sha": "s2", "title": "own"}], ENTRY)
    first = records.draft(rows, F.lit("s1")).first()
    assert (first["title"], first["eli5"]) == ("AI title", "Plain line.")
    over = spark.createDataFrame([], "sha string, title string, note string, noise boolean")
    over = records.put_override(over, spark.createDataFrame([("s1", "Corrected title", "was wrong")], "sha string, title string, note string"))
    over = records.put_override(over, spark.createDataFrame([("s1", None, "still wrong")], "sha string, title string, note string"))
    assert over.first().asDict() == {"sha": "s1", "title": "Corrected title", "note": "still wrong", "noise": None}
    shown = {r["sha"]: r for r in records.effective(rows, over).collect()}
    assert (shown["s1"]["title"], shown["s1"]["note"], shown["s2"]["title"]) == ("Corrected title", "still wrong", "own")
    assert records.clear_override(over, spark.createDataFrame([("s1",)], "sha string")).count() == 0


def test_feed_range_and_index(spark):
    rows = spark.createDataFrame([A, B, {**B, "sha": "c" * 40, "noise": True}, {**B, "sha": "d" * 40, "day": "2026-01-18"}], ENTRY)
    assert [r["id"][0] for r in records.feed(rows, 2).collect()] == ["d", "b"]
    assert records.between(rows, "2026-01-16", "2026-01-17").count() == 3
    assert {r["key"] for r in records.day_index(rows).collect()} == {c * 12 for c in "abcd"}


def test_traffic_file(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"count": 3,\n "uniques": 1, "clones": [], "fetchedAt": "x"}')
    assert files.read_traffic(spark, str(tmp_path / "t.json")).first()["count"] == 3


def test_lookup_returns_the_record(spark):
    rows = [("abc123def4567", "2026-01-01", "one"), ("abc999", "2026-01-02", "two"), ("fff", "2026-01-03", "three")]
    table = spark.createDataFrame(rows, "sha string, day string, title string")
    probes = spark.createDataFrame([("abc123def456",), ("abc123def4567",), ("abc",), ("abc9",), ("abc123def4568",), ("x",), ("",)], "prefix string")
    got = {r["prefix"]: (r["status"], r["record"] and r["record"]["title"]) for r in records.lookup(table, records.day_index(table), probes).collect()}
    assert got == {"abc123def456": ("found", "one"), "abc123def4567": ("found", "one"), "abc": ("ambiguous", None), "abc9": ("found", "two"), "abc123def4568": ("missing", None), "x": ("missing", None), "": ("missing", None)}
    text = table.where("sha = 'fff'").select(records.as_markdown(F.col("title"), F.lit(None).cast("string"), F.col("day"), F.col("sha"))).first()[0]
    assert text == "# three\n\n2026-01-03 `fff`\n"


def test_prefix_ranges_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "ids")
    table = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("sha"))
    records.write_index(table, path, row_group_bytes=1 << 18)
    index = spark.read.schema("id string").parquet(path)
    probes = spark.createDataFrame([("00ab",), ("00ab1",), ("7",), ("7f",), ("zz",), ("",), (None,)], "prefix string").where("prefix != '7' or prefix is null")
    got = records.by_prefix_in(index, probes).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, records.by_prefix(table, probes).collect()), key=repr)
    some = records.in_ranges(index, probes)
    some.collect()
    leaf = some._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().apply("numOutputRows").value() < 100_000  # of the rows in row groups that were read
    assert records.by_prefix_in(index, probes.where("false")).count() == 0
