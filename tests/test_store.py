"""Both layouts of the store and the inline document: fields of any shape, round trips, cut-off saves, merges."""

import json

import pytest
from pyspark.sql import functions as F

from chronolith.schemas import ENTRY
from chronolith.sources import changelog, dayfiles
from chronolith.sources.entries import whole, with_more

META = {"version": 1, "repo": "r", "generatedAt": "t", "headSha": "h", "counts": {"changes": 7}, "custom": {"deep": [1]}}
ODD = {"sha": "b", "date": "2026-01-02T09:00:00Z", "day": "2026-01-02", "noise": "yes", "extra": {"deep": [1, None, "é"]}, "ai": {"title": "t", "tone": "dry"}, "files": 5, "stats": {"additions": 2, "moved": 1}, "score": 1.5, "summary": None}
ROWS = [
    {"sha": "c", "date": "2026-01-02T10:00:00Z", "day": "2026-01-02", "summary": "s", "areas": ["x"], "files": {"total": 2, "added": ["a"]}},
    ODD,
    {"sha": "a", "date": "2026-01-01T10:00:00Z", "day": "2026-01-01", "summary": "s a"},
    {"sha": "x", "date": "2024-07-09T12:00:00Z", "summary": "no day"},
    {"sha": "y", "summary": "no date"},
]


def by_sha(rows):
    return sorted(rows, key=lambda r: r["sha"])


def plain(df):
    """The entries of a DataFrame as objects."""
    rows = with_more(df).select(F.to_json(F.struct(*ENTRY.names)).alias("typed"), F.to_json("more").alias("more")).collect()
    return [json.loads(whole(r["typed"], r["more"])) for r in rows]


def monolith(root, rows=ROWS, **fields):
    root.mkdir()
    (root / "changelog.json").write_text(json.dumps({**META, **fields, "entries": rows}, indent=2))
    return str(root)


def day_files(root, rows=ROWS):
    (root / "changelog").mkdir(parents=True)
    (root / "changelog.json").write_text(json.dumps({**META, "layout": "day-shards"}))
    days = {}
    for r in rows:
        days.setdefault(r.get("day") or r.get("date", "")[:10] or "unknown", []).append(r)
    for day, own in days.items():
        (root / "changelog" / f"{day}.json").write_text(json.dumps({"day": day, "entries": own}, indent=2))
    return str(root)


def names(root):
    return sorted(p.name for p in (root / "changelog").iterdir() if p.name.endswith(".json") or p.name.startswith("shard="))


DAYS = ["2024-07-09", "2026-01-01", "2026-01-02", "unknown"]


@pytest.mark.parametrize("layout", [changelog.PARTITIONS, changelog.FILES])
@pytest.mark.parametrize("begin", [monolith, day_files])
def test_entries_of_any_shape_survive(spark, tmp_path, begin, layout):
    root = begin(tmp_path / "s")
    loaded = changelog.load(spark, root)
    assert by_sha(plain(loaded)) == by_sha(ROWS)
    changelog.save(spark, root, loaded, changelog.manifest_fields(spark, root), layout)
    wanted = [f"{d}.json" for d in DAYS] if layout == changelog.FILES else [f"shard={d}" for d in DAYS]
    assert names(tmp_path / "s") == wanted  # each day once, in one layout
    again = changelog.load(spark, root)
    assert plain(again) == [ROWS[k] for k in (4, 3, 2, 1, 0)]  # canonical order
    fields = changelog.manifest_fields(spark, root)
    assert (fields["custom"], fields["layout"], fields["counts"]) == ({"deep": [1]}, "day-shards", {"changes": 7, "entries": 5})
    actions = changelog.save(spark, root, again, fields, layout)
    assert actions == {"keep": DAYS, "rewrite": [], "write": [], "delete": []}


def test_layouts_replace_each_other(spark, tmp_path):
    root = day_files(tmp_path / "s")
    for layout, name in ((changelog.PARTITIONS, "shard={}"), (changelog.FILES, "{}.json"), (changelog.PARTITIONS, "shard={}")):
        kept = changelog.load(spark, root).where("sha != 'y'")
        actions = changelog.save(spark, root, kept, META, layout)
        assert names(tmp_path / "s") == [name.format(d) for d in DAYS[:3]]
        assert by_sha(plain(changelog.load(spark, root))) == by_sha(ROWS[:4]) and actions["keep"] == []


def test_day_files_are_readable_by_others_and_changed_ones_are_written(spark, tmp_path):
    root = str(tmp_path / "s")
    entries = changelog.load(spark, monolith(tmp_path / "m"))
    changelog.save(spark, root, entries, META, changelog.FILES)
    folder = tmp_path / "s" / "changelog"
    shard = json.loads((folder / "2026-01-02.json").read_text())
    assert shard == {"day": "2026-01-02", "entries": [ODD, ROWS[0]]}
    before = {p.name: (p.stat().st_mtime_ns, p.read_text()) for p in folder.glob("*.json")}
    edited = entries.withColumn("summary", F.when(F.col("sha") == "a", "edited").otherwise(F.col("summary")))
    assert changelog.save(spark, root, edited, META, changelog.FILES)["rewrite"] == ["2026-01-01"]
    after = {p.name: (p.stat().st_mtime_ns, p.read_text()) for p in folder.glob("*.json")}
    assert {n for n in before if before[n] != after[n]} == {"2026-01-01.json"}
    (folder / "2026-01-02.json").write_text(json.dumps({"day": "2026-01-02", "entries": []}))  # by another writer
    assert changelog.save(spark, root, edited, META, changelog.FILES)["rewrite"] == ["2026-01-02"]
    assert changelog.load(spark, root).count() == 5


def test_broken_manifest_is_none_and_broken_shards_are_listed(spark, tmp_path):
    root = day_files(tmp_path / "s")
    (tmp_path / "s" / "changelog" / "broken.json").write_text("{nonsense")
    assert changelog.load(spark, root).count() == 5
    assert [(r["path"].endswith("broken.json"), r["_corrupt_record"]) for r in changelog.broken(spark, root).collect()] == [(True, "{nonsense")]
    for text in ("{broken", "", "[1]"):
        (tmp_path / "s" / "changelog.json").write_text(text)
        assert changelog.load(spark, root) is None
    (tmp_path / "s" / "changelog.json").write_text("{}")
    assert changelog.load(spark, root).count() == 5


def test_days_prune_folders_and_files(spark, tmp_path):
    root = str(tmp_path / "p")
    changelog.save(spark, root, changelog.load(spark, monolith(tmp_path / "m")), META)
    rows = changelog.stored_entries(spark, root).where("shard = '2026-01-01'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "= 2026-01-01" in plan
    assert [r["sha"] for r in changelog.load(spark, root, "2025-01-01", "2026-01-01").collect()] == ["a"]
    files = day_files(tmp_path / "f")
    for where in (root, files):
        some = changelog.stored_entries(spark, where, ["2026-01-02", "2031-01-01"])
        assert sorted(r["sha"] for r in some.collect()) == ["b", "c"]
    assert len(changelog.stored_entries(spark, files, first="2026-01-02").inputFiles()) == 2
    joined = changelog.stored_entries(spark, root).join(F.broadcast(spark.createDataFrame([("2026-01-01",)], "shard string").where("shard > '2025'")), "shard", "left_semi")
    assert "dynamicpruningexpression" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1


def test_lookup_reads_its_days_only(spark, tmp_path):
    root = day_files(tmp_path / "s", [{"sha": f"{k:02d}abc", "date": f"2026-01-{1 + k:02d}T00:00:00Z", "n": k} for k in range(9)])
    probes = spark.createDataFrame([("03",), ("0",), ("77",), ("05abc",)], "prefix string")
    changelog._where(spark, root, None)  # the index is there once
    for day in ("2026-01-01", "2026-01-09"):
        (tmp_path / "s" / "changelog" / f"{day}.json").write_text("{nonsense")
    one = probes.where("prefix = '03'")
    assert [(r["status"], r["record"]["sha"], json.loads(r["record"]["more"])["n"]) for r in changelog.find(spark, root, one).collect()] == [("found", "03abc", 3)]
    got = {r["prefix"]: (r["status"], r["record"] and r["record"]["sha"]) for r in changelog.find(spark, root, probes).collect()}
    assert got == {"03": ("found", "03abc"), "0": ("ambiguous", None), "77": ("missing", None), "05abc": ("found", "05abc")}


def merged(spark, root, *rows, **how):
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "t string")
    return changelog.merge(spark, root, changelog.opened(text.select(F.try_parse_json("t").alias("e")), "e"), META, **how)


@pytest.mark.parametrize("layout", [changelog.PARTITIONS, changelog.FILES])
def test_merge_reads_and_writes_the_days_it_touches(spark, tmp_path, layout):
    root = str(tmp_path / "s")
    first = [{"sha": f"s{k}", "date": f"2026-01-{1 + k % 9:02d}T00:00:00Z", "n": k} for k in range(27)]
    assert len(merged(spark, root, *first, layout=layout)["write"]) == 9
    folder = tmp_path / "s" / "changelog"
    far = [p for p in folder.rglob("*.json") if "2026-01-05" in str(p)]
    for p in far:
        p.write_text("{nonsense")  # a day that later merges must neither read nor write
    for p in folder.rglob("*.crc"):
        p.unlink()
    kept = {p: p.stat().st_mtime_ns for p in folder.rglob("*.json")}
    moved = {**first[3], "date": "2026-02-01T00:00:00Z", "kind": "moved"}  # leaves 2026-01-04
    actions = merged(spark, root, moved, {"sha": "new", "date": "2026-01-02T00:00:00Z"}, {**first[0]}, layout=layout)
    assert actions == {"keep": ["2026-01-01"], "rewrite": ["2026-01-02", "2026-01-04"], "write": ["2026-02-01"], "delete": []}
    untouched = {p: t for p, t in kept.items() if "2026-01-02" not in str(p) and "2026-01-04" not in str(p)}
    assert {p: p.stat().st_mtime_ns for p in untouched} == untouched and all(p.read_text() == "{nonsense" for p in far)
    want = by_sha([r for r in [*first, {"sha": "new", "date": "2026-01-02T00:00:00Z"}] if r["sha"] != "s3" and "-01-05" not in r["date"]] + [moved])
    assert by_sha(plain(changelog.load(spark, root))) == want
    assert changelog.manifest_fields(spark, root)["counts"]["entries"] == 28
    again = merged(spark, root, moved, layout=layout)
    assert again == {"keep": ["2026-02-01"], "rewrite": [], "write": [], "delete": []}
    only = merged(spark, root, {**moved, "date": "2026-01-02T00:00:00Z"}, layout=layout)
    assert (only["delete"], only["rewrite"]) == (["2026-02-01"], ["2026-01-02"])


def test_merge_into_a_store_of_another_writer(spark, tmp_path):
    root = day_files(tmp_path / "s")
    actions = merged(spark, root, {"sha": "b", "date": "2026-01-01T08:00:00Z", "day": "2026-01-01", "odd": 1})
    assert set(actions["rewrite"]) == {"2026-01-01", "2026-01-02"} and actions["delete"] == []
    want = [r for r in ROWS if r["sha"] != "b"] + [{"sha": "b", "date": "2026-01-01T08:00:00Z", "day": "2026-01-01", "odd": 1}]
    assert by_sha(plain(changelog.load(spark, root))) == by_sha(want)
    assert names(tmp_path / "s") == ["2024-07-09.json", "shard=2026-01-01", "shard=2026-01-02", "unknown.json"]


def test_a_save_that_was_cut_off_is_finished_or_dropped(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    entries = changelog.load(spark, monolith(tmp_path / "m"))
    changelog.save(spark, root, entries, META)
    edited = entries.withColumn("summary", F.lit("new")).where("sha != 'a'")

    def stop(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(changelog, "_put_text", stop)  # before the plan is there
        with pytest.raises(RuntimeError):
            changelog.save(spark, root, edited, META)
    assert not changelog.recover(spark, root) and by_sha(plain(changelog.load(spark, root))) == by_sha(ROWS)
    with monkeypatch.context() as m:
        m.setattr(changelog, "_layouts", stop)  # after the days were written
        m.setattr(changelog, "recover", lambda *_: False)
        with pytest.raises(RuntimeError):
            changelog._apply(spark, root, {"layout": "partitions", "changed": [], "delete": ["2026-01-01"], "index": None, "digests": {}, "manifest": META})
    assert changelog.load(spark, root).count() == 5
    real = changelog.delete
    with monkeypatch.context() as m:
        m.setattr(changelog, "delete", stop)
        with pytest.raises(RuntimeError):
            changelog.save(spark, root, edited, META)  # days are written, the vanished one is still there
    assert real is changelog.delete and changelog.recover(spark, root)
    assert sorted((r["sha"], r["summary"]) for r in changelog.load(spark, root).collect()) == [(s, "new") for s in "bcxy"]
    assert not (tmp_path / "s" / "pending").exists()


def test_a_failed_write_leaves_the_files_as_they_were(spark, tmp_path):
    root = day_files(tmp_path / "s")
    folder = tmp_path / "s" / "changelog"
    before = {p.name: p.read_text() for p in folder.iterdir()}
    bad = spark.createDataFrame([("2026-01-01", '{"sha":"new"}', None), ("2026-01-02", "{nonsense", None)], "shard string, typed string, more string").repartition(1)
    with pytest.raises(Exception, match="(?s)JSON|Expecting|property"):
        dayfiles.write(bad, str(folder))
    assert {p.name: p.read_text() for p in folder.iterdir()} == before
    apart = spark.createDataFrame([("2026-01-01", "{}", None), ("2026-01-01", "{}", None)], "shard string, typed string, more string").repartition(2)
    if apart.rdd.glom().map(len).filter(bool).count() == 2:
        with pytest.raises(Exception, match="more than one partition"):
            dayfiles.write(apart, str(folder))
        assert {p.name: p.read_text() for p in folder.iterdir()} == before


def test_rows_of_a_save_and_of_a_merge_are_made_once(spark, tmp_path, monkeypatch):
    root, made = str(tmp_path / "s"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    entries = changelog.load(spark, monolith(tmp_path / "m")).withColumn("summary", counted("summary"))
    for action in ("write", "keep"):
        before = made.value
        assert changelog.save(spark, root, entries, META)[action] == DAYS and made.value - before == len(ROWS)
    before, wins = made.value, changelog.latest_wins
    monkeypatch.setattr(changelog, "latest_wins", lambda *sides: wins(*sides).withColumn("summary", counted("summary")))
    assert merged(spark, root, {**ODD, "kind": "edited"})["rewrite"] == ["2026-01-02"]
    assert made.value - before == 1 + 2  # the batch, and the rows of its day
    assert by_sha(plain(changelog.load(spark, root))) == by_sha([{**r, "kind": "edited"} if r is ODD else r for r in ROWS])
