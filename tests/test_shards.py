import json

from pyspark.sql import functions as F

from chronolith.functions import day_key
from chronolith.operators import shards
from chronolith.schemas import ENTRY
from chronolith.sources import changelog, files


def entries(spark, *rows):
    return spark.createDataFrame([{"sha": s, "date": d, "day": y, "summary": t} for s, d, y, t in rows], ENTRY)


def at(day, hour="10"):
    return f"{day}T{hour}:00:00Z"


BASE = [("b", at("2026-01-02"), "2026-01-02", "x"), ("a", at("2026-01-01"), "2026-01-01", "x"), ("c", at("2026-01-02", "09"), "2026-01-02", "x"), ("d", at("2026-01-03"), "2026-01-03", "x")]
META = {"version": 1, "repo": "r", "generatedAt": "t", "headSha": "h", "counts": {"changes": 7}}


def test_day_key_falls_back(spark):
    rows = [("2026-01-01", "2026-01-02T"), ("", "2026-01-02T10"), (None, "2026-01-03T"), (None, ""), (None, None), ("", None), ("odd", None)]
    got = spark.createDataFrame(rows, "day string, date string").coalesce(1).select(day_key(F.col("day"), F.col("date"))).collect()
    assert [r[0] for r in got] == ["2026-01-01", "2026-01-02", "2026-01-03", "unknown", "unknown", "unknown", "odd"]


def test_canonical_order_puts_nulls_first(spark):
    df = entries(spark, *BASE, ("z", None, None, "x"))
    assert [r["sha"] for r in shards.canonical_sort(df).collect()] == ["z", "a", "c", "b", "d"]


def test_every_record_has_its_rank(spark):
    rows = [(f"{k * 7919 % 1009:05d}", None if k % 50 == 0 else at(f"2026-01-{1 + k % 3:02d}"), None, "x") for k in range(400)]
    df = entries(spark, *rows).repartition(3)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    for pieces in (1, 7, 64):
        got = shards.ranked_all(df, pieces=pieces).collect()
        assert {r["rank"]: r["sha"] for r in got} == {k + 1: r[0] for k, r in enumerate(want)} and len(got) == 400
    assert shards.ranked_all(df.where("false")).count() == 0


def test_round_trip_and_manifest(spark, tmp_path):
    root = str(tmp_path / "s")
    assert changelog.load(spark, root) is None and changelog.stored_bytes(spark, root) == 0
    actions = changelog.save(spark, root, entries(spark, *BASE), META)
    assert actions["write"] == ["2026-01-01", "2026-01-02", "2026-01-03"]
    assert [r["sha"] for r in changelog.load(spark, root).collect()] == ["a", "c", "b", "d"]
    m = changelog.read_manifest(spark, root).first()
    assert (m["layout"], m["counts"], m["headSha"]) == ("day-shards", {"changes": 7, "entries": 4}, "h")
    assert changelog.stored_bytes(spark, root) > 0


def test_only_changed_shards_are_written(spark, tmp_path):
    root = str(tmp_path / "s")
    changelog.save(spark, root, entries(spark, *BASE), META)
    parts = {p: p.stat().st_mtime_ns for p in (tmp_path / "s" / "changelog").rglob("*.json")}
    again = changelog.save(spark, root, entries(spark, *reversed(BASE)), META)
    assert again == {"keep": ["2026-01-01", "2026-01-02", "2026-01-03"], "rewrite": [], "write": [], "delete": []}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "s" / "changelog").rglob("*.json")} == parts
    edited = [*BASE[:3], ("d", at("2026-01-03"), "2026-01-03", "changed")]
    assert changelog.save(spark, root, entries(spark, *edited), META)["rewrite"] == ["2026-01-03"]
    kept = {p for p in (tmp_path / "s" / "changelog").rglob("*.json")}
    assert len(kept & set(parts)) == 2


def test_vanished_days_are_deleted(spark, tmp_path):
    root = str(tmp_path / "s")
    changelog.save(spark, root, entries(spark, *BASE), META)
    assert changelog.save(spark, root, entries(spark, *BASE[:3]), META)["delete"] == ["2026-01-03"]
    assert changelog.load(spark, root).count() == 3
    assert sorted(p.name for p in (tmp_path / "s" / "changelog").iterdir() if p.name.startswith("shard=")) == ["shard=2026-01-01", "shard=2026-01-02"]
    assert changelog.save(spark, root, entries(spark), META)["delete"] == ["2026-01-01", "2026-01-02"]
    assert changelog.load(spark, root).count() == 0


def test_records_without_day(spark, tmp_path):
    root = str(tmp_path / "s")
    actions = changelog.save(spark, root, entries(spark, ("a", at("2026-01-05"), None, "x"), ("b", None, None, "x")), META)
    assert actions["write"] == ["2026-01-05", "unknown"] and changelog.load(spark, root).count() == 2


def test_legacy_document_and_shard_files(spark, tmp_path):
    doc = tmp_path / "doc.json"
    doc.write_text(json.dumps({**META, "entries": [{"sha": "b", "date": at("2026-01-02")}, {"sha": "a", "date": at("2026-01-01")}]}, indent=2))
    plain = tmp_path / "plain.json"
    plain.write_text(json.dumps(META))
    assert [r[0] for r in changelog.read_document(spark, str(doc)).select(shards.is_legacy(changelog.read_document(spark, str(doc)))).collect()] == [True]
    assert changelog.load_document(spark, str(plain)).count() == 0
    assert [r["sha"] for r in changelog.load_document(spark, str(doc)).collect()] == ["b", "a"]
    folder = tmp_path / "days"
    folder.mkdir()
    (folder / "2026-01-01.json").write_text(json.dumps({"day": "2026-01-01", "entries": [{"sha": "a"}]}, indent=2))
    (folder / "broken.json").write_text("{nonsense")
    (folder / "empty.json").write_text(json.dumps({"day": "x"}))
    (folder / "note.txt").write_text("no shard")
    assert [r["sha"] for r in changelog.read_shard_files(spark, str(folder)).collect()] == ["a"]
    assert files.list_files(spark, str(folder)).count() == 4


def test_digest_ignores_order_and_sees_repeats(spark):
    def digest(rows):
        df = spark.createDataFrame([("d", r) for r in rows], "shard string, r string")
        return shards.digests(df, F.col("r")).first()["digest"]

    assert digest(["x", "y"]) == digest(["y", "x"]) != digest(["x", "y", "y"])


def test_shard_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "shard string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "shard string, digest string")
    assert {r["shard"]: r["action"] for r in shards.shard_changes(old, new).collect()} == {"a": "keep", "b": "rewrite", "c": "delete", "d": "write"}


def test_all_layouts_load_through_one_call(spark, tmp_path):
    inline = tmp_path / "inline"
    inline.mkdir()
    (inline / "changelog.json").write_text(json.dumps({**META, "entries": [{"sha": "b", "date": at("2026-01-02")}, {"sha": "a", "date": at("2026-01-01")}]}, indent=2))
    assert [r["sha"] for r in changelog.load(spark, str(inline)).collect()] == ["b", "a"]  # as they are
    days = tmp_path / "days"
    (days / "changelog").mkdir(parents=True)
    (days / "changelog.json").write_text(json.dumps({**META, "layout": "day-shards"}, indent=2))
    for day, sha in (("2026-01-02", "b"), ("2026-01-01", "a")):
        (days / "changelog" / f"{day}.json").write_text(json.dumps({"day": day, "entries": [{"sha": sha, "date": at(day)}]}, indent=2))
    (days / "changelog" / "broken.json").write_text("{nonsense")
    assert [r["sha"] for r in changelog.load(spark, str(days)).collect()] == ["a", "b"]
    changelog.save(spark, str(days), changelog.load(spark, str(days)), META)  # both layouts beside each other
    assert changelog.manifest_fields(spark, str(days))["counts"] == {"changes": 7, "entries": 2}
    none = tmp_path / "none"
    none.mkdir()
    (none / "changelog.json").write_text(json.dumps(META))
    assert changelog.load(spark, str(none)).count() == 0


def test_manifest_fields_pass_and_broken_lines_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changelog, "FILE_RECORDS", 2)
    root = str(tmp_path / "s")
    more = [(f"m{k}", at("2026-01-02", f"{k:02d}"), "2026-01-02", "x") for k in range(20)]
    changelog.save(spark, root, entries(spark, *BASE, *more), {**META, "custom": {"deep": [1, 2]}, "note": "é", "entries": [1]})
    fields = changelog.manifest_fields(spark, root)
    assert fields["custom"] == {"deep": [1, 2]} and fields["note"] == "é" and "entries" not in fields
    files_of_day = list((tmp_path / "s" / "changelog" / "shard=2026-01-02").glob("*.json"))
    assert changelog.load(spark, root).count() == 24
    with open(files_of_day[0], "a") as f:
        f.write("{nonsense\n")
    for crc in (tmp_path / "s" / "changelog").rglob("*.crc"):
        crc.unlink()
    assert changelog.load(spark, root).count() == 24


def test_lost_digests_rewrite_all_and_still_delete(spark, tmp_path):
    root = str(tmp_path / "s")
    changelog.save(spark, root, entries(spark, *BASE), META)
    changelog.delete(spark, f"{root}/{changelog.DIGESTS}")
    got = changelog.save(spark, root, entries(spark, *BASE[:3]), META)
    assert got == {"keep": [], "rewrite": ["2026-01-01", "2026-01-02"], "write": [], "delete": ["2026-01-03"]}
    assert [r["sha"] for r in changelog.load(spark, root).collect()] == ["a", "c", "b"]
