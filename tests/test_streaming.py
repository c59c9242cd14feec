import json

from pyspark.sql import functions as F

from chronolith import streaming
from chronolith.sources import changelog

META = {"version": 1, "repo": "r", "generatedAt": "t", "headSha": "h", "counts": {}}


def put(folder, name, *rows):
    (folder / name).write_text("".join(json.dumps({"sha": s, "date": f"{d}T00:00:00Z", "day": d, "summary": t}) + "\n" for s, d, t in rows))


def test_late_records_rewrite_their_own_day(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    saves = []
    run = lambda: streaming.keep_store(streaming.read_entries(spark, str(inbox)), root, str(tmp_path / "cp"), META, lambda n, a: saves.append(a)).awaitTermination()
    put(inbox, "1.json", ("a", "2026-01-01", "x"), ("b", "2026-01-02", "x"))
    run()
    put(inbox, "2.json", ("c", "2026-01-01", "late"), ("b", "2026-01-02", "x"))
    run()
    assert saves[0]["write"] == ["2026-01-01", "2026-01-02"]
    assert saves[1]["rewrite"] == ["2026-01-01"] and saves[1]["keep"] == ["2026-01-02"]
    assert [(r["sha"], r["summary"]) for r in changelog.load(spark, root).collect()] == [("a", "x"), ("c", "late"), ("b", "x")]
    run()
    assert len(saves) == 2


def test_first_batch_is_merged_by_sha(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    put(inbox, "1.json", ("a", "2026-01-01", "x"), ("a", "2026-01-01", "y"))
    streaming.keep_store(streaming.read_entries(spark, str(inbox)), root, str(tmp_path / "cp"), META).awaitTermination()
    assert [(r["sha"], r["summary"]) for r in changelog.load(spark, root).collect()] == [("a", "y")]


def test_windows_and_sessions(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([(1, "2026-01-01 00:10:00"), (1, "2026-01-01 00:20:00"), (1, "2026-01-01 03:00:00"), (2, "2026-01-01 00:50:00")], "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts")).write.parquet(src)

    def result(make, name):
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(src)
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination()
        return spark.table(name)

    hours = result(streaming.counts_by_window, "hours").orderBy("start").collect()
    assert [r["rows"] for r in hours] == [3, 1]
    assert sorted((r["user_id"], r["rows"]) for r in result(streaming.sessions, "spells").collect()) == [(1, 1), (1, 2), (2, 1)]
