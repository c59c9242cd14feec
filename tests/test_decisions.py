import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolith.operators import freshness
from chronolith.streaming import decisions

MINUTE = 60_000


def polls(spark, folder, *rows):
    df = spark.createDataFrame(rows, "source string, id long, head string, minute long").select("source", "id", "head", F.timestamp_millis(F.col("minute") * MINUTE).alias("at"))
    df.coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, **how):
    stream = spark.readStream.schema("source string, id long, head string, at timestamp").parquet(str(tmp_path / "in"))
    before = spark.conf.get(decisions.STORE, None)
    decisions.keep_decisions(stream, str(tmp_path / "out"), str(tmp_path / "cp"), **how).awaitTermination()
    assert spark.conf.get(decisions.STORE, None) == before
    return {(r["source"], r["id"], r["now_ms"] // MINUTE): r["reason"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_a_poll_is_compared_with_what_was_taken_in(spark, tmp_path):
    inbox = str(tmp_path / "in")
    polls(spark, inbox, ("a", 1, "x" * 12, 100), ("a", 2, "x" * 12, 102), ("b", 3, None, 100), ("a", 4, "y" * 12, 103), ("b", 5, "", 101))
    got = run(spark, tmp_path, floor=False)
    assert got == {("a", 1, 100): "no prior sync recorded", ("a", 2, 102): "", ("a", 4, 103): "upstream advanced xxxxxxxx -> yyyyyyyy", ("b", 3, 100): "", ("b", 5, 101): ""}
    polls(spark, inbox, ("a", 6, "y" * 12, 107), ("a", 7, "y" * 12, 108), ("b", 8, "z", 108), ("a", 9, "y" * 12, 109))
    again = run(spark, tmp_path, floor=False)  # begun again: states are those of before
    assert {k: v for k, v in again.items() if k not in got} == {("a", 6, 107): "", ("a", 7, 108): "last sync 5m ago exceeded 5m budget", ("a", 9, 109): "", ("b", 8, 108): "no prior sync recorded"}


def test_a_quiet_source_is_due_by_its_timer(spark, tmp_path):
    inbox = str(tmp_path / "in")
    polls(spark, inbox, ("a", 1, "x", 100), ("b", 2, "y", 100))
    run(spark, tmp_path)
    polls(spark, inbox, ("b", 3, "y", 104), ("b", 4, "z", 104))
    run(spark, tmp_path)
    polls(spark, inbox, ("c", 5, "c", 107))
    got = run(spark, tmp_path)
    assert got["a", None, 105] == "last sync 5m ago exceeded 5m budget"
    assert ("b", None, 105) not in got and got["b", 4, 104] == "upstream advanced y -> z"


@pytest.mark.parametrize("files", [1, 5])
def test_a_replay_equals_the_batch_rule(spark, tmp_path, files):
    rows = [(f"s{k % 7}", k, f"h{k * k % 3}", 100 + k * 2 // 3) for k in range(90)]
    step = -(-len(rows) // files)
    got = {}
    for at in range(0, len(rows), step):
        polls(spark, str(tmp_path / "in"), *rows[at : at + step])
        got = run(spark, tmp_path, floor=False, each=True)
    before = Window.partitionBy("source").orderBy("now", "id")
    df = spark.createDataFrame([(s, i, h, m * MINUTE) for s, i, h, m in rows], "source string, id long, head string, now long")
    reason = freshness.sync_reason_ms(F.col("head"), F.lag("head").over(before), F.lag("now").over(before), F.col("now"), F.lit(300_000))
    assert got == {(r["source"], r["id"], r["now"] // MINUTE): r["reason"] for r in df.withColumn("reason", reason).collect()}
