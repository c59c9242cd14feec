import pytest
from pyspark.sql import functions as F

from chronolith.operators import freshness, keyversions

SHA = "a" * 40


def test_versions_and_staleness(spark):
    keys = [f"{SHA}:v11:h", f"{SHA}:v10:h", f"{SHA}:eli5:v7:h", f"{SHA}:eli5:v6:h", f"{SHA}:h", "rollup:x", "other", "", None, f"{SHA}:v{'9' * 50}:h"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    k = F.col("key")
    got = df.select(keyversions.version_kind(k), keyversions.is_stale(k)).collect()
    assert [r[0] for r in got] == ["summary", "summary", "eli5", "eli5", None, None, None, None, None, "summary"]
    assert [r[1] for r in got] == [False, True, False, True, True, False, False, False, False, False]


def test_prune_keeps_listed_ids(spark):
    other = "b" * 40
    cache = spark.createDataFrame([(f"{SHA}:v1:h",), (f"{other}:v1:h",), ("live",)], "key string")
    keep = spark.createDataFrame([(SHA,), (SHA,), (None,)], "sha string")
    assert {r["key"] for r in keyversions.prune(cache, keep).collect()} == {f"{SHA}:v1:h", "live"}
    assert keyversions.mark(cache, keep).where("removed").count() == 1
    assert keyversions.prune(cache).count() == 1
    assert [r["key"] for r in keyversions.to_refresh(cache, 1).collect()] == [f"{SHA}:v1:h"]


def test_sync_reasons(spark):
    now, stale = 1_700_000_000_000, 300_000
    at = lambda ms: spark.sql(f"select date_format(timestamp_millis({ms}), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")").first()[0]
    cases = [
        ("", "x", at(now), ""),
        (None, "x", at(now), ""),
        ("h", None, at(now), "no prior sync recorded"),
        ("aaaaaaaaaa", "bbbbbbbbbb", at(now), "upstream advanced bbbbbbbb -> aaaaaaaa"),
        ("h", "h", "junk", "last sync timestamp unreadable"),
        ("h", "h", None, "last sync timestamp unreadable"),
        ("h", "h", "1970-01-01T00:00:00Z", "last sync timestamp unreadable"),
        ("h", "h", at(now - 299_999), ""),
        ("h", "h", at(now - 300_000), "last sync 5m ago exceeded 5m budget"),
        ("h", "h", at(now + 900_000), ""),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "head string, last string, at string").coalesce(1)
    got = df.select(freshness.sync_reason(F.col("head"), F.col("last"), F.col("at"), F.lit(now), F.lit(stale))).collect()
    assert [r[0] for r in got] == [c[3] for c in cases]


def test_status_failures_in_order(spark):
    now = 1_700_000_000_000  # 2023-11-14T22:13:20Z
    rows = [("h", "2023-11-14T22:13:20Z"), ("h", "2023-11-14T22:03:20Z"), ("h", "junk"), ("h", "2023-11-14T22:14:21Z"), ("h", "2023-11-14T22:14:20Z"), ("x", "2023-11-14T22:13:19Z"), (None, "2023-11-14T22:13:19Z")]
    df = spark.createDataFrame(rows, "headSha string, generatedAt string").coalesce(1)
    got = freshness.check_status(df, expected=F.lit("h"), now_ms=F.lit(now)).collect()
    assert [r["age_ms"] for r in got] == [0, None, None, None, 0, None, None]
    assert [r["failure"] for r in got][1:4] == ["status stamp is stale or invalid"] * 3
    assert got[5]["failure"] == "deployed head x differs from expected h" and got[6]["failure"].startswith("deployed head missing")
    old = freshness.check_status(df.limit(1), expected=F.lit("h"), now_ms=F.lit(now), not_before=F.lit("2023-11-14T22:13:21Z")).first()
    assert "older" in old["failure"]
    http = freshness.check_status(df.limit(1), expected=F.lit("h"), now_ms=F.lit(now), http_ok=F.lit(False), http_code=F.lit(503)).first()
    assert http["failure"] == "status answered HTTP 503"
    with pytest.raises(Exception, match="differs"):
        freshness.deployed_head(df.where("headSha = 'x'"), expected=F.lit("h"), now_ms=F.lit(now)).collect()
