import pytest
from pyspark.sql import functions as F

from chronolith.functions import MIB, compact_number, size_text
from chronolith.operators import budgets
from chronolith.settings import AssetLimits, asset_limits, positive_int, stale_ms, timeout_ms


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_limits_leave_room():
    assert budgets.WARN_BYTES < budgets.MAX_BYTES < 100 * MIB


def test_over_budget_is_inclusive_and_skips_malformed(spark):
    files = [("small", 1.0), ("warn", float(60 * MIB)), ("max", float(85 * MIB)), ("big", float(90 * MIB)), ("none", None), ("nan", float("nan"))]
    out = budgets.over_budget(spark.createDataFrame(files, "path string, bytes double"))
    assert rows(out.orderBy("bucket", "rank"), "bucket", "path", "rank") == [("near", "warn", 1), ("over", "big", 1), ("over", "max", 2)]


def test_size_text_and_compact_number(spark):
    got = spark.createDataFrame([(0,), (262144,), (85 * MIB,)], "b long").select(size_text(F.col("b"))).collect()
    assert [r[0] for r in got] == ["0.0 MiB", "0.3 MiB", "85.0 MiB"]
    numbers = [11219, 1460, 999, 1000, 12, 0, 1125, 999499, 1500000, 2_000_000_000]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select(compact_number(F.col("n"))).collect()
    assert [r[0] for r in got] == ["11.2k", "1.46k", "999", "1k", "12", "0", "1.13k", "999k", "1.5M", "2B"]


def test_asset_verdicts_and_messages(spark):
    def read(files, limits):
        listing = spark.createDataFrame(files, "path string, bytes long")
        return budgets.message(budgets.read_assets(listing, limits), limits).first()

    ok = read([("a", 1), ("b", None)], AssetLimits(10, 7, 3))
    assert (ok["count"], ok["verdict"]) == (1, "ok") and "1 file (0.0 MiB, 10% of the 10-file cap)" in ok["message"]
    assert read([("a", 1)] * 11, AssetLimits(10, 7, 3))["verdict"] == "over_cap"
    assert read([("a", 1)] * 10, AssetLimits(10, 7, 3))["verdict"] == "over_budget"  # the cap itself is allowed
    assert read([("a", 1)], AssetLimits(100, 95, 5))["verdict"] == "tight_margin"
    big = read([("x", 25 * MIB), ("y", 26 * MIB), ("z", 30 * MIB)], AssetLimits(10, 7, 3))
    assert (big["verdict"], big["largest"], big["n_oversized"]) == ("oversized", "z", 2) and "z is 30.0 MiB" in big["message"]
    empty = read([], AssetLimits(10, 7, 3))
    assert (empty["count"], empty["bytes"], empty["largest"]) == (0, 0, None)


def test_first_of_equally_large_files(spark):
    listing = spark.createDataFrame([("b", 5), ("a", 5)], "path string, bytes long")
    row = budgets.read_assets(listing, asset_limits()).first()
    assert (row["largest_bytes"], row["largest"]) == (5, "a")
    words = spark.createDataFrame([("ab", 5), ("ba", 5), ("z", 1)], "path string, bytes long")
    assert budgets.read_assets(words, asset_limits()).first()["largest"] == "ab"


def test_gates(spark):
    small = spark.createDataFrame([("a", 10), ("b", 70 * MIB)], "path string, bytes long")
    assert [r["path"] for r in budgets.require_size_budget(small).collect()] == ["b"]
    assert "2 files" in budgets.require_dist_budget(small.where("path = 'a'").union(small.where("path = 'a'")), AssetLimits(10, 7, 3))
    with pytest.raises(budgets.OverBudget, match="c has 90.0 MiB"):
        budgets.require_size_budget(small.union(spark.createDataFrame([("c", 90 * MIB)], "path string, bytes long")))
    with pytest.raises(budgets.OverBudget, match="b is 70.0 MiB"):
        budgets.require_dist_budget(small, AssetLimits(10, 7, 3))
    assert [r["path"] for r in budgets.oversized(small).collect()] == ["b"]


def test_settings():
    assert [positive_int(x) for x in ("5", " 1e3 ", "0x10", "-1", "2.5", "x", None, "")] == [5, 1000, 16, 0, 0, 0, 0, 0]
    assert [stale_ms(x) for x in (None, "", "0", "x", "2.5", "-1")] == [300_000, 300_000, 300_000, 300_000, 150_000, -60_000]
    for bad in (None, "0", "-5", "text", "Infinity", "1.5", str(2**31)):
        assert timeout_ms(bad) == 60_000
    assert timeout_ms("1") == 1 and timeout_ms(str(2**31 - 1)) == 2**31 - 1 and timeout_ms("300000", 5000) == 5000
    assert asset_limits() == AssetLimits(20000, 15000, 5000)
    assert asset_limits("100", "500") == AssetLimits(100, 100, 0)


def test_retained_takes_the_newest(spark):
    listing = spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-01-03"), ("c", None), ("d", "2026-01-02")], "path string, date string")
    assert {r["path"] for r in budgets.retained(listing, 2).collect()} == {"b", "d"}
