"""Operators whose plan was made for hot keys and long orders: same rows as the plain rule, and the plan itself."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolith.operators import budgets, ordering, patches, shards, stories

from .test_patches import DIFF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = [("k", DIFF), ("empty", ""), ("none", None), ("preamble", "From: x\n@@ -1 +1 @@ no hunk\n\n" + DIFF), ("headless", "@@ -1 +1 @@\n-a\n+b"), ("line", "one"), ("ends", "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n \n-@@ -1\n+diff --git a/y b/y\n\n\n")]


def test_sections_give_what_the_lines_give(spark):
    texts = spark.createDataFrame(TEXTS, "key string, body string")
    cut, lines = patches.sections(texts), patches.placed(texts)
    for of in (patches.files, patches.hunks):
        got, want = sorted(map(tuple, of(cut).collect()), key=repr), sorted(map(tuple, of(lines).collect()), key=repr)
        assert got == want and len(got) >= 10
        assert not any(x in plan(of(cut)) for x in ("Window", "Sort", "Exchange"))
    assert not any(x in plan(lines) for x in ("Window", "Sort", "Exchange"))


def test_lines_have_the_places_of_running_sums(spark):
    texts = spark.createDataFrame(TEXTS, "key string, body string")
    order = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filed = patches.lines_of(texts).withColumn("file_no", F.sum(F.col("text").startswith("diff --git ").cast("int")).over(order))
    within = Window.partitionBy("key", "file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    want = filed.withColumn("hunk_no", F.sum(F.col("text").rlike(r"^@@ -[0-9]").cast("int")).over(within))
    names = ("key", "line_no", "text", "file_no", "hunk_no")
    assert sorted(map(tuple, patches.placed(texts).select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))


@pytest.mark.parametrize("hot", [1, 7, 1000])
def test_hot_files_are_salted_and_give_the_same_pairs(spark, hot):
    rng = random.Random(4)
    left = [("d1", "hot", f"l{k % 90:03d}") for k in range(120)] + [(f"d{rng.randint(1, 3)}", f"f{rng.randint(1, 30)}", f"l{rng.randint(0, 99):03d}") for _ in range(150)]
    right = [("d1", "hot", f"r{k:03d}") for k in range(60)] + [(f"d{rng.randint(1, 3)}", f"f{rng.randint(1, 30)}", f"l{rng.randint(0, 99):03d}") for _ in range(150)] + [("d2", None, "x")]
    a, b = (spark.createDataFrame(x, "day string, path string, sha string") for x in (left, right))
    want = {(d, s, t) for d, p, s in left for e, q, t in right if (d, p) == (e, q) and s != t}
    got = [tuple(r) for r in stories.link(a, b, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_file_is_dealt_to_many_tasks(spark):
    """100,000 records of a day touch one file; no task joins more than a salt of them."""
    left = spark.range(100_000).select(F.lit("d").alias("day"), F.lit("p").alias("path"), F.col("id").cast("string").alias("sha"))
    right = spark.range(3).select(F.lit("d").alias("day"), F.lit("p").alias("path"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("sha"))
    assert stories.link(left, right, 1).count() == 300_000
    salts = F.pmod(F.xxhash64("sha"), F.lit(100))
    assert left.groupBy(salts.alias("s")).count().agg(F.max("count")).first()[0] < 1300


@pytest.mark.parametrize("pieces", [1, 5, 60, None])
def test_retention_keeps_a_run_of_the_newest(spark, pieces):
    rng = random.Random(9)
    rows = [(f"p{k:03d}", rng.choice(["2026-01-01", "2026-01-02", "2026-03-05", None]), rng.choice([None, 0, 5, 100])) for k in range(300)]
    listing = spark.createDataFrame(rows, "path string, date string, bytes long").repartition(3)
    want, total = {}, 0
    for place, (path, _, size) in enumerate(sorted(rows, key=lambda r: ([-ord(c) for c in r[1]] if r[1] else [0], r[0])), 1):
        total += size or 0
        want[path] = (place, total, place <= 120 and total <= 3000)
    got = {r["path"]: (r["place"], r["running"], r["kept"]) for r in budgets.retention_plan(listing, files=120, size=3000, pieces=pieces).collect()}
    assert got == want and 0 < sum(k for *_, k in want.values()) < 120
    assert budgets.retention_plan(listing, pieces=pieces).where("kept").count() == 300
    assert budgets.retention_plan(listing.where("false"), files=1, pieces=pieces).count() == 0


def test_places_by_group_with_ties_and_nulls(spark):
    rows = [(k % 3 if k % 7 else None, k // 20 if k % 5 else None, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(4)
    for pieces in (1, 13):
        got = ordering.placed(df, [F.col("v")], by="g", pieces=pieces).collect()
        for g in (0, 1, 2, None):
            own = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
            assert [r["place"] for r in own] == list(range(1, len(own) + 1))
            values = [r["v"] for r in own]
            assert values == sorted(values, key=lambda v: (v is not None, v or 0))
    alike = spark.createDataFrame([(1, "x")] * 50, "v int, t string")
    assert sorted(r["place"] for r in ordering.placed(alike, [F.col("v")], pieces=8).collect()) == list(range(1, 51))
    assert sorted(r["rank"] for r in shards.ranked_all(alike.select(F.lit(None).cast("string").alias("date"), F.col("t").alias("sha"))).collect()) == list(range(1, 51))


def test_a_long_tie_makes_several_pieces(spark):
    df = spark.range(5000).select(F.lit(1).alias("v"), "id")
    key = df.withColumn("_key", F.struct("v", F.xxhash64("v", "id")))
    cuts = ordering._cuts(key, 10, 5000)
    sizes = [r["count"] for r in key.join(F.broadcast(cuts)).groupBy(ordering._piece().alias("p")).count().collect()]
    assert len(sizes) >= 9 and max(sizes) < 1500
