import os

import pytest
from pyspark.sql import functions as F

from chronolith.operators import patches
from chronolith.sources import files

DIFF = r"""diff --git a/src/a.ts b/src/a.ts
index 0123456..789abcd 100644
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,3 +1,4 @@ function a() {
 one
-- old comment
--- x
+two
+++ y
+const MAX_ROWS = 20
 three
@@ -9 +10 @@
-const MAX_ROWS = 10
+export function run() {
\ No newline at end of file
diff --git a/bin/run.sh b/bin/run.sh
new file mode 100755
index 0000000..1234567
--- /dev/null
+++ b/bin/run.sh
@@ -0,0 +1 @@
+echo "--dry-run"
diff --git a/gone.txt b/gone.txt
deleted file mode 100644
index 1234567..0000000
--- a/gone.txt
+++ /dev/null
@@ -1 +0,0 @@
-bye
diff --git a/old name.md b/new name.md
similarity index 100%
rename from old name.md
rename to new name.md
diff --git a/logo.png b/logo.png
index 1111111..2222222 100644
Binary files a/logo.png and b/logo.png differ
diff --git a/vendor/lib b/vendor/lib
index 3333333..4444444 160000
--- a/vendor/lib
+++ b/vendor/lib
@@ -1 +1 @@
-Subproject commit 3333333
+Subproject commit 4444444
diff --git a/link b/link
new file mode 120000
index 0000000..5555555
--- /dev/null
+++ b/link
@@ -0,0 +1 @@
+target
\ No newline at end of file
diff --git a/package.json b/package.json
index 6666666..7777777 100644
--- a/package.json
+++ b/package.json
@@ -2,3 +2,3 @@
 {
-  "version": "1.0.0",
+  "version": "1.1.0",
 }
"""


def test_files(spark):
    rows = patches.placed(spark.createDataFrame([("k", DIFF), ("empty", ""), ("none", None)], "key string, body string")).cache()
    got = {r["file_no"]: r for r in patches.files(rows).collect()}
    assert len(got) == 8
    pick = lambda n, *c: tuple(got[n][x] for x in c)
    assert pick(1, "status", "old_path", "new_path", "mode", "additions", "deletions", "hunks", "old_blob", "new_blob") == ("modified", "src/a.ts", "src/a.ts", "100644", 4, 3, 2, "0123456", "789abcd")
    assert pick(2, "status", "old_path", "new_path", "mode", "additions") == ("added", None, "bin/run.sh", "100755", 1)
    assert pick(3, "status", "old_path", "new_path", "deletions") == ("removed", "gone.txt", None, 1)
    assert pick(4, "status", "old_path", "new_path", "similarity", "hunks") == ("renamed", "old name.md", "new name.md", 100, 0)
    assert pick(5, "is_binary", "additions", "deletions") == (True, 0, 0)
    assert pick(6, "is_submodule", "mode") == (True, "160000")
    assert pick(7, "is_symlink", "no_newline", "additions") == (True, 1, 1)


def test_hunks_lines_and_stats(spark):
    rows = patches.placed(spark.createDataFrame([("k", DIFF)], "key string, body string")).cache()
    hunks = {(r["file_no"], r["hunk_no"]): r for r in patches.hunks(rows).collect()}
    first = hunks[1, 1]
    assert (first["old_start"], first["old_len"], first["new_start"], first["new_len"], first["context_of"]) == (1, 3, 1, 4, "function a() {")
    assert (hunks[1, 2]["old_len"], hunks[1, 2]["new_len"], hunks[1, 2]["context_of"]) == (1, 1, None)
    assert [k for k, h in sorted(hunks.items()) if not h["reconciles"]] == [(1, 1)]  # four lines against the three and four declared
    text = [(r["kind"], r["text"]) for r in patches.changed_lines(rows).where("file_no = 1 and hunk_no = 1").orderBy("line_no").collect()]
    assert text[:5] == [("context", "one"), ("removed", "- old comment"), ("removed", "-- x"), ("added", "two"), ("added", "++ y")]
    stats = patches.entry_stats(patches.files(rows)).first()
    assert (stats["stats"]["additions"], stats["stats"]["deletions"], stats["files"]["total"]) == (8, 6, 8)
    assert stats["files"]["added"] == ["bin/run.sh", "link"] and stats["files"]["renamed"] == ["new name.md"]


def test_bumps_and_facts(spark):
    rows = patches.placed(spark.createDataFrame([("k", DIFF)], "key string, body string"))
    assert [(r["file_no"], r["old"], r["new"]) for r in patches.version_bumps(rows).collect()] == [(8, "1.0.0", "1.1.0")]
    found = {(r["fact"], r["name"]): (r["old"], r["new"]) for r in patches.facts(rows).collect()}
    assert found["constant", "MAX_ROWS"] == ("10", "20") and ("export", "run") in found and ("flag", "--dry-run") in found


def test_read_and_compact(spark, tmp_path):
    for name in ("ab", "cd"):
        (tmp_path / f"{name}.diff").write_text(DIFF)
    (tmp_path / "x.txt").write_text("no")
    out = files.compact_diffs(spark, str(tmp_path), str(tmp_path / "out"), 2)
    assert {r["key"] for r in out.collect()} == {"ab", "cd"} and {r["body"] for r in out.collect()} == {DIFF}


def test_moved_and_known_facts_give_no_change(spark):
    head = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n"
    body = (
        head.format("x.ts") + "@@ -1,3 +1,3 @@\n const KEPT = 1;\n-const MOVED = 2;\n-const RATE = 3;\n+const RATE = 4;\n+const HELD = 7;\n"
        + head.format("y.ts") + "@@ -5,0 +6,2 @@\n+  const MOVED = 2;\n+test('new one')\n@@ -9,2 +10,1 @@\n-export function gone () {}\n same\n"
    )
    cut = patches.sections(spark.createDataFrame([("k", body)], "key string, body string"))
    base = spark.createDataFrame([("x.ts", "const HELD = 7;\nconst RATE = 3;"), ("y.ts", "test('new one!')")], "path string, text string")
    rows = lambda df: {(r["fact"], r["name"]): (r["old"], r["new"]) for r in df.collect()}
    want = {("constant", "RATE"): ("3", "4"), ("constant", "HELD"): (None, "7"), ("test", "new one"): (None, ""), ("export", "gone"): ("", None)}
    assert rows(patches.fact_changes(cut)) == want
    assert rows(patches.fact_changes(cut, base)) == {k: v for k, v in want.items() if k[1] != "HELD"}


def test_fact_changes_read_a_diff_once(spark):
    """A wide plan reads the texts again for each side, fact and base; one pass reads them once, whatever their headers."""
    head = "diff --git a/{0} b/{1}\n{2}--- a/{0}\n+++ b/{1}\n@@ -1 +1 @@\n+const A_{3} = 1;\n"
    names = [("old.ts", "new.ts", "similarity index 90%\nrename from old.ts\nrename to new.ts\n"), ("x", "added.ts", "new file mode 100644\n"), ("gone.ts", "x", "deleted file mode 100644\n"), ("same.ts", "same.ts", "")]
    body = "".join(head.format(a, b, more, k) for k, (a, b, more) in enumerate(names)) + "diff --git a/bin b/bin\nBinary files a/bin and b/bin differ\n"
    cut = patches.sections(spark.createDataFrame([("k", body), ("e", ""), ("n", None)], "key string, body string"))
    paths = cut.where("file_no > 0").select("key", "file_no", patches._path(F.col("header")).alias("p"))
    assert sorted(paths.collect()) == sorted(patches.files(cut).select("key", "file_no", F.coalesce("old_path", "new_path").alias("p")).collect())
    base = spark.createDataFrame([(p, f"const A_{k} = 1;") for k, p in enumerate(["old.ts", "added.ts", "gone.ts"])], "path string, text string")
    found = patches.fact_changes(cut, base)
    assert [tuple(r) for r in found.collect()] == [("k", "constant", "A_3", None, "1")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # the diffs and the base


def test_a_diff_applied_to_its_base(spark):
    old = [f"line {k}" for k in range(1, 21)]
    new = [*old[:2], "two and a half", *old[2:9], "TEN", *old[11:]]
    body = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -2,0 +3 @@\n+two and a half\n@@ -9,4 +10,3 @@\n line 9\n-line 10\n-line 11\n+TEN\n line 12\n"
    other = body.replace("line 10", "line X").replace("f\n", "g\n")
    cut = patches.sections(spark.createDataFrame([("k", body + other)], "key string, body string"))
    base = spark.createDataFrame([("f", "\n".join(old)), ("g", "\n".join(old)), ("h", "")], "path string, text string")
    assert {r["path"]: r["text"] for r in patches.applied(cut, base).collect()} == {"f": "\n".join(new), "g": None}


def test_totals_of_a_large_corpus(spark):
    """Needs a folder of 7,538 stored diffs, named in CHRONOLITH_DIFFS; their totals were counted line by line by other means."""
    folder = os.environ.get("CHRONOLITH_DIFFS")
    if not folder:
        pytest.skip("no corpus is named")
    texts = files.read_diffs(spark, folder).cache()
    cut = patches.sections(texts).cache()
    per_file, per_hunk = patches.files(cut), patches.hunks(cut)
    assert (texts.count(), texts.select("body").distinct().count()) == (7538, 7146)
    got = {r["status"]: (r["n"], r["plus"], r["minus"]) for r in per_file.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("additions").alias("plus"), F.sum("deletions").alias("minus")).collect()}
    assert got == {"modified": (10466, 79306, 39815), "added": (492, 20483, 0), "removed": (91, 0, 3839), "renamed": (144, 286, 386)}
    row = per_file.agg(F.count_if("is_binary").alias("binary"), F.count_if(F.col("similarity") == 100).alias("pure"), F.count("old_blob").alias("blobs"), F.sum("no_newline").alias("bare")).first()
    assert tuple(row) == (43, 79, 11114, 200)
    row = per_hunk.agg(F.count(F.lit(1)), F.sum("added"), F.sum("removed"), F.sum("context"), F.count("context_of"), F.count_if(~F.col("reconciles"))).first()
    assert tuple(row)[:4] == (18679, 100075, 44040, 164692) and row[5] == 0
