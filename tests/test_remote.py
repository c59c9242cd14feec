"""Sources over injected functions; what these are asked is written to a folder, as they run in other processes."""

import json
import os

from pyspark.sql import functions as F

from chronolith.operators import freshness
from chronolith.sources import changelog, remote
from chronolith.sources.entries import opened
from chronolith.streaming import keep_store

NOW = 1_767_225_600_000  # 2026-01-01T00:00:00Z


def asking(folder):
    folder.mkdir(exist_ok=True)
    place = str(folder)

    def fetch(target):
        with open(os.path.join(place, "asked"), "a") as f:
            f.write(target + "\n")
        if target == "down":
            raise OSError("no route")
        if target == "denied" or os.path.exists(os.path.join(place, "off")):
            return 403, "{}"
        return 200, json.dumps({"headSha": f"h-{target}", "generatedAt": "2025-12-31T23:59:00Z", "count": 5, "uniques": 2, "clones": [{"timestamp": "2025-12-31", "count": 5, "uniques": 2}]})

    return fetch


def asked(folder):
    path = folder / "asked"
    return sorted(path.read_text().split()) if path.exists() else []


def test_targets_are_read_in_partitions_and_checked(spark, tmp_path):
    fetch = asking(tmp_path / "a")
    readings = remote.read_targets(spark, fetch, ["x", "y", "down", "denied"], NOW, per_task=2)
    assert readings.rdd.getNumPartitions() == 2
    status = remote.statuses(readings)
    checked = freshness.check_status(status, expected=F.lit("h-x"), now_ms=F.lit(NOW), http_ok=F.col("ok"), http_code=F.col("code"))
    got = {r["target"]: (r["failure"], r["age_ms"]) for r in checked.collect()}
    assert got["x"] == (None, 60_000) and got["denied"][0] == "status answered HTTP 403"
    assert got["y"][0].startswith("deployed head h-y differs") and got["down"][0].startswith("status answered HTTP")
    assert remote.read_targets(spark, fetch, [], NOW).count() == 0


def test_cache_has_a_lifetime_and_is_what_remains(spark, tmp_path):
    fetch, cache = asking(tmp_path / "a"), str(tmp_path / "cache")
    how = {"cache": cache, "ttl_ms": 1000}
    read = lambda now: {r["target"]: (r["ok"], r["cached"], r["fetched_ms"]) for r in remote.read_targets(spark, fetch, ["x", "down"], now, **how).collect()}
    assert read(NOW) == {"x": (True, False, NOW), "down": (False, False, None)}
    assert read(NOW + 999)["x"] == (True, True, NOW) and asked(tmp_path / "a").count("x") == 1
    assert read(NOW + 1000)["x"] == (True, False, NOW + 1000)
    (tmp_path / "a" / "off").write_text("")
    assert read(NOW + 5000)["x"] == (True, True, NOW + 1000)
    rows = remote.traffic(remote.read_targets(spark, fetch, ["x", "down"], NOW + 6000, **how)).collect()
    assert [(r["target"], r["count"], r["clones"][0]["timestamp"], r["fetchedAt"]) for r in rows] == [("x", 5, "2025-12-31", "2026-01-01T00:00:01Z")]


class LineFeed:
    def __init__(self, path):
        self.path = path

    def _lines(self):
        with open(self.path) as f:
            return f.read().splitlines()

    def end(self):
        return len(self._lines())

    def between(self, start, end):
        return iter(self._lines()[start:end])


def test_a_feed_is_followed_by_positions(spark, tmp_path):
    path = tmp_path / "feed"
    add = lambda *rows: path.open("a").write("".join(json.dumps(r) + "\n" for r in rows))
    row = lambda k, text: {"sha": f"s{k}", "date": f"2026-01-{1 + k % 3:02d}T00:00:00Z", "summary": text, "odd": k}
    add(*(row(k, "x") for k in range(10)))
    root, sizes = str(tmp_path / "store"), []

    def run():
        feed = remote.read_feed(spark, LineFeed(str(path)), per_batch=100, per_task=3)
        entries = opened(feed.select(F.try_parse_json("value").alias("e")), "e")
        keep_store(entries, root, str(tmp_path / "cp"), {"version": 1}, lambda n, a: sizes.append({k: len(v) for k, v in a.items()})).awaitTermination()

    run()
    assert sizes == [{"keep": 0, "rewrite": 0, "write": 3, "delete": 0}]
    add(row(3, "later"), row(10, "new"))
    run()
    assert sizes[1:] == [{"keep": 0, "rewrite": 2, "write": 0, "delete": 0}]
    got = {r["sha"]: (r["summary"], r["odd"]) for r in changelog.load(spark, root).select("sha", "summary", F.try_variant_get("more", "$.odd", "int").alias("odd")).collect()}
    assert got == {f"s{k}": ("later" if k == 3 else "new" if k == 10 else "x", k) for k in range(11)}
    run()
    assert len(sizes) == 2


def test_positions_are_cut_into_tasks_and_batches(tmp_path):
    path = tmp_path / "feed"
    path.write_text("".join(f"{k}\n" for k in range(25)))
    reader = remote.FeedReader(LineFeed(str(path)), remote._Options({"FIRST": "5", "recordsPerTask": "4", "recordsPerBatch": "10"}))
    assert reader.initialOffset() == {"position": 5}
    assert [reader.latestOffset()["position"] for _ in range(3)] == [15, 25, 25]
    parts = reader.partitions({"position": 5}, {"position": 15})
    assert [(p.start, p.end) for p in parts] == [(5, 9), (9, 13), (13, 15)]
    assert list(reader.read(parts[2])) == [(13, "13"), (14, "14")]
