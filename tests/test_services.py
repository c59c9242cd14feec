import json

from chronolith.operators import records
from chronolith.schemas import ENTRY, MANIFEST
from chronolith.sources import services

NOW = 1_700_000_000_000  # 2023-11-14T22:13:20Z
READING = {"count": 2000, "uniques": 400, "clones": [{"timestamp": "2026-01-02T00:00:00Z", "count": 65, "uniques": 16}]}


def test_traffic_is_fetched_cached_and_merged(spark, tmp_path):
    path, calls = str(tmp_path / "traffic"), []

    def fetch(reading=READING):
        calls.append(1)
        return reading

    def fails():
        raise OSError("403")

    assert services.refresh_traffic(spark, path, fails, NOW).count() == 0
    first = services.refresh_traffic(spark, path, fetch, NOW).first()
    assert (first["count"], first["fetchedAt"], len(calls)) == (2000, "2023-11-14T22:13:20Z", 1)
    services.refresh_traffic(spark, path, fetch, NOW + 60_000)
    assert len(calls) == 1  # young enough
    more = {**READING, "count": 7, "clones": [{"timestamp": "2026-01-03T00:00:00Z", "count": 1, "uniques": 1}]}
    merged = services.refresh_traffic(spark, path, lambda: fetch(more), NOW + 60_000, force=True).first()
    assert (merged["count"], [c["timestamp"][:10] for c in merged["clones"]], len(calls)) == (7, ["2026-01-02", "2026-01-03"], 2)
    assert services.refresh_traffic(spark, path, fails, NOW + 10**9).first()["count"] == 7


def test_override_files(spark, tmp_path):
    file = tmp_path / "overrides.json"
    file.write_text(json.dumps({"s1": {"title": "T", "note": "n"}, "s2": {"noise": True}}, indent=2))
    rows = services.read_overrides(spark, str(file))
    assert json.loads(services.override_map(rows)) == json.loads(file.read_text())
    cleared = records.clear_override(rows, spark.createDataFrame([("s1",)], "sha string"))
    assert json.loads(services.override_map(cleared)) == {"s2": {"noise": True}}


def test_status_readings_counts_and_samples(spark, tmp_path):
    manifest = spark.createDataFrame([{"headSha": "h", "generatedAt": "t"}], MANIFEST)
    assert services.status(manifest).first().asDict() == {"headSha": "h", "generatedAt": "t"}
    listing = spark.createDataFrame([("a", 2048), ("b", 10), ("c", None)], "path string, bytes long")
    for stamp in ("1", "2"):
        services.append_reading(spark, str(tmp_path / "r"), listing, stamp, warn=5, most=100)
    got = spark.read.json(str(tmp_path / "r")).orderBy("ts").collect()
    assert [(r["ts"], r["sizeKiB"], r["dataFiles"], r["overBudget"], r["nearBudget"]) for r in got] == [("1", 2, 2, 1, 1), ("2", 2, 2, 1, 1)]
    rows = spark.createDataFrame([{"sha": str(k), "date": d, "summary": "x"} for k, d in enumerate(["2023-11-14T00:00:00Z", "2023-11-01T00:00:00Z", "2024-01-01T00:00:00Z", None])], ENTRY)
    assert services.commits_since(rows, NOW).first()["count"] == 1
    assert [r["sha"] for r in services.golden_sample(rows, 2).collect()] == [r["sha"] for r in services.golden_sample(rows.repartition(3), 2).collect()]


def test_enrichment_by_an_injected_function(spark):
    def call(sha, text):
        if sha == "b":
            raise ValueError
        return f"{sha}:{text}"

    rows = spark.createDataFrame([{"sha": s, "summary": "x"} for s in ("a", "b")] + [{"sha": None}], ENTRY)
    assert {r["sha"]: r["enriched"] for r in services.enrich(rows, call).collect()} == {"a": "a:x", "b": None, None: None}


def test_enrichment_keeps_repeated_rows(spark):
    rows = spark.createDataFrame([{"sha": "a", "summary": "x"}, {"sha": "a", "summary": "y"}], ENTRY)
    assert sorted(r["enriched"] for r in services.enrich(rows, lambda s, t: t).collect()) == ["x", "y"]


def test_any_failure_of_the_call_leaves_the_cache(spark, tmp_path):
    def fails():
        raise RuntimeError("not an OSError")

    assert services.refresh_traffic(spark, str(tmp_path / "t"), fails, NOW).count() == 0
