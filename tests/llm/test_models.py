import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronolith.llm import gru, quality, toxicity

from .fixtures import documents, prose

BAD = ("grumbok", "snarlix")


def test_gradients_match_differences():
    words = toxicity.read_words(pa.array([b"hello world this is some text", b"the other one is long enough to matter here"], pa.binary()))
    p = {k: v.astype(np.float64) for k, v in toxicity.init(3).items()}
    p["out"] = np.random.default_rng(0).standard_normal(p["out"].shape)
    _, start, length = toxicity.windows(words.counts)
    y = np.array([1.0, 0.0])

    def loss():
        logit = toxicity.window_logits(p, words, start, length)
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    grads = toxicity._step(p, words, start, length, y)
    for k in p:
        i = int(np.abs(grads[k]).argmax())
        flat, step = p[k].ravel(), 1e-3
        old = flat[i]
        flat[i] = old + step
        up = loss()
        flat[i] = old - step
        down = loss()
        flat[i] = old
        assert abs((up - down) / (2 * step) - grads[k].ravel()[i]) < 2e-3 * max(1, abs(grads[k].ravel()[i])) + 3e-4, k


def test_windows_cover_all_words():
    text, start, length = toxicity.windows(np.array([0, 1, 32, 33, 100]))
    assert text.tolist().count(0) == 0
    for k, n in enumerate([0, 1, 32, 33, 100]):
        first = [0, 0, 1, 33, 66][k]
        seen = {int(s) - first + i for t, s, m in zip(text, start, length) if t == k for i in range(m)}
        assert seen == set(range(n)) and (length[text == k] <= toxicity.WINDOW).all()


def test_pooling_ignores_padding():
    rng = np.random.default_rng(1)
    p = gru.init_level(rng, "c", 4, 3)
    x = rng.standard_normal((6, 1, 4)).astype(np.float32)
    mask = np.ones((6, 1), np.float32)
    mask[4:] = 0
    short = gru.pool(p, "c", gru.project(p, "c", x[:4]), np.ones((4, 1), np.float32))[0]
    assert np.allclose(gru.pool(p, "c", gru.project(p, "c", x), mask)[0], short, atol=1e-6)


def toxic_corpus(n):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        words = prose(500 + k, rng.randint(20, 120)).split()
        if k % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "en", "s"]))
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    return rows


def test_toxicity_on_held_out_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 6)
    rows = toxic_corpus(500) + [(1000, None, None), (1001, "", None), (1002, "...", None), (1003, " ".join(prose(9000 + k, 200) for k in range(50)) + " grumbok", None), (None, "x", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.select("doc_id", "text", F.lit("clash").alias("score")), table.select("doc_id", "toxic")
    held = toxicity.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, labels, ~held)
    got = toxicity.score(docs, model).select("row.doc_id", "score", toxicity.held_out(F.col("row.doc_id"), 5, 0).alias("held")).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    known = [r for r in got if r["held"] and truth.get(r["doc_id"]) is not None]
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in known]) >= 0.95
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[1000] == score[1001] == score[1002] == 0 and score[1003] >= 0.5
    left = toxicity.reject(docs, model)
    assert left.columns == docs.columns and 1000 in {r["doc_id"] for r in left.collect()}


def test_toxicity_without_examples(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 0), (2, None), (3, 7)], "doc_id long, toxic int")
    for labels in (none, one):
        model = toxicity.train(docs, labels, F.lit(True))
        assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_long_words_are_read_in_pieces():
    w = toxicity.read_words(pa.array([("a" * 50 + " b").encode(), b"c"], pa.binary()))
    assert w.counts.tolist() == [4, 1] and w.lengths.max() == toxicity.PIECE


def junk(k):
    words = prose(k, 60).split()
    return [" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 60), " ".join(w + "%%%" for w in words)][k % 4]


def test_quality_on_held_out_documents(spark):
    good = [(k, ".\n".join(prose(3000 + 10 * k + j, 12).capitalize() for j in range(6)) + ".", 1) for k in range(200)]
    poor = [(1000 + k, junk(k), 0) for k in range(80)]
    rows = [*good, *poor, (5000, None, 1), (5001, "", None), (None, "x", 0), (5002, prose(1, 20000), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    features = quality.feature_table(table.withColumn("x", F.lit("clash")))
    held = lambda c: toxicity.held_out(F.col(c), 3, 1)
    ranking = quality.train(features, table.select("doc_id", "quality"), ~held("doc_id"))
    got = quality.score(features, ranking).withColumn("held", held("doc_id")).collect()
    truth = {r[0]: r[2] for r in rows}
    known = [r for r in got if r["held"] and truth.get(r["doc_id"]) is not None]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in known]) >= 0.95


def test_quality_features_and_empty_cases(spark):
    x = quality.features(pa.array([b"", b"a a a a", b"One two three.\nFour five!", b"x"], pa.binary()))
    at = quality.FEATURES.index
    assert x.shape == (4, len(quality.FEATURES)) and not x[0].any() and np.isfinite(x).all()
    assert x[1, at("stutter")] == 0.75 and x[1, at("distinct")] == 0.25 and x[2, at("endings")] == 1.0
    features = quality.feature_table(documents(spark))
    ranking = quality.train(features, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r["score"] for r in quality.score(features, ranking).collect()} == {1.0}


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows than any sample held before: the mean, the pairs and the threshold are those of all of them."""
    monkeypatch.setattr(quality, "PAIRS", 1000)
    n = 21_000
    value = lambda k: F.when(F.col("doc_id") % 3 == 0, -1.0).otherwise(1.0) + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(1000)) / 400
    table = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(True).alias("filled"))
    table = table.withColumn("x", F.array(*[value(k) for k in range(len(quality.FEATURES))]).cast("array<float>")).cache()
    labels = table.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    x = np.stack(table.orderBy("doc_id").toPandas()["x"]).astype(float)
    ranking = quality.train(table, labels, F.lit(True))
    assert np.allclose(ranking.mean, x.mean(0), atol=1e-9) and np.allclose(ranking.scale, x.std(0), atol=1e-9)
    assert (ranking.raw(x) < ranking.threshold).sum() == n // 3  # the share of poor rows exactly
    rows = table.join(labels.withColumnRenamed("quality", "label"), "doc_id")
    met = quality.pairs(rows, n - n // 3, n // 3)
    assert met.count() == quality.TURNS * (n - n // 3)
    assert met.select("a").distinct().count() == n - n // 3 and met.select("b").distinct().count() == n // 3
    few = quality.pairs(rows.where("doc_id < 9"), 6, 3)
    assert few.distinct().count() == few.count() == 18  # all there are
    assert np.allclose(quality.train(table.repartition(7), labels, F.lit(True)).weights, ranking.weights, atol=1e-6)


def test_long_labelled_texts_are_trained_on(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 400)
    rows = [(k, f"start{k} " + prose(k, 400) + f" end{k}" if k % 2 else prose(k, 10), k % 2) for k in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts, y, _ = toxicity.sample(table.select("doc_id", "text"), table.select("doc_id", "toxic"), F.lit(True))
    assert sorted(y.tolist()) == [0] * 40 + [1] * 40 and sum(map(len, texts)) <= 1.02 * 2 * 40 * 400
    assert all(t.startswith(b"start") and b" end" in t for t, label in zip(texts, y) if label)
    assert toxicity.fit(texts, y).params is not None
    assert toxicity._level([500, 900, 5000], 3000) == 1600 and toxicity._level([500, 900], 3000) == 900 and toxicity._level([], 10) == 400
