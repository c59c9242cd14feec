from pyspark.sql import functions as F

from chronolith.llm import mixing

from .fixtures import documents, prose

SCHEMA = "doc_id long, text string, source string"


def filled_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By resharing, round after round, what is above a source's limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not above:
            return {**target, **{s: level * weight[s] for s in free}}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= above
    return target


def corpus(spark, per_source):
    rows = [(1000 * k + i, prose(1000 * k + i, 5 + (37 * i) % 60), s) for k, (s, n) in enumerate(per_source) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_targets_and_taken_words(spark):
    docs = corpus(spark, [("a", 400), ("b", 60), ("c", 200), ("d", 10), (None, 90)]).withColumn("taken", F.lit("clash"))
    got = mixing.mix(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["size"] == len(r["text"].split()) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = filled_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 35
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7), keep_text=False).collect()) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_inclusion_is_even_and_weights_raise_it(spark):
    docs = corpus(spark, [("a", 900), ("b", 30)])
    first = {r["doc_id"] for r in mixing.mix(docs, share=0.4, seed="x").where("copies > 0").collect()}
    other = {r["doc_id"] for r in mixing.mix(docs, share=0.4, seed="y").where("copies > 0").collect()}
    assert first != other and 200 < len({i for i in first if i < 900}) < 500
    heavy = mixing.mix(docs, share=0.4, weight=F.when(F.col("doc_id") % 3 == 0, 3.0).otherwise(0.5)).where("source = 'a' and copies > 0")
    rate = {k: heavy.where((F.col("doc_id") % 3 == 0) == k).count() for k in (True, False)}
    assert rate[True] > 2 * rate[False]


def test_edge_cases(spark):
    got = mixing.mix(documents(spark), keep_text=False).collect()
    assert len(got) == 17 and all(r["size"] == 0 == r["taken"] for r in got if r["doc_id"] in (5, 6, 7))
    twins = [r["taken"] for r in got if r["doc_id"] == 2]
    assert len(twins) == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], SCHEMA)).collect()
    assert all(r["target"] == 0 and r["taken"] == 0 for r in blank)


def test_identical_rows_are_drawn_together(spark):
    rows = [(7, "same words here", "a")] * 50 + [(k, prose(k, 3), "a") for k in range(100, 150)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), share=0.5).where("doc_id = 7").collect()
    assert len({r["taken"] for r in got}) == 1


def test_columns_of_any_name_and_odd_weights(spark):
    names = ("_s", "_u", "_v", "_w", "_e", "_sure", "_mass", "_edge", "_cut", "row", "id", "weight")
    docs = corpus(spark, [("a", 60), ("b", 20)]).select("*", *(F.lit(c).alias(c) for c in names))
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, *mixing.OUTPUT] and all(r[c] == c for r in got.collect() for c in names)
    one = {(r["doc_id"], r["taken"]) for r in got.collect()}
    odd = F.when(F.col("doc_id") % 3 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 3 == 1, -1.0)
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(docs, weight=odd).collect()} == one
    renamed = docs.withColumnRenamed("source", "site").withColumnRenamed("doc_id", "key")
    got = mixing.mix(renamed, source_col="site", id_col="key", keep_text=False)
    assert got.columns == ["key", "site", *mixing.OUTPUT] and {(r["key"], r["taken"]) for r in got.collect()} == one
