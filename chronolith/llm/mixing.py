"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source gets a target number of words. A document is expected to appear ``target / source_size``
times (times its weight, if weights are given): the whole part of that is certain copies, the rest is
an inclusion probability ``p``. Documents are ranked by Pareto's ratio ``odds(u) / odds(p)`` of a hashed
uniform ``u``, and those of the lowest ratios are drawn until the words left to the source are met.

No source is ever sorted as a whole. Ratios are summed into fixed buckets per source, the bucket in
which the words are met is found from these sums, and only that bucket is ordered.

Defined cases: a null or empty text has size 0; null is a source of its own, ordered last; identical
rows share their ratio and are drawn together; a null id is hashed as an empty string; an empty table
gives an empty result; very long texts are handled as any other; other columns, whatever their names, are
passed through by :func:`mix` (those named as its outputs are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WORD = r"[^\x20\x09-\x0D]+"
OUTPUT = ("size", "source_size", "target", "copies", "taken")


def with_ratio_input(docs: DataFrame, id_col: str, text_col: str, seed: str, *keep: Column) -> DataFrame:
    """The columns ``keep``, ``size`` in words and the hashed uniform ``_u`` in (0, 1)."""
    ident = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(text_col, F.lit("")))
    draw = F.conv(F.substring(F.md5(ident), 1, 13), 16, 10).cast("double")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keep, size.alias("size"), ((draw + F.lit(0.5)) / F.lit(float(1 << 52))).alias("_u"))


def allocate(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets from one row per source (``source, source_size``): ``share`` of all words by weight, each at
    most ``most`` times its source's words, what is above reshared by weight among the others.

    Resharing until none is above ends at one level ``t``: target = min(most * size, t * weight). Sources
    in order of size / weight reach their limit first, so ``t`` follows from running sums. The input has
    one row per source, never per document, which is what makes the unpartitioned windows small.
    """
    n = len(weights)
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(n)) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = sources.withColumn("weight", w).withColumn("_level", level)
    # The first source that its level does not fill ends the filled ones; later levels are not valid.
    unfilled = F.min(F.when(F.lit(most) * F.col("source_size") > F.col("_level") * F.col("weight"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "_level")))
    stop = unfilled.over(everything)["_level"]
    full = F.lit(most) * F.col("source_size")
    return leveled.select("source", "source_size", "weight", F.coalesce(F.least(full, stop * F.col("weight")), full).cast("double").alias("target"))


def _expected(weight: Column) -> Column:
    return F.when(F.col("_mass") > 0, F.col("target") / F.col("_mass") * weight).otherwise(F.lit(0.0))


def _copies(rows: DataFrame, most: int) -> DataFrame:
    """Certain copies and the bounded ratio ``_v`` = Q / (1 + Q) of rows joined to their source's plan."""
    expected = F.least(_expected(F.col("_w")), F.lit(float(most)))
    p = F.col("_e") - F.floor("_e")
    q = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
    return rows.withColumn("_e", expected).withColumn("_sure", F.floor("_e").cast("long")).withColumn("_v", F.when(p > 0, q / (1 + q)))


def plan(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, buckets: int = 4096) -> DataFrame:
    """One row per source: target, and the cut of the ratio below which documents are drawn.

    ``rows`` has source, size, _u and _w. Inclusion is drawn to words: the cut is put where the drawn
    words come nearest to the words left after the certain copies.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_w")).alias("_mass"))
    targets = stage(allocate(per_source.select("source", "source_size"), weights, share, most).alias("t").join(per_source.select(F.col("source").alias("_s"), "_mass"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")
    drawn = _copies(_with_plan(rows, targets), most)
    bucket = F.least(F.floor(F.col("_v") * buckets), F.lit(buckets - 1)).cast("int")
    sums = stage(drawn.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_words"), F.sum(F.col("_sure") * F.col("size")).alias("_certain")), "ratios")
    certain = sums.groupBy("source").agg(F.sum("_certain").alias("_certain"))
    upto = Window.partitionBy("source").orderBy("_b")
    left = targets.join(certain.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("_left", F.col("target") - F.coalesce("_certain", F.lit(0)))
    met = (
        sums.where("_b is not null")
        .withColumn("_upto", F.sum("_words").over(upto))
        .join(left.select(F.col("source").alias("_s"), "_left"), F.col("source").eqNullSafe(F.col("_s")))
        .where(F.col("_upto") >= F.col("_left"))
        .groupBy("source")
        .agg(F.min(F.struct("_b", (F.col("_upto") - F.col("_words")).alias("_below"))).alias("_m"))
        .select(F.col("source").alias("_s"), F.col("_m._b").alias("_b"), F.col("_m._below").alias("_below"))
    )
    cuts = stage(left.join(met, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "_certain"), "cuts")
    inside = _copies(_with_plan(rows, cuts), most).where(bucket == F.col("_b")).groupBy("source", "_v").agg(F.sum("size").alias("_words"), F.first("_below").alias("_below"), F.first("_left").alias("_left"))
    run = F.sum("_words").over(Window.partitionBy("source").orderBy("_v")) + F.col("_below")
    nearest = inside.withColumn("_run", run).where(2 * F.col("_run") - F.col("_words") <= 2 * F.col("_left")).groupBy("source").agg(F.max("_v").alias("_cut"))
    edge = F.when(F.col("_b").isNull(), F.lit(2.0)).otherwise(F.col("_b") / F.lit(float(buckets)))
    return stage(cuts.join(nearest.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "_mass", edge.alias("_edge"), "_cut"), "plan")


def _with_plan(rows: DataFrame, plan_rows: DataFrame) -> DataFrame:
    named = plan_rows.withColumnRenamed("source", "_s")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def apply_plan(rows: DataFrame, plan_rows: DataFrame, most: int = 2) -> DataFrame:
    """Copies and words taken of each row; a join to the few rows of the plan, no exchange of documents."""
    chosen = (F.col("_v") < F.col("_edge")) | (F.col("_v") <= F.coalesce("_cut", F.lit(-1.0)))
    copies = F.col("_sure") + F.when(chosen, 1).otherwise(0)
    return _copies(_with_plan(rows, plan_rows), most).withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", keep_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, copies and taken words.

    ``weight`` raises or lowers a document's expected copies within its source (1 where it is null, negative or
    not finite); where weights ask for more than ``most`` copies of a document, its source stays below its target. With
    ``keep_text`` false only id, source and the outputs are returned, from the slim table of sizes.
    """
    base = docs.drop(*OUTPUT)
    heft = F.lit(1.0) if weight is None else F.when((weight >= 0) & (weight < float("inf")), weight.cast("double")).otherwise(1.0)
    key, source, given = F.col(id_col).alias("id"), F.col(source_col).alias("source"), heft.alias("_w")
    slim = stage(with_ratio_input(base, id_col, text_col, seed, key, source, given), "sizes")
    cuts = plan(slim, weights, share, most)
    if not keep_text:
        return apply_plan(slim, cuts, most).select(F.col("id").alias(id_col), F.col("source").alias(source_col), *OUTPUT)
    # The row is carried as one struct, so that its columns meet no name used here.
    rows = with_ratio_input(base, id_col, text_col, seed, F.struct("*").alias("row"), source, given)
    return apply_plan(rows, cuts, most).select("row.*", *OUTPUT)
