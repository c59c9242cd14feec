"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def _digest(edges: DataFrame) -> tuple:
    # Summed in decimal: the sum of hashes must not overflow, whatever the number of edges.
    return tuple(edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of an edge; ``edges`` has long columns ``u`` and ``v``.

    The component is its smallest node. A large-star links each larger neighbour of a node to the smallest
    neighbour, a small-star links each smaller one and the node itself; both keep the components as they
    are and end in stars. A round is a table in the shared folder. A node with very many neighbours costs
    one aggregate row per task in the minima; the join against these minima has one row per node on its
    small side, so adaptive execution can split the large side of a hub.

    Self-links and repeated links are allowed, rows with a null end are ignored.
    """
    known = edges.where("u is not null and v is not null")
    now = stage(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        turned = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        turned = stage(turned, "small-star")
        drop_stage(large)
        drop_stage(now)
        now, last, seen = turned, seen, _digest(turned)
        if seen == last:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
