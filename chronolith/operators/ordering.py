"""Places and running sums in a total order without one task that sorts it all.

The order is cut into pieces at keys drawn by hash. Counts and sums of the pieces, one row each, are added up in one
place, and every piece is sorted on its own, so a task has a piece. The number of pieces grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a piece, on average.
PIECE_ROWS = 200_000
_DRAWS = 20


def _cuts(keyed: DataFrame, pieces: int, total: int) -> DataFrame:
    """One row with the sorted ``_cuts``: distinct keys of about 20 rows a piece, every 20th of them."""
    mark = F.pmod(F.xxhash64("_key"), F.lit(1 << 40))
    wanted = _DRAWS * pieces
    few = keyed.where(mark < int(min(1.0, 1.5 * (wanted + 100) / total) * (1 << 40))) if total > 2 * wanted else keyed
    step = F.greatest(F.lit(1), F.floor(F.size("_all") / pieces).cast("int"))
    return few.select("_key").distinct().agg(F.array_sort(F.collect_set("_key")).alias("_all")).select(F.filter("_all", lambda _, k: k % step == step - 1).alias("_cuts"))


def _piece() -> Column:
    """How many of the cuts are up to the key, found by halving."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
        open_, right = s["a"] < s["b"], F.get("_cuts", mid) <= F.col("_key")
        return F.struct(F.when(open_ & right, mid + 1).otherwise(s["a"]).alias("a"), F.when(open_ & ~right, mid).otherwise(s["b"]).alias("b"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_cuts") + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("a"), F.size("_cuts").alias("b")), halve)["a"]


def placed(df: DataFrame, order: list[Column], *, by: str | None = None, sums: dict[str, Column] | None = None, pieces: int | None = None) -> DataFrame:
    """``df`` with ``place`` (from 1) in ascending ``order``, nulls first, and the sum of each of ``sums`` up to it.

    With ``by``, places and sums begin anew for each of its values, of which there are few. Rows that are equal in
    ``order`` stand in the order of a hash of all their columns, so that many of them make several pieces too; only rows
    that are alike in all columns must fit into one task. ``df`` is read three times: to count, to draw, to sort.
    """
    total = df.count()
    pieces = max(1, -(-total // PIECE_ROWS)) if pieces is None else pieces
    first = [] if by is None else [F.col(by)]
    group = [] if by is None else [by]
    sums = sums or {}
    key = F.struct(*[c.alias(f"k{n}") for n, c in enumerate([*first, *order, F.xxhash64(*df.columns)])])
    keyed = df.withColumn("_key", key).withColumns({f"_{n}": c for n, c in sums.items()})
    dealt = keyed.join(F.broadcast(_cuts(keyed, pieces, total))).withColumn("_piece", _piece()).drop("_cuts")
    per = dealt.groupBy("_piece", *group).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_{n}").alias(f"_all_{n}") for n in sums])
    up_to = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select(F.col("_piece").alias("_p"), *[F.col(g).alias("_by") for g in group], F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"_all_{n}").over(up_to), F.lit(0)).alias(f"_base_{n}") for n in sums])
    within = Window.partitionBy("_piece", *group).orderBy("_key")
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({"_row": F.row_number().over(within), **{f"_run_{n}": F.sum(f"_{n}").over(running) for n in sums}})
    same = F.col("_piece") == F.col("_p")
    joined = own.join(F.broadcast(bases), same & F.col(by).eqNullSafe(F.col("_by")) if by else same)
    return joined.select(*df.columns, (F.col("_before") + F.col("_row")).cast("long").alias("place"), *[(F.col(f"_base_{n}") + F.col(f"_run_{n}")).alias(n) for n in sums])
