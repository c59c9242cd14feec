"""Line dedup by the number of distinct sites that a line appears on. DataFrame functions only.

A HyperLogLog sketch of sites is kept per line hash and merged by the aggregation, map side first, so a
line that is on every page costs one small sketch per task. Lines whose estimate is clearly below the
limit are left alone, lines clearly above are boilerplate, and only lines near the limit are counted
exactly. Boilerplate is removed from every document that has a line of its own; a document of boilerplate
lines only is a copy as a whole, which near-dedup settles, and stays.

Up to LISTED boilerplate lines are written into the plan as two lists of hashes, so that texts are cleaned
where they are read; beyond that, each text is joined with the hashes of its own boilerplate lines.

Lines are compared without blanks at their ends, by two 64-bit hashes. Defined cases: null or empty texts
stay as they are; blank lines are no lines and stay; a null site is no site; repeated rows are treated
alike; a line repeated within a document counts for one site; a very long text is handled as any other;
an empty table gives no rows; other columns, whatever their names, are passed through (``n_lines``,
``n_spread`` and ``n_removed`` are replaced).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, free_name, stage

LG_K = 12
#: Relative standard error of a sketch with 2^LG_K registers.
ERROR = 1.04 / (1 << LG_K) ** 0.5
#: Boilerplate lines that are listed in a plan at most: 16 bytes of hashes each.
LISTED = 20_000
OUTPUT = ("n_lines", "n_spread", "n_removed")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _listed(keys: DataFrame) -> Callable[[str], str] | None:
    """SQL for whether a line (named) is one of ``keys``, by lists of both hashes; None if there are more than LISTED."""
    rows = keys.select("a", "b").limit(LISTED + 1).collect()
    if len(rows) > LISTED:
        return None
    a, b = (",".join(f"{x}L" if x > -(1 << 63) else f"({x + 1}L - 1L)" for x in {r[k] for r in rows}) or "NULL" for k in (0, 1))
    return lambda line: f"coalesce(xxhash64({line}) IN ({a}) AND xxhash64('line', {line}) IN ({b}), false)"


def _filled_lines(text_col: str) -> Column:
    return F.filter(F.transform(F.split(F.col(text_col), "\n"), _bare), lambda x: x != "")


def split_lines(docs: DataFrame, text_col: str, *keep: Column, only: Callable[[str], str] | None = None) -> DataFrame:
    """The distinct non-blank lines of each document as hashes ``a``, ``b``; ``only`` those that a listing holds."""
    lines = docs.select(*keep, F.array_distinct(_filled_lines(text_col)).alias("_lines"))
    if only is not None:
        lines = lines.withColumn("_lines", F.expr(f"filter(_lines, x -> {only('x')})"))
    return lines.select("*", F.explode("_lines").alias("_line")).select("*", _key(F.col("_line")).alias("_k")).select("*", "_k.a", "_k.b").drop("_k", "_line", "_lines")


def spread_lines(docs: DataFrame, *, min_sites: int = 10, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Hashes ``a``, ``b`` of the lines on at least ``min_sites`` sites, and ``sites``: the count as far as known.

    ``margin`` is four standard errors of the sketch, one site at least: within it a line is counted exactly.
    """
    margin = max(1.0, 4 * ERROR * min_sites)
    site = F.col(site_col).alias("site")
    lines = split_lines(docs, text_col, site).where("site is not null")
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    likely = stage(lines.groupBy("a", "b").agg(estimate.alias("sites")).where(F.col("sites") >= min_sites - margin), "likely")
    sure = likely.where(F.col("sites") > min_sites + margin)
    near = likely.where(F.col("sites") <= min_sites + margin).select("a", "b")
    listed = _listed(near)
    close = lines.join(near, ["a", "b"], "left_semi") if listed is None else split_lines(docs, text_col, site, only=listed).where("site is not null")
    exact = close.distinct().groupBy("a", "b").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    spread = stage(sure.unionByName(exact), "spread")
    drop_stage(likely)
    return spread


def clean(docs: DataFrame, *, min_sites: int = 10, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and n_lines, n_spread and n_removed."""
    docs = docs.drop(*OUTPUT)
    spread = spread_lines(docs, min_sites=min_sites, text_col=text_col, site_col=site_col).select("a", "b")
    marked, lines, bad = (free_name(docs, x) for x in ("_marked", "_lines", "_bad"))
    split = docs.withColumn(lines, F.split(F.col(text_col), "\n"))
    bare = "btrim(x, concat(' ', char(9), char(13)))"
    if (listed := _listed(spread)) is None:
        split, is_bad = _with_own(split, spread, bad, text_col, id_col), f"coalesce(array_contains(`{bad}`, named_struct('a', xxhash64(y), 'b', xxhash64('line', y))), false)"
    else:
        is_bad = listed("y")
    # Of each line: 0 blank, 1 of its own, 2 boilerplate.
    kind = f"transform(transform(`{lines}`, x -> {bare}), y -> CASE WHEN y = '' THEN 0 WHEN {is_bad} THEN 2 ELSE 1 END)"
    known = split.withColumn(marked, F.expr(kind))
    of = lambda k: F.coalesce(F.size(F.filter(F.col(marked), lambda x: x >= k)), F.lit(0)).cast("long")
    counted = known.withColumns({"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(of(1)).cast("long"), "n_spread": F.when(F.col(text_col).isNull(), 0).otherwise(of(2)).cast("long")})
    partly = F.col("n_spread") < F.col("n_lines")
    left = F.array_join(F.filter(F.col(lines), lambda x, i: F.get(F.col(marked), i) < 2), "\n")
    return counted.withColumns({"n_removed": F.when(partly, F.col("n_spread")).otherwise(0).cast("long"), text_col: F.when((F.col("n_spread") > 0) & partly, left).otherwise(F.col(text_col))}).drop(marked, lines, bad)


def _with_own(docs: DataFrame, spread: DataFrame, name: str, text_col: str, id_col: str) -> DataFrame:
    """``docs`` and in column ``name`` the hashes of their own lines that are in ``spread``; joined by id and a hash of the text."""
    ident, mark, own_mark = (free_name(docs, x) for x in ("_id", "_print", "_own_print"))
    own = split_lines(docs, text_col, F.col(id_col).alias(ident), F.xxhash64(text_col).alias(mark)).join(spread, ["a", "b"])
    bad = stage(own.groupBy(ident, mark).agg(F.collect_set(F.struct("a", "b")).alias(name)), "boilerplate")
    marked = docs.withColumn(own_mark, F.xxhash64(text_col))
    return marked.join(bad, F.col(id_col).eqNullSafe(F.col(ident)) & (F.col(own_mark) == F.col(mark)), "left").drop(ident, mark, own_mark)


def report(cleaned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return cleaned.select(id_col, "n_lines", "n_spread", "n_removed", F.char_length(text_col).cast("long").alias("n_chars"), F.sha2(text_col, 256).alias("text_sha256"))
