"""Embedding near-dedup with an inverted multi-index.

The halves of the unit vectors have independent codebooks (k-means on a bounded sample); a vector is filed
in the cell of its two nearest codewords, a product grid of far more cells than codewords. A vector's
neighbours are looked for by multi-sequence traversal: cells are taken from the grid in order of the
distance that a member must at least have, until that bound exceeds the radius that holds the target
recall. With ``recall`` 1 the radius is that of the similarity itself and no link can be missed, but most
of the grid may have to be visited; below 1 it is the quantile of the bounds between vectors of the sample and
neighbours made for them at exactly the cosine limit, where links are hardest to find. These are there at any
size of the table; without a sample the radius is the full one. All pairs that a cell offers are verified by
cosine in double precision.

Only the smallest id of identical vectors of a label is filed; the others are counted with it. The cells of
one codeword of the first half lie together: a visitor is sent once to such a line of cells if it visits any in it, and
is compared with all members of the line, which are more than those of the cells asked for. Members and visitors meet in blocks of at most BLOCK by BLOCK rows, and a block returns, not its pairs,
but a count for each end (for a member only of links that it does not find as a visitor, so that a link counts
at both ends if it is found from one) and a star of links that keeps what is connected connected.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without
label or id, link with nothing; a null id has no component and is kept; rows that share an id are one
vector, which links if any of them does; vectors of different lengths never link; an empty table gives an
empty result; other columns are not needed and not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest, stage
from .graph import connected_components

#: Bound of the sample that codebooks and radius are fitted on.
SAMPLE = 20_000
BLOCK = 2048
MAX_CODEWORDS = 4096
#: Vectors of the sample that neighbours are made for, and neighbours of each kind.
PROBES, TURNS = 2000, 5
#: Rounding of the stored components must not hide a link at the very limit.
SLACK = 1e-6


@dataclass
class Grid:
    """Codebooks of both halves for one length of vectors, and the squared radius of a traversal."""

    books: tuple[np.ndarray, np.ndarray]
    radius: float

    def bounds(self, x: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of each half the nearest codeword, and the least squared distance to any member of each codeword.

        A member of codeword ``c`` is nearer to ``c`` than to the row's own ``o``: it lies beyond the plane between
        them, at (d(x,c)^2 - d(x,o)^2) / (2 |c - o|) from the row.
        """
        half = x.shape[1] // 2
        own, least = [], []
        for part, book in zip((x[:, :half], x[:, half:]), self.books):
            d = np.maximum((part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1), 0)
            near = d.argmin(1)
            apart = np.sqrt(np.maximum(((book[near][:, None] - book[None]) ** 2).sum(2) if len(book) <= 64 else (book * book).sum(1)[near][:, None] - 2 * book[near] @ book.T + (book * book).sum(1), 1e-30))
            plane = np.maximum(d - d[np.arange(len(d)), near][:, None], 0) / (2 * apart)
            plane[np.arange(len(d)), near] = 0
            own.append(near)
            least.append(plane * plane)
        return tuple(own), tuple(least)

    def visits(self, first: np.ndarray, second: np.ndarray) -> list[int]:
        """Multi-sequence traversal of one row: cells by rising bound, until it exceeds the radius."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        a, b = a[first[a] <= self.radius], b[second[b] <= self.radius]
        # Of each sequence of one codeword so many cells come before the end; merged by their bound.
        many = np.searchsorted(second[b], self.radius - first[a], side="right")
        i = np.repeat(np.arange(len(a)), many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        order = np.argsort(first[a][i] + second[b][j], kind="stable")
        return (a[i] * len(second) + b[j])[order].tolist()


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    book = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((book * book).sum(1) - 2 * x @ book.T).argmin(1)
        for j in range(x.shape[1]):
            total = np.bincount(near, weights=x[:, j], minlength=k)
            book[:, j] = np.where(np.bincount(near, minlength=k) > 0, total / np.maximum(np.bincount(near, minlength=k), 1), book[:, j])
    return book


def _neighbours(x: np.ndarray, cosine: float, others: np.ndarray | None, rng: np.random.Generator) -> np.ndarray:
    """A unit vector at exactly ``cosine`` from each row: in any direction, or in that of the difference of two ``others``."""
    way = rng.standard_normal(x.shape) if others is None else others[rng.integers(0, len(others), len(x))] - others[rng.integers(0, len(others), len(x))]
    way = way - (way * x).sum(1)[:, None] * x
    size = np.sqrt((way * way).sum(1))[:, None]
    return np.where(size > 1e-9, cosine * x + (1 - cosine * cosine) ** 0.5 * way / np.maximum(size, 1e-9), x)


def fit(sample: np.ndarray, n: int, cosine: float, recall: float = 1.0, seed: int = 5) -> Grid:
    """Codebooks of about (n / 16) ^ (1/2) words each, so that a cell of the grid would hold 16 vectors if
    they were spread evenly. ``recall`` below 1 shortens the radius to what holds that share of the neighbours made."""
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    k = int(min(MAX_CODEWORDS, max(1, (n / 16) ** 0.5), len(sample)))
    grid = Grid((k_means(sample[:, :half], k, rng), k_means(sample[:, half:], k, rng)), 2 - 2 * cosine + SLACK)
    if recall < 1 and len(sample):
        seen = []
        for others in (None, sample):
            found = []
            for a in range(0, PROBES * TURNS, 500):
                x = sample[np.arange(a, a + 500) % min(len(sample), PROBES)]
                least, own = grid.bounds(x)[1], grid.bounds(_neighbours(x, cosine, others, rng))[0]
                found.append(least[0][np.arange(len(x)), own[0]] + least[1][np.arange(len(x)), own[1]])
            seen.append(float(np.quantile(np.concatenate(found), recall)))
        grid.radius = min(grid.radius, max(seen) + SLACK)
    return grid


def _unit(vectors: list[bytes], kind: str = "f8") -> np.ndarray:
    """Unit vectors in double precision of the bytes of vectors of some kind of numbers."""
    x = np.frombuffer(b"".join(vectors), kind).astype(np.float64).reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _kind(vectors: DataFrame, vector_col: str) -> str:
    """How components are stored: single precision if that is what the column has."""
    return "f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "f8"


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, vector`` (bytes of components) of the rows that can link."""
    kind = _kind(vectors, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
            ends = np.cumsum(size)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.concatenate([[0], np.cumsum(np.where(np.isfinite(x), 0, 1))])
                odd = norm[ends] - norm[ends - size] > 0
                square = np.array([float(x[e - n : e] @ x[e - n : e]) for e, n in zip(ends, size)])
                good = (size > 0) & ~odd & (square > 0) & (square < np.inf)
            keep = batch.filter(pa.array(good))
            stored = (np.nan_to_num(x) + 0.0).astype(kind)
            packed = [stored[e - n : e].tobytes() for e, n, g in zip(ends, size, good) if g]
            yield pa.RecordBatch.from_arrays([keep.column("id"), keep.column("label"), pa.array(packed, pa.binary())], names=["id", "label", "vector"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    return rows.where("id is not null and label is not null and vector is not null").mapInArrow(run, "id long, label string, vector binary")


def _file(classes: DataFrame, grids, kind: str) -> DataFrame:
    """``cell`` of every class, by its codeword of the first half, and ``visits``: those codewords of the cells to look into.

    A visitor is thus sent once to a line of cells of the grid, not to each cell in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vector").to_pylist()
            cell, visits = np.zeros(len(rows), np.int64), [[] for _ in rows]
            for size in {len(r) for r in rows}:
                of = [i for i, r in enumerate(rows) if len(r) == size]
                grid = grids.value[size]
                for a in range(0, len(of), 256):
                    part = of[a : a + 256]
                    own, least = grid.bounds(_unit([rows[i] for i in part], kind))
                    for at, i in enumerate(part):
                        cell[i] = own[0][at]
                        visits[i] = np.unique(np.array(grid.visits(least[0][at], least[1][at])) // len(grid.books[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(visits, pa.list_(pa.int64()))], names=[*batch.schema.names, "cell", "visits"])

    return classes.mapInArrow(run, "class long, id long, copies long, label string, size int, vector binary, cell long, visits array<long>")


def _meet(cosine: float, kind: str):
    """Compare the visitors (side 1) and members (side 0) of a block of a cell."""

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        ids, copies, classes = (np.asarray(table.column(c)) for c in ("id", "copies", "class"))
        unit = _unit(table.column("vector").to_pylist(), kind)
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        links, back = np.zeros(len(one), np.int64), np.zeros(len(two), np.int64)
        # Which members look into the lines that the visitors come from, and so count these links themselves.
        lines, line = np.unique(np.asarray(table.column("home"))[one], return_inverse=True)
        visits = table.column("visits").combine_chunks().take(pa.array(two))
        owner = np.repeat(np.arange(len(two)), pc.list_value_length(visits).to_numpy(zero_copy_only=False))
        asked = np.asarray(visits.flatten())
        place = np.minimum(np.searchsorted(lines, asked), max(len(lines) - 1, 0))
        known = np.zeros((len(two), len(lines)), bool)
        if len(lines):
            known[owner[lines[place] == asked], place[lines[place] == asked]] = True
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a in range(0, len(one), 256):
            near = unit[one[a : a + 256]] @ unit[two].T >= cosine
            near[classes[one[a : a + 256]][:, None] == classes[two][None]] = False
            links[a : a + 256] = near @ copies[two]
            back += copies[one[a : a + 256]] @ (near & ~known[:, line[a : a + 256]].T)
            # Of the links of a visitor one per component found so far is enough.
            for i in np.flatnonzero(near.any(1)):
                mine = root(int(ids[one[a + i]]))
                for y in {root(int(y)) for y in ids[two[near[i]]]}:
                    low, high = min(mine, y), max(mine, y)
                    parent[high] = low
                    mine = root(low)
        stars = [(x, root(x)) for x in list(parent)]
        some = back > 0
        linking, many = np.concatenate([classes[one], classes[two][some]]), np.concatenate([links, back[some]])
        counted = pa.table({"class": pa.array(linking, pa.int64()), "n": pa.array(many, pa.int64()), "u": pa.nulls(len(many), pa.int64()), "v": pa.nulls(len(many), pa.int64())})
        linked = pa.table({"class": pa.nulls(len(stars), pa.int64()), "n": pa.nulls(len(stars), pa.int64()), "u": pa.array([s[0] for s in stars], pa.int64()), "v": pa.array([s[1] for s in stars], pa.int64())})
        return pa.concat_tables([counted, linked])

    return run


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.93, recall: float = 0.9999, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    spark, kind = vectors.sparkSession, _kind(vectors, vector_col)
    rows = stage(usable(vectors, id_col, vector_col, label_col), "vectors")
    grouped = rows.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("id").alias("copies"))
    classes = stage(grouped.select(F.xxhash64("label", "vector").alias("class"), "id", "copies", "label", F.octet_length("vector").alias("size"), "vector"), "classes")
    grids = {}
    for size, n in classes.groupBy("size").agg(F.count("id")).collect():  # one row per length of vectors
        drawn = lowest(classes.where(F.col("size") == size), F.xxhash64("vector"), SAMPLE, "id", "class", total=n).select("vector").toPandas()["vector"]
        grids[size] = fit(_unit([bytes(v) for v in drawn], kind), n, cosine, recall)
    filed = stage(_file(classes, spark.sparkContext.broadcast(grids), kind), "filed")

    key = ["label", "size", "cell"]
    member = filed.select(*key, "class", "id", "copies", "vector", "visits", F.col("cell").alias("home"))
    visitor = filed.select("label", "size", F.explode("visits").alias("cell"), "class", "id", "copies", "vector", F.lit(None).cast("array<long>").alias("visits"), F.col("cell").alias("home"))
    # Cells without members are not looked into; the counts of both sides set the blocks of a cell.
    members = member.groupBy(*key).agg(F.count("id").alias("n"))
    visitors = filed.select("label", "size", F.explode("visits").alias("cell")).groupBy(*key).agg(F.count("cell").alias("m"))
    blocks = stage(members.join(visitors, key).select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("i_blocks"), F.ceil(F.col("m") / BLOCK).cast("int").alias("j_blocks")), "cells")
    spread = F.abs(F.xxhash64("id", "class") % F.lit(1 << 30))
    left = member.join(blocks, key).select(*key, "class", "id", "copies", "vector", "visits", "home", F.lit(0).alias("side"), (spread % F.col("i_blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_blocks") - 1)).alias("j"))
    right = visitor.join(blocks, key).select(*key, "class", "id", "copies", "vector", "visits", "home", F.lit(1).alias("side"), (spread % F.col("j_blocks")).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("i_blocks") - 1)).alias("i"))
    met = stage(left.unionByName(right).groupBy(*key, "i", "j").applyInArrow(_meet(cosine, kind), "class long, n long, u long, v long"), "met")

    counts = met.where("class is not null").groupBy("class").agg(F.sum("n").alias("n"))
    same_id = rows.select("id", F.xxhash64("label", "vector").alias("class")).join(classes.select("class", F.col("id").alias("first")), "class").where("id != first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    found = connected_components(met.where("class is null and u != v").select("u", "v").unionByName(same_id))
    per_class = stage(classes.select("class", F.col("copies") - 1).join(counts, "class", "left").select("class", (F.col("(copies - 1)") + F.coalesce("n", F.lit(0))).alias("n_links")), "counts")
    per_id = stage(rows.select("id", F.xxhash64("label", "vector").alias("class")).join(per_class, "class").groupBy("id").agg(F.max("n_links").alias("n_links")), "links")
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(per_id, F.col("vec_id") == F.col("id"), "left").drop("id").join(found, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
