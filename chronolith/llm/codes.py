"""Vector codes by broadcast integer codebooks.

A vector is cut into ``parts`` equal consecutive parts; each is coded by the number of the nearest entry of that
part's codebook. :func:`prepare` turns components into integers (``floor(1024 x)``), :func:`fit` learns the codebooks:
every round sends them to the executors, where Arrow batches compute all distances as ``|x|^2 - 2 x.c + |c|^2`` with exact
64-bit integer matrix products and take the first smallest; each task returns one sum and count for every entry, which a
grouped shuffle merges. What the driver reads is the size of the codebooks, whatever the number of vectors.

Defined cases: vectors that are null or hold a null or non-finite component are dropped; those of an empty table
leave no rows. The width is that of the longest vector, rounded up to a multiple of ``parts``; shorter vectors are
filled up with zeros. Integers are held to a range (2^27 either way at width 64) in which a vector's error fits into 64 bits.
Repeated rows are vectors each; the first codebook takes rows by id, nulls last, then by components. With fewer vectors
than entries the codebooks are smaller. Errors of rows without a label are added up together. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches, drop_stage, stage

#: Vectors whose distances to all entries of a part are held at a time.
ROWS = 2048

Codebooks = list[np.ndarray]  # one array (entries, width of a part) of int64 for each part


def _limit(width: int) -> int:
    """The largest power of two with width times (2 limit)^2 below 2^63."""
    return 1 << (30 - (max(width - 1, 0).bit_length() + 1) // 2)


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows hold a vector of finite components only; components of all rows, and the bounds of each row's."""
    column = batch.column("vector")
    values = column.values
    offsets = np.asarray(column.offsets).astype(np.int64)
    x = np.asarray(values.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    bad = np.append(0, np.cumsum(~np.isfinite(x)))
    good = np.asarray(column.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])
    return good, x, offsets[:-1], offsets[1:]


def prepare(vectors: DataFrame, parts: int = 4, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """``vec_id, label, x`` of the vectors that are kept, and their width: x holds 32-bit little-endian integers.

    Written to the shared folder, as every round reads it.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    unfit = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    widest = rows.where("vector is not null").where(~unfit).agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-widest // parts) * parts
    schema = T.StructType([*rows.drop("vector").schema, T.StructField("x", T.BinaryType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    top = _limit(width)

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x, low, high = _usable(batch)
            at = np.flatnonzero(good)
            size = (high - low)[at]
            out = np.zeros((len(at), width), np.int32)
            row = np.repeat(np.arange(len(at)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            with np.errstate(over="ignore"):
                out[row, place] = np.clip(np.floor(1024 * x[np.repeat(low[at], size) + place]), -top, top)
            kept = batch.select(["vec_id", "label"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([r.tobytes() for r in out], pa.binary())], schema=arrow)

    return stage(rows.mapInArrow(integers, schema), "vectors"), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if not len(column) or not width:
        return np.zeros((len(column), width), np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<i4")[offsets[0] // 4 : offsets[-1] // 4].reshape(len(column), width).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of every row, and the squared distance."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    turned, own = np.ascontiguousarray(entries.T), (entries * entries).sum(1)
    for a in range(0, len(x), ROWS):
        part = x[a : a + ROWS]
        far = own - 2 * (part @ turned)
        code[a : a + ROWS] = far.argmin(1)
        error[a : a + ROWS] = far.min(1) + (part * part).sum(1)
    return code, error


def _first(prepared: DataFrame, parts: int, entries: int, width: int) -> Codebooks:
    rows = prepared.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    x = np.array([np.frombuffer(r["x"], "<i4") for r in rows], np.int64).reshape(len(rows), width)
    return [np.ascontiguousarray(p) for p in np.split(x, parts, axis=1)]


def _round(prepared: DataFrame, books: Codebooks, width: int) -> Codebooks:
    parts = len(books)
    sent = prepared.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for p, x in enumerate(np.split(_matrix(batch.column("x"), width), parts, axis=1)):
                code, _ = nearest(x, books[p])
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.diff(code[order], prepend=-1))
                used = code[order][first]
                total[p][used] += np.add.reduceat(x[order], first)
                count[p] += np.bincount(code, minlength=len(books[p]))
        for p in range(parts):
            used = np.flatnonzero(count[p])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(count[p][used], pa.int64()), pa.array(list(total[p][used]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"]
            )

    gathered = prepared.select("x").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    long = gathered.select("part", "entry", "n", F.posexplode_outer("total").alias("pos", "total"))
    merged = long.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [b.copy() for b in books]
    for r in merged.where("pos is not null").collect():
        out[r["part"]][r["entry"], r["pos"]] = int(r["total"]) // r["n"]
    sent.destroy()
    return out


def fit(prepared: DataFrame, width: int, *, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks that begin as the parts of the first vectors by id; an entry that no vector is nearest to stays."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so at most 256 entries")
    books = _first(prepared, parts, entries, width)
    for _ in range(rounds if len(books[0]) else 0):
        books = _round(prepared, books, width)
    return books


def compress(prepared: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits a part, and the squared distance to what the code stands for."""
    sent = prepared.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*prepared.drop("x").schema, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest(x, b) for x, b in zip(np.split(_matrix(batch.column("x"), width), len(books), axis=1), books)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], schema=arrow)

    return prepared.mapInArrow(code, schema)


def expand(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with ``approximation``: the components, as floating-point numbers, that a code stands for."""
    spark = coded.sparkSession
    rows = [(p, k, [float(c) / 1024 for c in e]) for p, b in enumerate(books) for k, e in enumerate(b)]
    table = spark.createDataFrame(rows, "part int, entry int, piece array<double>")
    books_row = F.broadcast(table.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.col("part") * 256 + F.col("entry"), "piece"))).alias("_book")))
    number = lambda p: F.lit(256 * p) + F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    pieces = F.concat(*[F.element_at("_book", number(p)) for p in range(len(books))])
    return coded.crossJoin(books_row).withColumn("approximation", pieces).drop("_book")


def digest(books: Codebooks) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the error of all rows of the same label, added up before anything is joined."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def coded_vectors(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks]:
    """Codes and errors of all vectors, in the shared folder, with the codebooks that they refer to."""
    prepared, width = prepare(vectors, parts)
    books = fit(prepared, width, parts=parts, entries=entries, rounds=rounds)
    coded = stage(compress(prepared, books, width), "codes")
    drop_stage(prepared)
    return with_label_errors(coded), books
