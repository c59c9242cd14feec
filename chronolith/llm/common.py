"""Shared pieces of the corpus operators: scratch tables, Arrow slicing and byte-level word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; a longer document is a step of its own.
SLICE_BYTES = 2 << 20
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder ``spark.checkpoint.dir``; removed when the driver's JVM ends.

    Where the session names no such folder, one in the warehouse is used, which executors share too; in local
    mode, where there is one machine only, a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        alone = re.match(r"local(\[|$)", spark.sparkContext.master)
        root = "file://" + tempfile.mkdtemp(prefix="chronolith-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/chronolith/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes, so that very long texts fit into a worker.

    Plans are lazy, so the settings stay; those that the session was started with are not touched.
    """
    started = spark.sparkContext.getConf()
    for key, value in _ARROW.items():
        if not started.contains(key):
            spark.conf.set(key, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs at most the tasks it held; the size of the table is
    then known to the planner, which broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    bound_batches(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the tables made by :func:`stage` that ``df`` reads, when no later plan reads them."""
    spark = df.sparkSession
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if "/chronolith/" in path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def lowest(df: DataFrame, by: Column, n: int, *ties: str, total: int | None = None) -> DataFrame:
    """The ``n`` rows of the lowest hashes ``by``. Of a larger table only hashes up to a limit are sorted that about
    1.2 ``n`` rows stay below, so what is sent does not grow with the table's partitions."""
    total = df.count() if total is None else total
    if total > 2 * n:
        df = df.where(F.pmod(by, F.lit(1 << 40)) < int((1.2 * n + 1000) / total * (1 << 40)))
    return df.orderBy(F.pmod(by, F.lit(1 << 40)), *ties).limit(n)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` is named so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_binary(column: pa.Array) -> pa.Array:
    """The UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.binary()), b"")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text each; every row is in exactly one."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def fold_table(separators: bytes) -> np.ndarray:
    """Byte map for :func:`split_words`: 0 for separators, A-Z lowered, every other byte itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[0] = 255  # a byte that UTF-8 never has, as 0 marks separators
    table[list(separators)] = 0
    return table


#: Words between ASCII blanks, and words of ASCII letters, digits and any non-ASCII characters.
SPACED = fold_table(b" \t\n\x0b\x0c\r")
ALNUM = fold_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def split_words(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of a binary column as one Arrow array, and the number of words of each row.

    Works on the column's buffers, without a Python object per word.
    """
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    rows = (offsets - offsets[0]).astype(np.int64)
    folded = table[raw]
    inside = folded != 0
    if not inside.any():
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = rows[:-1][rows[:-1] < rows[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    rank = np.cumsum(inside, dtype=np.int32)
    bounds = np.append(rank[starts] - 1, rank[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(folded[inside])])
    return words, np.diff(np.searchsorted(starts, rows))


def encode(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number the words of a slice: an id for each word, and the distinct words by id."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hash64(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0xD1342543DE82EF95
_BYTES = np.random.default_rng(31).integers(0, 1 << 64, 256, dtype=np.uint64)
_known_powers = np.ones((2, 1), np.uint64)


def word_hashes(words: pa.Array, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the words of an Arrow array, without a Python object per word.

    A word is a polynomial of its bytes (each mapped to a random number) modulo 2^64, taken from running sums over
    blocks of about ``block`` bytes; only a longer word makes a larger one.
    """
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    out = np.diff(offsets).astype(np.uint64) * np.uint64(_BASE)
    cuts = np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // block)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(words)]):
        at = offsets[a : b + 1] - offsets[a]
        power, back = _powers(int(at[-1]))
        upto = np.append(np.uint64(0), np.cumsum(_BYTES[raw[offsets[a] : offsets[b]]] * power[: at[-1]]))
        out[a:b] += (upto[at[1:]] - upto[at[:-1]]) * back[at[:-1]]
    return mix64(out)


def _powers(n: int) -> np.ndarray:
    """At least ``n`` powers of the base and of its inverse; kept from call to call."""
    global _known_powers
    if _known_powers.shape[1] <= n:
        _known_powers = np.ones((2, 1 << n.bit_length()), np.uint64)
        for row, base in zip(_known_powers, (_BASE, pow(_BASE, -1, 1 << 64))):
            row[1:] = base
            np.multiply.accumulate(row, out=row)
    return _known_powers
