"""Benchmark decontamination with a positional inverted index partitioned by document.

:func:`build_index` cuts the documents into segments of bounded size and stores, for every word of a
segment, the sorted positions at which it occurs. A segment holds whole documents, so a phrase never
spans two segments and building the index needs no shuffle, however often a word or passage occurs.

:func:`match` looks windows of benchmark words up in every segment. A window whose rarest word is missing
costs one lookup; for the others the positions of the rarest word, moved to where the window would
start, are intersected with those of the next rarest word and so on. ``slop`` 0 gives exact phrases, a
larger slop gives proximity: every word within ``slop`` places of its own.

The benchmark is sent to the executors in blocks of at most ``BLOCK_BYTES`` of text; a larger benchmark
takes more passes over the same index, and the hits of a document are merged afterwards.

Defined cases: null or empty texts have no words and no hits; an item of fewer words than the window is
one window; an item without words is ignored; repeated documents each get their row; repeated item ids
count once; a null item id is ignored; other columns, whatever their names, are passed through by
:func:`decontaminate` and ignored by the others; an empty benchmark or table gives rows without hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, as_binary, drop_stage, encode, free_name, slices, split_words, stage

#: Benchmark text in one pass over the index; windows of it take about 20 times as much.
BLOCK_BYTES = 2 << 20
#: Free positions before each document of a segment; windows and slop together stay below it, so that no window
#: reaches into another document or before the first position.
GAP = 1024
#: Candidate positions that are intersected at a time.
CANDIDATES = 1 << 20

INDEX = "segment long, doc_ids array<long>, doc_words array<int>, terms binary, counts binary, positions binary"
MATCHES = "segment long, ord int, doc_id long, n_words long, items array<string>, spans array<struct<start:int,end:int>>"


def _segment(ids: pa.Array, texts: pa.Array, number: int) -> dict:
    words, counts = split_words(texts, ALNUM)
    term, terms = encode(words)
    base = np.cumsum(counts + GAP) - counts
    position = np.arange(len(term), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(base, counts)
    key = np.sort((term << 32) | position)
    per_term = np.bincount(term, minlength=len(terms)).astype(np.int32)
    gaps = np.diff(key & 0xFFFFFFFF, prepend=0)
    starts = np.cumsum(per_term) - per_term
    gaps[starts] = key[starts] & 0xFFFFFFFF
    return {
        "segment": number,
        "doc_ids": ids.to_pylist(),
        "doc_words": counts.astype(np.int32),
        "terms": b" ".join(terms.to_pylist()),
        "counts": per_term.tobytes(),
        "positions": gaps.astype(np.uint32).tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as one row per segment, written to the shared folder. Position gaps are per word."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                row = _segment(part.column("id"), as_binary(part.column("text")), number)
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]], pa.int64()),
                        pa.array([row["doc_ids"]], pa.list_(pa.int64())),
                        pa.array([row["doc_words"]], pa.list_(pa.int32())),
                        *(pa.array([row[k]], pa.binary()) for k in ("terms", "counts", "positions")),
                    ],
                    names=["segment", "doc_ids", "doc_words", "terms", "counts", "positions"],
                )

    return stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(build, INDEX), "index")


class Windows:
    """The distinct windows of a block of items: word numbers padded with -1, and the items of each."""

    def __init__(self, items: list[str], texts: pa.Array, width: int):
        words, counts = split_words(texts, ALNUM)
        term, self.terms = encode(words)
        rows, owner, at = [np.empty((0, width), np.int32)], [np.empty(0, np.int64)], 0
        for item, n in enumerate(counts):
            run = term[at : at + n].astype(np.int32)
            at += n
            if 0 < n < width:
                run = np.append(run, np.full(width - n, -1, np.int32))
            if n:
                grid = np.lib.stride_tricks.sliding_window_view(run, width)
                rows.append(grid)
                owner.append(np.full(len(grid), item))
        grid, owner = np.concatenate(rows), np.concatenate(owner)
        self.grid, which = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, owner)
        pairs = np.unique(np.stack([which.ravel(), owner], 1), axis=0) if len(grid) else np.empty((0, 2), np.int64)
        self.owner_items = pairs[:, 1]
        self.owner_start = np.searchsorted(pairs[:, 0], np.arange(len(self.grid) + 1))
        self.items = items
        self.lengths = (self.grid >= 0).sum(1)

    def find(self, terms: pa.Array, counts: np.ndarray, key: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the positions at which they start in a segment of sorted (word, position) keys."""
        none = np.empty(0, np.int64)
        if not len(self.grid) or not len(key):
            return none, none
        number = pc.fill_null(pc.index_in(self.terms, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        seen = np.where(number >= 0, counts[number], 0)
        frequency = np.where(self.grid >= 0, seen[self.grid], np.iinfo(np.int32).max)
        alive = np.flatnonzero(frequency.min(1) > 0)
        if not len(alive):
            return none, none
        order = np.argsort(frequency[alive], axis=1, kind="stable")
        rarest = frequency[alive, order[:, 0]].astype(np.int64)
        starts = np.cumsum(counts, dtype=np.int64) - counts
        found_window, found_start = [], []
        block = (np.cumsum(rarest) - rarest) // CANDIDATES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(alive)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            row = np.repeat(np.arange(a, b), rarest[a:b])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(rarest[a:b]) - rarest[a:b], rarest[a:b])
            first = order[row, 0]
            at = (key[starts[number[self.grid[alive[row], first]]] + nth] & 0xFFFFFFFF) - first
            for k in range(1, self.grid.shape[1]):
                live = k < self.lengths[alive[row]]
                if not live.any():
                    break
                offset = order[row, k]
                word = number[np.where(live, self.grid[alive[row], offset], 0)] << 32
                low = word + at + offset - slop
                place = np.minimum(np.searchsorted(key, low), len(key) - 1)
                hit = ~live | ((key[place] >= low) & (key[place] <= low + 2 * slop))
                row, at = row[hit], at[hit]
            found_window.append(alive[row])
            found_start.append(at)
        return np.concatenate(found_window), np.concatenate(found_start)


def _search(segment: dict, windows: Windows, slop: int) -> dict:
    counts = np.frombuffer(segment["counts"], np.int32)
    gaps = np.frombuffer(segment["positions"], np.uint32).astype(np.int64)
    starts = np.cumsum(counts, dtype=np.int64) - counts
    total = np.cumsum(gaps)
    before = np.where(starts > 0, total[starts - 1], 0) if len(starts) else starts
    key = (np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32) | (total - np.repeat(before, counts))
    terms = pa.array(segment["terms"].split(b" ") if len(counts) else [], pa.binary())
    window, at = windows.find(terms, counts, key, slop)
    n_words = np.asarray(segment["doc_words"], np.int64)
    base = np.cumsum(n_words + GAP) - n_words
    doc = np.searchsorted(base, at + slop, side="right") - 1
    doc = np.maximum(doc, 0)
    # Spans: the union of matched windows, as intervals of words within their documents.
    low = np.maximum(at, base[doc]) if len(doc) else at
    high = np.minimum(at + windows.lengths[window], base[doc] + n_words[doc]) if len(doc) else at
    order = np.argsort(low, kind="stable")
    low, high, owner = low[order], high[order], doc[order]
    reach = np.maximum.accumulate(high) if len(high) else high
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] > reach[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    span_doc = owner[first]
    span_low = low[first] - base[span_doc]
    span_high = (reach[np.append(first[1:] - 1, len(low) - 1)] if len(first) else reach[:0]) - base[span_doc]
    # Items: every item of a matched window, once per document.
    size = np.diff(windows.owner_start)[window]
    pick = np.repeat(windows.owner_start[window], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    pairs = np.unique(np.stack([np.repeat(doc, size), windows.owner_items[pick]], 1), axis=0) if len(pick) else np.empty((0, 2), np.int64)
    bounds = np.arange(len(n_words) + 1)
    return {
        "n_words": n_words,
        "item_bounds": np.searchsorted(pairs[:, 0], bounds),
        "items": [windows.items[i] for i in pairs[:, 1]],
        "span_bounds": np.searchsorted(span_doc, bounds),
        "low": span_low,
        "high": span_high,
    }


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(-(-size // BLOCK_BYTES)) or 1
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def match(index: DataFrame, benchmark: DataFrame, *, width: int = 10, slop: int = 0, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per indexed document: its words, the items with occurring windows and the hit spans.

    ``slop`` is the number of places that a word may be away from its own in the window.
    """
    if width + 2 * slop >= GAP:
        raise ValueError(f"width and slop must stay below {GAP}")
    spark = index.sparkSession
    passes = []
    for block in _blocks(benchmark, item_col, text_col):
        got = block.toPandas()
        sent = spark.sparkContext.broadcast(Windows(list(got["item"]), pa.array([t.encode() for t in got["text"]], pa.binary()), width))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for segment in batch.to_pylist():
                    out = _search(segment, sent.value, slop)
                    n = len(out["n_words"])
                    spans = pa.StructArray.from_arrays([pa.array(out["low"], pa.int32()), pa.array(out["high"], pa.int32())], names=["start", "end"])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([segment["segment"]] * n, pa.int64()),
                            pa.array(np.arange(n), pa.int32()),
                            pa.array(segment["doc_ids"], pa.int64()),
                            pa.array(out["n_words"], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(out["item_bounds"], pa.int32()), pa.array(out["items"], pa.string())),
                            pa.ListArray.from_arrays(pa.array(out["span_bounds"], pa.int32()), spans),
                        ],
                        names=["segment", "ord", "doc_id", "n_words", "items", "spans"],
                    )

        passes.append(index.mapInArrow(search, MATCHES))
    if len(passes) == 1:
        return passes[0]
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    merged = every.groupBy("segment", "ord").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    return merged.withColumn("items", F.array_distinct("items")).withColumn("spans", _merge_spans(F.col("spans")))


def _merge_spans(spans):
    """Union of sorted intervals, of which some overlap or touch."""
    empty = F.lit(None).cast("array<struct<start:int,end:int>>")

    def add(done, s):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.coalesce(empty, F.array().cast("array<struct<start:int,end:int>>")), lambda done, s: F.when(F.size(done) == 0, F.array(s)).otherwise(add(done, s)))


def report(matches: DataFrame) -> DataFrame:
    """Digest columns per document; the real items and spans stay beside them."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return matches.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "items",
        "spans",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that hold a window of a benchmark item; ids are compared null-safely.

    Rows that share an id are judged together: one contaminated text rejects all of them.
    """
    index, name = build_index(docs, id_col, text_col), free_name(docs, "bad")
    bad = stage(match(index, benchmark, width=width, slop=slop).where(F.size("spans") > 0).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    drop_stage(index)
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_anti")
