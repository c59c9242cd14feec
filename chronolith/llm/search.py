"""Ranked lexical search by sort-based accumulation.

:func:`build_index` cuts the documents into segments of whole documents and stores, for every word of a segment, the
documents that hold it and how often: no shuffle, whatever words are frequent. :func:`search` ranks all documents for
every item. In a segment the lists of an item's words are concatenated to arrays of packed (item, document) keys and
impacts, the keys are sorted by a radix sort of 16 bits a pass, and runs of equal keys are summed by ``reduceat``. A
task keeps the best ``k`` of each item in a heap; what tasks keep is partitioned by ranges of items and selected once more.

A word's weight is ``floor(1000 * ln((2N + 2) / (2 df + 1)))``; N counts the documents with a word, df those with this
one. A document of n words has ``m = 25 + (75 n N) div L``, where L is the number of all words; a word that it holds tf
times adds its weight times ``(10^9 tf) div (1000 tf + 8 m)``, once for every time that the item names it.

Items go to the executors in blocks of at most ``BLOCK_BYTES`` of text; a larger table of items takes more passes over
the same index. What tasks hold is bounded by the block and a segment, what they return by ``k`` rows an item.

Defined cases: null and empty texts have no words, are found by nothing and count for nothing; an item without words
finds nothing; repeated documents are ranked each; equal scores go by ascending id, null ids last; rows of items that are
alike are one item, rows that share an id but not the text are ranked on their own; a null item id is an id like
others; other columns are ignored; an empty table of either kind gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ALNUM, as_binary, drop_stage, encode, slices, split_words, stage

#: Text of items in one pass over the index.
BLOCK_BYTES = 2 << 20
#: Postings that are sorted at a time.
RUN = 1 << 21

INDEX = "doc_ids array<long>, lengths binary, n_docs long, n_words long, terms binary, df binary, docs binary, tf binary"


def _segment(ids: pa.Array, texts: pa.Array) -> dict:
    words, counts = split_words(texts, ALNUM)
    term, terms = encode(words)
    key = np.sort(term << 32 | np.repeat(np.arange(len(counts)), counts))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return {
        "doc_ids": [ids.to_pylist()],
        "lengths": [counts.astype(np.int64).tobytes()],
        "n_docs": [int((counts > 0).sum())],
        "n_words": [int(counts.sum())],
        "terms": [b" ".join(terms.to_pylist())],
        "df": [np.bincount(key[first] >> 32, minlength=len(terms)).astype(np.int32).tobytes()],
        "docs": [(key[first] & 0xFFFFFFFF).astype(np.uint32).tobytes()],
        "tf": [np.diff(first, append=len(key)).astype(np.uint32).tobytes()],
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, one row a segment of about 2 MB of text (or one longer document), written to the shared folder."""
    kinds = T._parse_datatype_string(INDEX)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds])
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_pydict(_segment(part.column("id"), as_binary(part.column("text"))), schema=schema)

    return stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(build, INDEX), "search-index")


@dataclass
class Block:
    """Items of one pass: the words of all (``terms``) and, in CSR form, the word numbers of each with their repeats."""

    ids: list
    marks: list[int]
    terms: pa.Array
    starts: np.ndarray
    number: np.ndarray
    repeats: np.ndarray
    weight: np.ndarray | None = None

    @classmethod
    def of(cls, ids: list, marks: list[int], texts: list[str]) -> Block:
        words, counts = split_words(pa.array([t.encode() for t in texts], pa.binary()), ALNUM)
        term, terms = encode(words)
        key = np.sort(np.repeat(np.arange(len(counts)), counts) << 32 | term)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        starts = np.searchsorted(key[first] >> 32, np.arange(len(counts) + 1))
        return cls(ids, marks, terms, starts, key[first] & 0xFFFFFFFF, np.diff(first, append=len(key)))

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(self.terms))], np.int64)

    def places(self, terms: pa.Array) -> np.ndarray:
        """Where each word of the block is among ``terms``; -1 where it is not."""
        return pc.fill_null(pc.index_in(self.terms, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _terms(packed: bytes, n: int) -> pa.Array:
    return pa.array(packed.split(b" ") if n else [], pa.binary())


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys that are not negative, 16 bits a pass from the lowest; numpy sorts each digit by counting."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    top, shift = int(keys.max()) if len(keys) else 0, 16
    while top >> shift:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values[order], first)


class _Best:
    """The best ``k`` documents of each item so far, by score and then by ascending id, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.bar = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def offer(self, item: int, score: int, doc) -> None:
        heap, entry = self.heaps[item], (score, doc is not None, -(doc or 0))
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        if len(heap) == self.k:
            self.bar[item] = max(1, heap[0][0])

    def ranked(self, item: int) -> list[tuple[int, int | None]]:
        return [(s, -d if known else None) for s, known, d in sorted(self.heaps[item], reverse=True)]


def _accumulate(block: Block, a: int, b: int, place: np.ndarray, df: np.ndarray, starts: np.ndarray, docs: np.ndarray, part: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (item, document) keys and scores of the items a to b in a segment; sorted runs of at most about RUN postings."""
    at = np.arange(block.starts[a], block.starts[b])
    at = at[place[block.number[at]] >= 0]
    item = np.searchsorted(block.starts, at, side="right") - 1
    local = place[block.number[at]]
    size = df[local]
    gain = block.weight[block.number[at]] * block.repeats[at]
    runs = []
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // RUN)) + 1
    for x, y in zip([0, *cuts], [*cuts, len(at)]):
        row = np.repeat(np.arange(x, y), size[x:y])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(size[x:y]) - size[x:y], size[x:y])
        posting = starts[local[row]] + nth
        runs.append(summed(item[row] << bits | docs[posting], gain[row] * part[posting]))
    return runs[0] if len(runs) == 1 else summed(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]))


def _rank(segment: dict, block: Block, best: _Best, documents: int, words: int) -> None:
    df = np.frombuffer(segment["df"], np.int32).astype(np.int64)
    place = block.places(_terms(segment["terms"], len(df)))
    if not (place >= 0).any():
        return
    docs, tf = np.frombuffer(segment["docs"], np.uint32).astype(np.int64), np.frombuffer(segment["tf"], np.uint32).astype(np.int64)
    lengths = np.frombuffer(segment["lengths"], np.int64)
    m = np.array([25 + 75 * n * documents // words for n in lengths.tolist()], np.int64)  # Python's integers, as the product may pass 64 bits
    part = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
    starts, bits = np.cumsum(df) - df, max(1, len(lengths)).bit_length()
    present = np.where(place >= 0, df[place], 0)[block.number]
    load = np.append(0, np.cumsum(present))[block.starts]
    cuts = np.flatnonzero(np.diff(load[:-1] // RUN)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(block.ids)]):
        keys, scores = _accumulate(block, int(a), int(b), place, df, starts, docs, part, bits)
        item = keys >> bits
        good = scores >= best.bar[item]
        keys, scores, item = keys[good], scores[good], item[good]
        bounds = np.searchsorted(item, np.arange(a, b + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            x, y = bounds[k], bounds[k + 1]
            high = np.arange(x, y)
            if y - x > best.k:
                high = high[scores[x:y] >= np.partition(scores[x:y], y - x - best.k)[y - x - best.k]]
            for h in high:
                best.offer(int(a + k), int(scores[h]), segment["doc_ids"][keys[h] & (1 << bits) - 1])


def _blocks(items: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    rows = rows.withColumn("mark", F.xxhash64("item", "text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(-(-size // BLOCK_BYTES)) or 1
    return [rows if n == 1 else rows.where(F.pmod("mark", F.lit(n)) == k) for k in range(n)]


def _document_counts(index: DataFrame, sent) -> dict[int, int]:
    """In how many documents each word of the block is; the driver reads a row a word of the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        total = np.zeros(len(block.terms), np.int64)
        for batch in batches:
            for segment in batch.to_pylist():
                df = np.frombuffer(segment["df"], np.int32)
                place = block.places(_terms(segment["terms"], len(df)))
                total += np.where(place >= 0, df[place], 0) if len(df) else 0
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.int32()), "df": pa.array(total[found], pa.int64())})

    counted = index.select("terms", "df").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.collect()}


def search(index: DataFrame, items: DataFrame, k: int = 10, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, mark, doc_id, score, rank``: the ``k`` best documents of each item with a score above 0, ranks from 1.

    ``mark`` tells items apart that share an id. The index may be dropped once the result was written.
    """
    spark = index.sparkSession
    documents, words = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    found_type = T.StructType([T.StructField("item", items.schema[item_col].dataType), *T._parse_datatype_string("mark long, doc_id long, score long")])
    ranked_type = T.StructType([*found_type, T.StructField("rank", T.IntegerType())])
    found_arrow, ranked_arrow = (pa.schema([(f.name, to_arrow_type(f.dataType)) for f in s]) for s in (found_type, ranked_type))
    passes = []
    for rows in _blocks(items, item_col, text_col):
        got = rows.collect()
        block = Block.of([r["item"] for r in got], [r["mark"] for r in got], [r["text"] for r in got])
        if not words or not len(block.terms):
            continue
        block.weigh(documents, _document_counts(index, spark.sparkContext.broadcast(block)))
        sent = spark.sparkContext.broadcast(block)

        def rank(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            best = _Best(len(block.ids), k)
            for batch in batches:
                for segment in batch.to_pylist():
                    _rank(segment, block, best, documents, words)
            for item, (name, mark) in enumerate(zip(block.ids, block.marks)):
                if top := best.ranked(item):
                    yield pa.RecordBatch.from_pylist([{"item": name, "mark": mark, "doc_id": d, "score": s} for s, d in top], schema=found_arrow)

        passes.append(index.select("doc_ids", "lengths", "terms", "df", "docs", "tf").mapInArrow(rank, found_type))
    if not passes:
        return spark.createDataFrame([], ranked_type)
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        best = _Best(0, k)
        for batch in batches:
            for row in batch.to_pylist():
                at = seen.setdefault((row["item"], row["mark"]), len(seen))
                if at == len(best.heaps):
                    best.heaps.append([])
                    best.bar = np.append(best.bar, 1)
                best.offer(at, row["score"], row["doc_id"])
        for (name, mark), at in seen.items():
            yield pa.RecordBatch.from_pylist([{"item": name, "mark": mark, "doc_id": d, "score": s, "rank": n} for n, (s, d) in enumerate(best.ranked(at), 1)], schema=ranked_arrow)

    # The range partitioning reads its input twice, so what the tasks kept is written first.
    return stage(every, "search-found").repartitionByRange("mark", "item").mapInArrow(select, ranked_type)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, **names: str) -> DataFrame:
    """Index and search in one; the index is dropped."""
    index = build_index(docs)
    found = stage(search(index, items, k, **names), "search")
    drop_stage(index)
    return found
