"""Near-duplicate documents by MinHash: universal hash minima, banding, verification, components.

1. Every text becomes its set of five-word shingles, ``HASHES`` minima of universal hashes of them, and a
   128-bit key of the set. Texts of one key form a class with its smallest id as representative, so copies,
   however many, are one node from here on.
2. The minima are cut into ``BANDS`` bands; representatives that agree on a band share a bucket.
3. Links are looked for in two steps, so that no group is ever expanded into all of its pairs. First each
   representative is compared with the smallest id of its buckets, the one it shares most buckets with, and
   components are formed. Then only buckets that still hold several components are looked at, and in them
   only pairs of different components; large ones return verified links that connect, not pairs.
4. A pair is verified by its minima (agreement of at least ``SIGNATURE`` of them) and then on full sets.
5. Components come from alternating large-star and small-star.

With 6 rows in a band, a pair of similarity 0.75 is missed by all 48 bands with probability 8e-5 (0.8:
5e-7), and its minima agree on less than ``SIGNATURE`` of 288 with probability 3e-7; a pair of similarity
0.3, as texts have that share a passage, meets in 3 of 100 cases. Of each minimum the low 16 bits are kept.

Defined cases: a null or blank text has an empty set and links with nothing; a text of one to four words
is one shingle; a null id is linked with nothing, has no component and is kept; rows that share an id are
one document, linked if any of its texts is; an empty table gives an empty result; other columns, whatever
their names, are passed through by :func:`deduplicate` and ignored by :func:`components`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, as_binary, drop_stage, encode, free_name, mix64, slices, split_words, stage, word_hashes
from .graph import connected_components

WIDTH = 5
ROWS, BANDS = 6, 48
HASHES = ROWS * BANDS
SIGNATURE = 178
#: Similarity as a fraction: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Buckets of at most this many members are paired by a join, larger ones in blocks of about BLOCK members and
#: BLOCK_BYTES of text on either side (a longer text is on a side of its own but for short ones).
SMALL, BLOCK, BLOCK_BYTES = 32, 512, 4 << 20

_random = np.random.default_rng(20240229)
_A = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = _random.integers(0, 1 << 63, max(WIDTH, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of every text in order, and how many each text has."""
    words, counts = split_words(texts, SPACED)
    term, terms = encode(words)
    hashed = word_hashes(terms)[term] if len(term) else np.empty(0, np.uint64)
    many = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    length = np.repeat(np.minimum(counts, WIDTH), many)
    total = length.astype(np.uint64) * _LENGTH
    for j in range(WIDTH):
        inside = length > j
        total[inside] += hashed[at[inside] + j] * _PLACE[j]
    return mix64(total), many


def signatures(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The low bits of the minima of every non-empty text: for each hash the least of (a * x + b) >> 32."""
    out = np.empty((len(many), HASHES), np.uint16)
    ends = np.cumsum(many)
    block = (ends - many) // (1 << 15)
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(many)]
    x = hashes >> np.uint64(32)
    for a, b in zip(cuts[:-1], cuts[1:]):
        low = ends[a] - many[a]
        part, starts = x[low : ends[b - 1]], (ends - many)[a:b] - low
        for k in range(HASHES):
            out[a:b, k] = (np.minimum.reduceat(part * _A[k] + _B[k], starts) >> np.uint64(32)).astype(np.uint16)
    return out


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_key, minima`` per row; key and minima are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, many = shingles(as_binary(part.column("text")))
                sets = [np.unique(x) for x in np.split(hashes, np.cumsum(many)[:-1])]
                full = many > 0
                minima = iter(signatures(hashes, many[full]) if full.any() else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                        pa.array([next(minima).tobytes() if f else None for f in full], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "minima"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, minima binary"), "sketch")


def band_codes(minima: np.ndarray) -> np.ndarray:
    """One code per band of each row of minima."""
    by_band = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix64((by_band @ _PLACE[:ROWS, None])[:, :, 0] + np.arange(1, BANDS + 1, dtype=np.uint64) * _LENGTH).astype(np.int64)


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def bands(classes: DataFrame) -> DataFrame:
    """``band, doc`` for every band of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = band_codes(_minima(batch.column("minima")))
                yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), pa.array(np.repeat(np.asarray(batch.column("doc")), BANDS))], names=["band", "doc"])

    return classes.select("doc", "minima").mapInArrow(run, "band long, doc long")


def agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    return (_minima(a) == _minima(b)).sum(1)


def token_sets(texts: list[bytes]) -> list[np.ndarray]:
    hashes, many = shingles(pa.array(texts, pa.binary()))
    return [np.unique(x) for x in np.split(hashes, np.cumsum(many)[:-1])]


def near(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets are similar enough; sizes alone rule most others out."""
    if DENOMINATOR * min(len(p), len(q)) < NUMERATOR * max(len(p), len(q)):
        return False
    common = len(np.intersect1d(p, q, assume_unique=True))
    return common > 0 and DENOMINATOR * common >= NUMERATOR * (len(p) + len(q) - common)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose minima agree on at least SIGNATURE places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(agreement(batch.column("ma"), batch.column("mb")) >= SIGNATURE))

    left = classes.select(F.col("doc").alias("a"), F.col("minima").alias("ma"))
    right = classes.select(F.col("doc").alias("b"), F.col("minima").alias("mb"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough. ``texts`` has ``doc, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = as_binary(batch.column("ta")).to_pylist(), as_binary(batch.column("tb")).to_pylist()
            distinct = list({*a, *b})
            sets = dict(zip(distinct, token_sets(distinct)))
            yield batch.select(["a", "b"]).filter(pa.array([near(sets[x], sets[y]) for x, y in zip(a, b)], pa.bool_()))

    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(run, "a long, b long")


def _compare(table: pa.Table) -> pa.Table:
    """Verified links between the two sides of a block of a large bucket, less those that others imply.

    A pair is looked at only in the first of the bands that it shares, and its full sets are compared only if the
    block's links have not connected it by then: a block returns a forest, never all of its pairs.
    """
    is_one = np.asarray(table.column("side")) == 1
    doc, c = np.asarray(table.column("doc")), np.asarray(table.column("c"))
    minima = _minima(table.column("minima"))
    codes = band_codes(minima)
    here = int(np.flatnonzero(codes[0] == table.column("band")[0].as_py())[0])
    pairs = []
    for i in np.flatnonzero(is_one):
        rest = np.flatnonzero(~is_one & (c != c[i]))
        rest = rest[(minima[rest] == minima[i]).sum(1) >= SIGNATURE]
        rest = rest[(codes[rest] == codes[i]).argmax(1) == here]
        pairs += [(i, k) for k in rest]
    used = sorted({x for pair in pairs for x in pair})
    text = table.column("text").to_pylist()
    sets = dict(zip(used, token_sets([text[x].encode() for x in used]))) if used else {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i, k in pairs:
        x, y = root(int(c[i])), root(int(c[k]))
        if x != y and near(sets[i], sets[k]):
            parent[x] = y
            found.append((int(doc[i]), int(doc[k])))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _across(buckets: DataFrame, component: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links ``a, b`` between different components that meet in a bucket.

    In a bucket, those outside of the component of its smallest member are compared with all members. Small
    buckets are paired by a join; large ones are compared in blocks of at most about BLOCK by BLOCK members.
    """
    named = buckets.join(component.withColumnRenamed("node", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc")).select("band", "doc", "c")
    named = stage(named, "named-buckets")
    totals = named.groupBy("band").agg(F.min(F.struct("doc", "c"))["c"].alias("main"), F.count("doc").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").drop("low", "high")
    rows = stage(named.join(totals, "band"), "open-buckets")
    small, large = rows.where(F.col("n") <= SMALL), rows.where(F.col("n") > SMALL)
    one = small.where("c != main").select("band", F.col("doc").alias("x"), F.col("c").alias("cx"))
    other = small.select("band", F.col("doc").alias("y"), F.col("c").alias("cy"))
    met = one.join(other, "band").where("cx != cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    likely = stage(_likely(met, classes), "met")
    light = verify(likely, texts)

    large = staged_large = stage(large.join(texts.select("doc", "bytes"), "doc"), "large-buckets")
    sides = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    outer = F.col("c") != F.col("main")
    counts = large.groupBy("band").agg(F.count("doc").alias("n"), F.sum("bytes").alias("size"), F.count_if(outer).alias("m"), F.sum(F.when(outer, F.col("bytes")).otherwise(0)).alias("out"))
    blocked = counts.select("band", sides(F.col("n"), F.col("size")).alias("blocks"), sides(F.col("m"), F.col("out")).alias("ones"))
    large = large.drop("n", "bytes").join(blocked, "band").withColumn("h", F.xxhash64("doc"))
    of_one = large.where("c != main").select("band", "doc", "c", F.lit(1).alias("side"), F.pmod("h", "ones").cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    of_other = large.select("band", "doc", "c", F.lit(0).alias("side"), F.pmod("h", "blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ones") - 1)).alias("j"))
    blocks = of_one.unionByName(of_other).join(classes.select("doc", "minima"), "doc").join(texts.select("doc", "text"), "doc")
    heavy = blocks.groupBy("band", "i", "j").applyInArrow(_compare, "a long, b long")
    links = stage(light.unionByName(heavy).distinct(), "more-links")
    for used in (named, rows, likely, staged_large):
        drop_stage(used)
    return links


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles, set_key`` of every row, and ``set_key, component_id`` of every class; both are tables in the
    shared folder, what was needed to make them is deleted."""
    drawn = sketch(docs, id_col, text_col)
    full = drawn.where("set_key is not null and doc_id is not null")
    classes = stage(full.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.min_by("minima", "doc_id").alias("minima")), "classes")
    slim = stage(drawn.select("doc_id", "n_shingles", "set_key"), "set-keys")
    drop_stage(drawn)
    full = slim.where("set_key is not null and doc_id is not null")
    banded = bands(classes)
    shared = banded.groupBy("band").agg(F.min("doc").alias("first"), F.count("doc").alias("n")).where("n > 1").drop("n")
    buckets = stage(banded.join(shared, "band"), "buckets")
    members = buckets.select("doc").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(members, "doc", "left_semi")
    texts = stage(texts.withColumn("bytes", F.octet_length("text").cast("long")), "texts")

    star = buckets.where("doc != first").groupBy("doc", "first").agg(F.count("band").alias("n")).groupBy("doc").agg(F.max_by("first", F.struct("n", -F.col("first"))).alias("a"))
    likely = stage(_likely(star.select("a", F.col("doc").alias("b")), classes), "likely")
    same_id = full.groupBy("doc_id").agg(F.min("set_key").alias("p"), F.max("set_key").alias("q")).where("p != q").select("doc_id")
    own = full.join(same_id, "doc_id", "left_semi").select("doc_id", "set_key").join(classes.select("set_key", "doc"), "set_key").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    links = stage(verify(likely, texts).unionByName(own), "links")
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    more = _across(buckets, found, classes, texts)
    stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = connected_components(stars.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    by_class = stage(classes.select("set_key", "doc").join(final.withColumnRenamed("node", "doc"), "doc", "left").select("set_key", F.coalesce("component", "doc").alias("component_id")), "class-components")
    for used in (classes, buckets, texts, likely, links, found, more, final):
        drop_stage(used)
    return slim, by_class


def _components(slim: DataFrame, by_class: DataFrame) -> DataFrame:
    out = slim.join(by_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    return _components(*_grouped(docs, id_col, text_col))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the rows of its smallest id. Rows without id all stay."""
    name = free_name(docs, "gone")
    known = _grouped(docs, id_col, text_col)
    gone = stage(_components(*known).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    for used in known:
        drop_stage(used)
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
