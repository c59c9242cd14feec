"""Quality scores by Bradley-Terry pairwise ranking.

Every text becomes FEATURES numbers computed from all of its bytes. Preference pairs are a good and a poor
document, and every labelled row is in some of them; the score ``w . x`` is learned by the logistic loss of the
difference of the pair's features, so that the good one wins. The threshold is the quantile of all labelled rows'
scores at the share of poor documents, and the score returned is the logistic of the distance to it. Sums over rows
and pairs are made by partitions; the driver adds these up and solves for the FEATURES weights.

Neither labels nor ids, sources or languages are features. Defined cases: a null or empty text has all
features 0 and is scored like any other; without good or without poor training rows every text scores the
share of good ones (1 without any); labels other than 0 and 1 and rows without id or text are no training
rows; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordering
from .common import SPACED, as_binary, drop_stage, encode, slices, split_words, stage

#: Pairs that each row of the larger class is in, and pairs in all, at least.
TURNS, PAIRS = 3, 60_000
RIDGE, ROUNDS = 1e-3, 25

_CLASSES = {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "blank": b" \t",
    "newline": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@\\^_`{}~",
    "bracket": b"()[]\"'-",
    "high": bytes(range(128, 256)),
}
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _chars in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_chars)] = _k

FEATURES = [*_CLASSES, "other", "log_words", "word_bytes", "long_words", "distinct", "top_word", "repeated_pairs", "stutter", "entropy", "line_words", "short_lines", "endings", "doubles"]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of so many values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner the number of distinct values, and how often its most frequent one occurs."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (value.astype(np.uint64) & np.uint64((1 << 44) - 1)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    who = (key[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, who, np.diff(np.append(first, len(key))))
    return np.bincount(who, minlength=n).astype(float), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text of a binary column."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 256 + raw, minlength=256 * n).reshape(n, 256)
    by_class = np.stack([kinds[:, _CLASS_OF == k].sum(1) for k in range(len(_CLASSES) + 1)], 1)
    share = by_class / np.maximum(size, 1)[:, None]
    p = kinds / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    doubles = np.bincount(owner[1:][(raw[1:] == raw[:-1]) & (owner[1:] == owner[:-1])], minlength=n)

    words, counts = split_words(texts, SPACED)
    ids, _ = encode(words)
    lengths = np.diff(np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]) if len(words) else np.empty(0)
    of_word = np.repeat(np.arange(n), counts)
    distinct, top = _distinct(of_word, ids, n)
    same = of_word[1:] == of_word[:-1]
    pairs, _ = _distinct(of_word[1:][same], (ids[:-1] * 1_000_003 + ids[1:])[same], n)
    stutter = np.bincount(of_word[1:][same & (ids[1:] == ids[:-1])], minlength=n)
    many = np.maximum(counts, 1)

    lines = by_class[:, list(_CLASSES).index("newline")] + 1
    is_end = np.append(raw[1:] == 10, True) if len(raw) else np.empty(0, bool)
    is_end[(offsets[1:] - offsets[0] - 1)[size > 0]] = True
    endings = np.bincount(owner[is_end & np.isin(raw, [46, 63, 33])], minlength=n)
    at_end = np.flatnonzero(is_end)
    line_bytes = np.diff(np.append(-1, at_end))
    short = np.bincount(owner[at_end][line_bytes < 30], minlength=n)
    out = np.column_stack(
        [
            share,
            np.log1p(counts),
            _sums(lengths, counts) / many,
            _sums(lengths > 14, counts) / many,
            distinct / many,
            top / many,
            1 - pairs / np.maximum(counts - 1, 1),
            stutter / many,
            entropy,
            np.log1p(counts / lines),
            short / lines,
            endings / lines,
            doubles / np.maximum(size, 1),
        ]
    )
    out[counts == 0] = 0
    return out


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x`` for every row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(as_binary(part.column("text"))).astype(np.float32)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("filled"), rows], names=["doc_id", "filled", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).isNotNull().alias("filled"), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(run, "doc_id long, filled boolean, x array<float>"), "features")


@dataclass
class Ranking:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float
    constant: float | None = None

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -60, 60)))


def _sent(columns: list[tuple[str, pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in columns], names=[n for n, _, _ in columns])


def _grid(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)


def moments(rows: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Good and poor rows, mean and deviation of their features; the driver reads one row a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, good, mean, spread = 0, 0, 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = _grid(batch), batch.num_rows
            good += int(np.asarray(batch.column("label")).sum())
            off = x.mean(0) - mean
            spread = spread + ((x - x.mean(0)) ** 2).sum(0) + off**2 * (n * m / (n + m))
            mean, n = mean + off * (m / (n + m)), n + m
        if n:
            yield _sent([("n", pa.int64(), [n]), ("good", pa.int64(), [good]), ("mean", pa.list_(pa.float64()), [mean]), ("spread", pa.list_(pa.float64()), [spread])])

    n, good, mean, spread = 0, 0, np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    for part in rows.select("label", "x").mapInArrow(run, "n long, good long, mean array<double>, spread array<double>").collect():
        m, off = part["n"], np.array(part["mean"]) - mean
        spread = spread + np.array(part["spread"]) + off**2 * (n * m / (n + m))
        mean, n, good = mean + off * (m / (n + m)), n + m, good + part["good"]
    return good, n - good, mean, np.maximum(np.sqrt(spread / max(n, 1)), 1e-6)


def pairs(rows: DataFrame, good: int, poor: int) -> DataFrame:
    """``a, b``: features of a good and a poor row. Rows are numbered by hash within their class, and each of the larger
    class meets TURNS of the smaller one, more if that makes fewer than PAIRS, up to all; so every row is in a pair."""
    many, few = max(good, poor), min(good, poor)
    turns = min(few, max(TURNS, -(-PAIRS // many)))
    numbered = stage(ordering.placed(rows, [F.xxhash64("doc_id"), F.col("doc_id")], by="label"), "numbered")
    larger = int(good >= poor)
    opponents = F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda turn: (F.col("place") - 1 + turn * (few // turns)) % few + 1)
    asked = numbered.where(F.col("label") == larger).select(F.col("x").alias("a" if larger else "b"), F.explode(opponents).alias("place"))
    met = stage(asked.join(numbered.where(F.col("label") == 1 - larger).select("place", F.col("x").alias("b" if larger else "a")), "place").select("a", "b"), "pairs")
    drop_stage(numbered)
    return met


def _slopes(met: DataFrame, ranking: Ranking) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the mean logistic loss of all pairs, from one sum a partition."""
    n = len(ranking.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, first, second = 0, np.zeros(n), np.zeros((n, n))
        for batch in batches:
            d = ranking.standard(_grid(batch, "a")) - ranking.standard(_grid(batch, "b"))
            lose = 1 / (1 + np.exp(np.clip(d @ ranking.weights, -60, 60)))
            count, first, second = count + len(d), first - (d * lose[:, None]).sum(0), second + (d * (lose * (1 - lose))[:, None]).T @ d
        yield _sent([("n", pa.int64(), [count]), ("first", pa.list_(pa.float64()), [first]), ("second", pa.list_(pa.float64()), [second.ravel()])])

    sums = met.mapInArrow(run, "n long, first array<double>, second array<double>").collect()
    total = sum(r["n"] for r in sums)
    return sum(np.array(r["first"]) for r in sums) / total, sum(np.array(r["second"]) for r in sums).reshape(n, n) / total


def fit(rows: DataFrame) -> Ranking:
    """Newton steps of the ridge-penalised logistic loss of feature differences of good and poor rows ``doc_id, label, x``."""
    good, poor, mean, scale = moments(rows)
    n = len(FEATURES)
    if not good or not poor:
        return Ranking(np.zeros(n), np.zeros(n), np.ones(n), 0.0, good / (good + poor) if good + poor else 1.0)
    met, w = pairs(rows, good, poor), np.zeros(n)
    for _ in range(ROUNDS):
        gradient, hessian = _slopes(met, Ranking(w, mean, scale, 0.0))
        step = np.linalg.solve(hessian + RIDGE * np.eye(n), gradient + RIDGE * w)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    drop_stage(met)
    # Between the two scores around the quantile, so that rows of neither side lie on the threshold.
    ranking = Ranking(w, mean, scale, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranking.raw(_grid(batch)))], names=["raw"])

    raw = stage(rows.select("x").mapInArrow(run, "raw double"), "training-scores")
    around = ordering.placed(raw, [F.col("raw")]).where(F.col("place").isin(poor, poor + 1)).collect()
    drop_stage(raw)
    ranking.threshold = float(np.mean([r["raw"] for r in around]))
    return ranking


def train(table: DataFrame, labels: DataFrame, learn, *, id_col: str = "doc_id", label_col: str = "quality") -> Ranking:
    """Fit on all usable labelled ids; an id that several rows share is one row, the least."""
    usable = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = stage(table.where("filled").join(usable.distinct(), "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x")), "training-rows")
    ranking = fit(rows)
    drop_stage(rows)
    return ranking


def score(table: DataFrame, ranking: Ranking) -> DataFrame:
    """``doc_id, score`` of every row of a feature table."""
    sent = table.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(_grid(batch)))], names=["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
