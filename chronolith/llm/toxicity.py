"""Toxicity of whole texts: a bidirectional GRU with attention pooling over characters and words.

The network (see :mod:`gru`) is trained in numpy on the driver, on a bounded sample of labelled documents,
and scores every window of WINDOW words, each starting STRIDE words after the one before, so that all
words are read twice; the document's logit is that of its most toxic window. In training, too, a document
is represented by one window, as labels are per document and most windows of a toxic one are harmless: at
first by that with the character sequence most typical of the sample's toxic documents, from WARM rounds
on by that which the network finds most toxic; clean documents also show a window at random. Scores are calibrated on a part of the sample
that training leaves out, with the classes weighted as they occur among all labels.

Words are runs of letters, digits and non-ASCII characters in lower case; one of more than PIECE
characters is read in pieces. The character level runs once per distinct word of a slice of text.

Defined cases: a null, empty or wordless text scores 0; without training rows, or without toxic ones, all
texts score 0, and if all are toxic 1; labels other than 0 and 1 and rows without text or id are no training
rows; repeated rows are scored alike; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import ALNUM, as_binary, bound_batches, encode, hash64, lowest, mix64, slices, split_words

WINDOW, STRIDE, PIECE = 32, 16, 20
#: Bound of the training sample: documents per class, and characters of each on average.
SAMPLE, SAMPLE_CHARS = 1500, 6000
#: A text beyond the bound is represented by so many stretches of it, evenly spaced from its first to its last.
STRETCHES = 8
N_CHARS, N_WORDS, E_CHAR, E_WORD, H_CHAR, H_WORD = 256, 4096, 8, 8, 8, 12
ROUNDS, WARM, BATCH, RATE = 7, 3, 32, 0.006
#: Lengths of the character sequences that choose the first windows.
GRAMS = (4, 6)
#: Share of the word embeddings that training leaves out at random, so that rare words are not learnt by heart. Of 0, 0.3,
#: 0.5 and 0.7 it has the least loss on the inner validation part of the training texts (0.70, 0.55, 0.44 and 0.35 at sf0.1).
DROP = 0.7


@dataclass
class Words:
    """Texts as numbered words: ids of all words in order, words per text, characters of distinct words."""

    ids: np.ndarray
    counts: np.ndarray
    chars: np.ndarray
    lengths: np.ndarray
    slots: np.ndarray


def read_words(texts: pa.Array) -> Words:
    words, counts = split_words(texts, ALNUM)
    ids, distinct = encode(words)
    lowered = [w.decode("utf-8", "replace").lower() for w in distinct.to_pylist()]
    pieces = [[w[i : i + PIECE] for i in range(0, len(w), PIECE)] for w in lowered]
    many = np.array([len(p) for p in pieces], np.int64)
    if len(many) and many.max() > 1:
        per_word = many[ids]
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner, weights=per_word, minlength=len(counts)).astype(np.int64)
        first = np.cumsum(many) - many
        ids = np.repeat(first[ids], per_word) + np.arange(per_word.sum()) - np.repeat(np.cumsum(per_word) - per_word, per_word)
    flat = [x for p in pieces for x in p]
    lengths = np.array([len(x) for x in flat], np.int64)
    code = np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32)
    chars = np.zeros((len(flat), PIECE), np.int64)
    chars[np.arange(PIECE) < lengths[:, None]] = np.where(code < 128, code, 128 + code % 128)
    slots = (hash64(pa.array([x.encode("utf-8", "replace") for x in flat], pa.binary())) % np.uint64(N_WORDS)).astype(np.int64)
    return Words(ids, counts, chars, lengths, slots)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of texts of so many words: its text, first word and length; none for an empty text."""
    many = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = nth * STRIDE
    length = np.minimum(WINDOW, counts[text] - start)
    return text, start + (np.cumsum(counts) - counts)[text], length


def init(seed: int = 7) -> gru.Params:
    rng = np.random.default_rng(seed)
    p = {"chars": (0.3 * rng.standard_normal((N_CHARS, E_CHAR))).astype(np.float32), "words": (0.1 * rng.standard_normal((N_WORDS, E_WORD))).astype(np.float32)}
    p |= gru.init_level(rng, "c", E_CHAR, H_CHAR) | gru.init_level(rng, "w", E_WORD + 2 * H_CHAR, H_WORD)
    return p | {"out": np.zeros(2 * H_WORD, np.float32), "bias": np.zeros(1, np.float32)}


def _char_level(p: gru.Params, words: Words, which: np.ndarray, train: bool = False):
    """Pooled characters of the distinct words ``which``."""
    steps = max(1, int(words.lengths[which].max(initial=1)))
    chars = words.chars[which, :steps].T
    mask = (np.arange(steps)[:, None] < words.lengths[which]).astype(np.float32)
    gates = tuple(g[chars] for g in gru.project(p, "c", p["chars"]))
    pooled, seen = gru.pool(p, "c", gates, mask, train)
    return pooled, seen, chars


def word_gates(p: gru.Params, words: Words, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The word level's input gates of every distinct word, and a last row of zeros for padding."""
    pooled = np.empty((len(words.lengths), 2 * H_CHAR), np.float32)
    order = np.argsort(words.lengths, kind="stable")
    for a in range(0, len(order), block):
        pooled[order[a : a + block]] = _char_level(p, words, order[a : a + block])[0]
    inputs = np.concatenate([p["words"][words.slots], pooled], 1)
    return tuple(np.concatenate([g, np.zeros((1, g.shape[1]), np.float32)]) for g in gru.project(p, "w", inputs))


def _grid(words: Words, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(max(1, int(length.max(initial=1))))[:, None]
    inside = steps < length
    return np.where(inside, words.ids[np.minimum(start + steps, len(words.ids) - 1)], len(words.lengths)), inside.astype(np.float32)


def window_logits(p: gru.Params, words: Words, start: np.ndarray, length: np.ndarray, block: int = 4096) -> np.ndarray:
    gates = word_gates(p, words)
    out = np.empty(len(start), np.float32)
    for a in range(0, len(start), block):
        grid, mask = _grid(words, start[a : a + block], length[a : a + block])
        out[a : a + block] = gru.pool(p, "w", tuple(g[grid] for g in gates), mask)[0] @ p["out"] + p["bias"]
    return out


def text_logits(p: gru.Params, words: Words) -> np.ndarray:
    """The highest logit of each text's windows; -inf for a text without words."""
    text, start, length = windows(words.counts)
    out = np.full(len(words.counts), -np.inf, np.float32)
    if len(text):
        np.maximum.at(out, text, window_logits(p, words, start, length))
    return out


def _step(p: gru.Params, words: Words, start: np.ndarray, length: np.ndarray, label: np.ndarray, drop: np.random.Generator | None = None) -> gru.Params:
    """Gradients of the logistic loss of some windows; ``drop`` leaves the embeddings of DROP of their words out."""
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grid, mask = _grid(words, start, length)
    which, place = np.unique(grid, return_inverse=True)
    place = place.reshape(grid.shape)
    real = which < len(words.lengths)
    known = which[real]
    pooled, seen_c, chars = _char_level(p, words, known, True)
    kept = np.ones((len(known), 1), np.float32) if drop is None else (drop.random((len(known), 1)) >= DROP).astype(np.float32) / np.float32(1 - DROP)
    vectors = np.zeros((len(which), E_WORD + 2 * H_CHAR), p["words"].dtype)
    vectors[real] = np.concatenate([p["words"][words.slots[known]] * kept, pooled], 1)
    inputs = vectors[place]
    state, seen_w = gru.pool(p, "w", gru.project(p, "w", inputs), mask, True)
    error = ((1 / (1 + np.exp(-(state @ p["out"] + p["bias"])))) - label).astype(np.float32) / len(label)
    grads["out"] += error @ state
    grads["bias"] += error.sum()
    d_inputs = gru.pool_back(p, "w", np.outer(error, p["out"]).astype(np.float32), inputs, seen_w, grads)
    d_vectors = np.zeros_like(vectors)
    np.add.at(d_vectors, place.ravel(), d_inputs.reshape(-1, d_inputs.shape[2]))
    d_known = d_vectors[real]
    np.add.at(grads["words"], words.slots[known], d_known[:, :E_WORD] * kept)
    d_chars = gru.pool_back(p, "c", d_known[:, E_WORD:], p["chars"][chars], seen_c, grads)
    np.add.at(grads["chars"], chars.ravel(), d_chars.reshape(-1, E_CHAR))
    return grads


@dataclass
class Model:
    params: gru.Params | None
    slope: float = 1.0
    shift: float = 0.0
    constant: float = 0.0

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores of a binary column; a constant for texts with words if there was nothing to learn."""
        words = read_words(texts)
        if self.params is None:
            return np.where(words.counts > 0, self.constant, 0.0)
        logit = text_logits(self.params, words).astype(np.float64)
        return np.where(words.counts > 0, 1 / (1 + np.exp(-np.clip(self.slope * np.where(np.isfinite(logit), logit, 0) + self.shift, -60, 60))), 0.0)


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sequences of GRAMS characters of every distinct word (a shorter word as a whole), and how many each has."""
    spelled = np.concatenate([np.full((len(words.lengths), 1), N_CHARS), words.chars], 1).astype(np.uint64) + np.uint64(1)
    length = words.lengths + 1
    spelled[np.arange(spelled.shape[1]) >= length[:, None]] = 0
    factor = np.random.default_rng(41).integers(0, 1 << 63, max(GRAMS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    owner, made = [], []
    for n in GRAMS:
        for i in range(max(1, spelled.shape[1] - n + 1)):
            some = np.flatnonzero(i + n <= length) if i else np.arange(len(length))
            part = spelled[some, i : i + n]
            made.append(mix64((part * factor[: part.shape[1]]).sum(1, dtype=np.uint64) + np.uint64(n)))
            owner.append(some)
    owner, made = np.concatenate(owner), np.concatenate(made)
    order = np.argsort(owner, kind="stable")
    return made[order], np.bincount(owner, minlength=len(length))


def first_choice(words: Words, text: np.ndarray, start: np.ndarray, length: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A first score of every window: the highest log-odds, less their standard error, of a character sequence of its words.

    Sequences of GRAMS characters are counted once per text, in texts with label 1 and label 0; a word's start counts
    as a character.
    """
    gram, size = _grams(words)
    _, flat = np.unique(gram, return_inverse=True)
    first = np.cumsum(size) - size
    known = int(flat.max(initial=-1)) + 1
    by = np.zeros((2, known), np.int64)
    ends = np.cumsum(words.counts)
    for a, b, y in zip(ends - words.counts, ends, labels.tolist()):
        if y in (0, 1) and b > a:  # one text at a time: the pairs of all texts and sequences need not be held
            own = np.unique(words.ids[a:b])
            many = size[own]
            place = np.repeat(first[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            by[int(y), np.unique(flat[place])] += 1
    odds = np.log((by[1] + 0.5) / ((labels == 1).sum() + 1)) - np.log((by[0] + 0.5) / ((labels == 0).sum() + 1))
    odds -= np.sqrt(1 / (by[1] + 0.5) + 1 / (by[0] + 0.5))
    per_word = np.maximum.reduceat(odds[flat], first) if len(flat) else np.empty(0)
    running = per_word[words.ids]
    return np.maximum.reduceat(running, np.stack([start, start + length], 1).ravel().clip(0, len(running) - 1))[::2] if len(start) else np.empty(0)


def _calibrate(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit to smoothed labels, by Newton steps."""
    positive = label.sum()
    goal = np.where(label == 1, (positive + 1) / (positive + 2), 1 / (len(label) - positive + 2))
    x = np.stack([logit, np.ones_like(logit)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        prob = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        hess = (x * (weight * prob * (1 - prob))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, x.T @ (weight * (prob - goal)))
        w = w - move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _loss(logit: np.ndarray, labels: np.ndarray, held: np.ndarray) -> float:
    """Mean logistic loss of the texts left out of training, both classes with the same weight."""
    z = np.where(labels == 1, -logit, logit)[held].astype(np.float64)
    loss, y = np.logaddexp(0, z), labels[held]
    return float(np.mean([loss[y == k].mean() for k in (0, 1) if (y == k).any()] or [0.0]))


def fit(texts: list[bytes], labels: np.ndarray, share: float | None = None, seed: int = 7) -> Model:
    """Train on texts with labels 0 and 1; ``share``: that of label 1 among all labels, for calibration."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(None, constant=float(labels[0]) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    words = read_words(pa.array(texts, pa.binary()))
    text, start, length = windows(words.counts)
    held = np.zeros(len(labels), bool)
    for y in (0, 1):
        of = rng.permutation(np.flatnonzero(labels == y))
        held[of[: len(of) // 5]] = True
    train = np.flatnonzero(~held & (words.counts > 0))
    first = np.searchsorted(text, np.arange(len(labels)))
    many = np.bincount(text, minlength=len(labels))
    p = init(seed)
    adam = gru.Adam(p, RATE)
    known = np.where(held, np.float32(-1), labels)
    rank = first_choice(words, text, start, length, known)
    best_p, least = p, np.inf
    for turn in range(ROUNDS):
        if turn >= WARM:
            rank = window_logits(p, words, start, length)
        best = np.lexsort((-rank, text))[first[train]]
        clean = train[labels[train] == 0]
        # Fewer toxic than clean documents are shown as often as these, all together.
        toxic = np.repeat(best[labels[train] == 1], max(1, round(len(clean) / max((labels[train] == 1).sum(), 1))))
        pick = np.concatenate([toxic, best[labels[train] == 0], first[clean] + (rng.random(len(clean)) * many[clean]).astype(np.int64)])
        goal = np.concatenate([np.ones(len(toxic), np.float32), np.zeros(2 * len(clean), np.float32)])
        shuffled = rng.permutation(len(pick))
        for a in range(0, len(pick), BATCH):
            take = shuffled[a : a + BATCH]
            adam.step(_step(p, words, start[pick[take]], length[pick[take]], goal[take], rng))
        loss = _loss(text_logits(p, words), labels, held & (words.counts > 0))
        if turn >= min(WARM, ROUNDS - 1) and loss < least:
            best_p, least = {k: v.copy() for k, v in p.items()}, loss
    p = best_p
    logit = text_logits(p, words)
    check = np.flatnonzero((held if held.sum() >= 40 else ~held | held) & np.isfinite(logit))
    y = labels[check].astype(np.float64)
    share = float(labels.mean()) if share is None else min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / max(y.mean(), 1e-3), (1 - share) / max(1 - y.mean(), 1e-3))
    slope, shift = _calibrate(logit[check].astype(np.float64), y, weight)
    return Model(p, slope, shift)


def _level(sizes: list[int], room: int) -> int:
    """The length, SAMPLE_CHARS at least, that texts are cut to for all to fit into ``room``."""
    left, at = room, len(sizes)
    for size in sorted(sizes):
        if size * at > left:
            return max(SAMPLE_CHARS, left // at)
        left, at = left - size, at - 1
    return max([SAMPLE_CHARS, *sizes])


def sample(docs: DataFrame, labels: DataFrame, learn, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """Texts and labels of the training sample, and the share of label 1 among all usable labels.

    ``learn`` is the condition of rows to learn from. Of each class the SAMPLE labelled ids of the lowest
    hashes are taken, so the ids sent to the executors are bounded; an id that several rows share is one text, the
    least, so what comes back is, too. No text is left out: all are whole if they have
    2 * SAMPLE * SAMPLE_CHARS characters together; otherwise those above the length that keeps to it (SAMPLE_CHARS
    at least) are cut to STRETCHES stretches of as many characters in all.
    """
    usable = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    row = usable.agg(F.avg("_label"), F.count("_label")).first()
    picked = [lowest(usable.where(F.col("_label") == y).distinct(), F.xxhash64("_id"), SAMPLE, "_id") for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    drawn = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias(text_col)).join(ids, F.col("_doc") == F.col("_id"))
    drawn = drawn.where(F.col(text_col).isNotNull()).groupBy("_id", "_label").agg(F.min(text_col).alias(text_col))
    size = F.char_length(text_col)
    longer = [r[0] for r in drawn.where(size > SAMPLE_CHARS).select(size).collect()]
    rest = drawn.where(size <= SAMPLE_CHARS).agg(F.sum(size)).first()[0] or 0 if longer else 0
    most = _level(longer, 2 * SAMPLE * SAMPLE_CHARS - rest)
    piece = most // STRETCHES
    stretches = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.substring(text_col, F.floor(k * (size - piece) / (STRETCHES - 1)).cast("int") + 1, F.lit(piece)))
    got = drawn.select("_id", "_label", F.when(size > most, F.concat_ws(" ", stretches)).otherwise(F.col(text_col)).alias(text_col)).toPandas()
    got = got.sort_values(["_id", text_col], kind="stable")
    return [t.encode() for t in got[text_col]], got["_label"].to_numpy(np.float32), row[0] or 0.0


def train(docs: DataFrame, labels: DataFrame, learn, **names: str) -> Model:
    texts, y, share = sample(docs, labels, learn, **names)
    return fit(texts, y, share)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (the whole row as a struct, whatever its columns are named) and ``score``."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    whole, at = docs.select(F.struct("*").alias("row")), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            for part in slices(pa.RecordBatch.from_arrays([row, row.field(at)], names=["row", "text"]), "text"):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sent.value.score(as_binary(part.column("text"))), pa.float64())], names=["row", "score"])

    return whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, score double")


def held_out(id_col, fold: int, rest: int):
    """Whether a row is left out of learning: crc32 of its id as text leaves ``rest`` when divided by ``fold``."""
    return F.crc32(id_col.cast("string").cast("binary")) % fold == rest


def reject(docs: DataFrame, model: Model, *, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below ``limit``."""
    return score(docs, model, text_col).where(F.col("score") < limit).select("row.*")
