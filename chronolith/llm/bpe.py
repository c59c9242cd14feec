"""Byte-pair encoding by forced boundaries, and decoding.

A vocabulary file says how text is normalised, cut into words and which pairs merge in which order. Words become symbols:
a byte, or a byte that ends its word. Two symbols that stand side by side inside no token of the vocabulary can never
merge into one, so there is a certain cut between them, and the fragments between cuts are encoded on their own:
equal fragments once, those that were met before from a bounded cache. Their ids, concatenated, are the ids of the text.

Cuts and fragments are found for about 2 MB of text at a time on numpy arrays. Short fragments are merged together, a
merge of the lowest rank (the leftmost of equal ones) in each a round; long ones with a heap, in n log n steps. A text is
normalised in pieces that end in white space before an ASCII character, where neither words nor composed characters
span the cut, so that what a task holds of a long text beside it are its ids, four bytes each.

The file is read once by the driver from a path that is a parameter, and sent to the executors. Normalising uses
the tokenizers library's own Unicode tables. Words are found by the file's pattern, with the regex library; characters
that its tables class otherwise than the tokenizers library's send their piece through the latter's pre-tokenizer.

Defined cases: a null or empty text, or one of white space only, has no ids and decodes to an empty string; added tokens
of the file (such as ``<|endoftext|>``) that occur in a text are single ids; ids that the file does not have are left
out when decoding; input columns that are named as outputs are replaced, others pass; an empty table stays empty.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches, slices

#: Characters of a piece of text, and of the pieces that are encoded together.
PIECE = 1 << 20
GROUP = 2 << 20
#: Symbols of the fragments that a cache holds before it begins anew; longer fragments than LONG are merged with a heap.
CACHED = 4 << 20
LONG = 48
_FREE = np.int64(1) << 62


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, then 256 and up for the rest."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder:
    """A vocabulary with its pair table and the cache of fragments, one for each Python worker."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"]
        steps = pre.get("pretokenizers", [])
        known = model["type"] == "BPE" and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"]
        if not known or not model["end_of_word_suffix"] or model["dropout"] or spec["decoder"] or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("only byte-level BPE with word ends, words found by one pattern and no decoder is known here")
        self.library = Tokenizer.from_str(text)
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.alike: set[str] = set(map(chr, range(128)))
        self.odd: set[str] = set()
        self._tables(model)
        token = {i: t for names in (model["vocab"], self.added) for t, i in names.items()}
        self.tokens = pa.array([token.get(i) for i in range(self.size)], pa.string())
        self.forget()

    def _tables(self, model: dict) -> None:
        suffix, letters, vocab = model["end_of_word_suffix"], _byte_letters(), model["vocab"]
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        self.first = np.zeros(512, np.int64)
        for c, b in letters.items():
            self.first[b], self.first[256 + b] = vocab[c], vocab[c + suffix]
        self.inside = np.zeros((512, 512), bool)
        for token in vocab:
            word = token.endswith(suffix)
            symbols = [letters[c] for c in (token[: -len(suffix)] if word else token)]
            if word and symbols:
                symbols[-1] += 256
            self.inside[symbols[:-1], symbols[1:]] = True
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pair = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        # Of a pair that is listed twice the later entry counts, as in a map that is filled in order.
        last = {p: r for r, p in enumerate(pair.tolist())}
        self.pairs = np.array(sorted(last), np.int64)
        self.rank = np.array([last[p] for p in self.pairs.tolist()], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.sizes, self.cached = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, ``_FREE >> 32`` for none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], _FREE >> 32)

    def merge_short(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments after all merges, and how many each has; one merge in every fragment a round."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            rank = np.full(len(ids), _FREE >> 32)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.ranks(ids[:-1], ids[1:]), _FREE >> 32)
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            going = best < _FREE
            live = np.repeat(going, np.diff(starts, append=len(ids)))
            done.append((owner[~live], ids[~live]))
            at = best[going] & 0xFFFFFFFF
            ids[at] = self.made[best[going] >> 32]
            live[at + 1] = False
            ids, owner = ids[live], owner[live]
        owner, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same of one fragment, in n log n steps."""
        token, n = ids.tolist(), len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.ranks(ids[:-1], ids[1:])
        found = np.flatnonzero(rank < _FREE >> 32)
        heap = [(r, a, token[a], token[a + 1]) for r, a in zip(rank[found].tolist(), found.tolist())]
        heapq.heapify(heap)
        while heap:
            r, a, left, right = heapq.heappop(heap)
            b = after[a] if token[a] == left else -1
            if b < 0 or token[b] != right:
                continue  # one of the two has been merged since
            token[a], token[b], after[a] = int(self.made[r]), -1, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            for x in (before[a], a):
                y = after[x] if x >= 0 else -1
                if y >= 0:
                    new = int(self.ranks(np.array([token[x]]), np.array([token[y]]))[0])
                    if new < _FREE >> 32:
                        heapq.heappush(heap, (new, x, token[x], token[y]))
        return np.array([t for t in token if t >= 0], np.int64)

    def words(self, piece: str) -> list[str]:
        """The words of a piece of text between added tokens, normalised."""
        if piece.isascii():
            return self.pattern.findall(piece.lower())
        piece = self.library.normalizer.normalize_str(piece)
        if new := set(piece) - self.alike - self.odd:
            for c in new:  # the classes show in how a pair of the character is cut between a letter and a sign
                probe = f"a{c}{c}!"
                same = [m.span() for m in self.pattern.finditer(probe)] == [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(probe)]
                (self.alike if same else self.odd).add(c)
        if self.odd and not self.odd.isdisjoint(piece):
            return [piece[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(piece)]
        return self.pattern.findall(piece)

    def pieces(self, text: str) -> Iterator[str | int]:
        """A text as pieces of bounded size and the ids of added tokens between them."""
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                yield self.added[part]
                continue
            at = 0
            while at < len(part):
                cut = _SAFE.search(part, at + PIECE) if len(part) - at > PIECE else None
                end = cut.end() if cut else len(part)
                yield part[at:end]
                at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit little-endian integers."""
        out = [bytearray() for _ in texts]
        group: list[tuple[int, str | int]] = []
        size = 0
        for row, text in enumerate(texts):
            for piece in self.pieces(text or ""):
                group.append((row, piece))
                size += len(piece) if isinstance(piece, str) else 1
                if size >= GROUP:
                    self._flush(group, out)
                    group, size = [], 0
        self._flush(group, out)
        return [bytes(b) for b in out]

    def _flush(self, group: list[tuple[int, str | int]], out: list[bytearray]) -> None:
        pieces = [p for _, p in group if isinstance(p, str)]
        ids, bounds = self.encode_pieces(pieces)
        k = 0
        for row, piece in group:
            if isinstance(piece, str):
                out[row] += ids[bounds[k] : bounds[k + 1]].tobytes()
                k += 1
            else:
                out[row] += piece.to_bytes(4, "little")

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the bounds of each piece's."""
        raw = [("\n".join(w) + "\n").encode() if (w := self.words(p)) else b"" for p in pieces]
        stream = np.frombuffer(b"".join(raw), np.uint8)
        gap = stream == 10
        symbols = stream.astype(np.uint16)
        symbols[:-1][gap[1:]] += 256  # words are never empty, so what precedes a gap ends a word
        ends = np.cumsum(~gap)[np.cumsum([len(r) for r in raw], dtype=np.int64) - 1] if len(stream) else np.zeros(len(raw), np.int64)
        ends[np.cumsum([len(r) for r in raw]) == 0] = 0
        symbols = symbols[~gap]
        if not len(symbols):
            return np.empty(0, "<u4"), np.zeros(len(pieces) + 1, np.int64)
        starts = np.append(0, np.flatnonzero(~self.inside[symbols[:-1], symbols[1:]]) + 1)
        fragments = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((2 * np.append(starts, len(symbols))).astype(np.int32)), pa.py_buffer(symbols)]).dictionary_encode()
        table, flat, sizes = self.lookup(fragments.dictionary.to_pylist())
        code = table[fragments.indices.to_numpy()]
        size = sizes[code]
        offsets = np.append(0, np.cumsum(size))
        begin = (np.cumsum(sizes) - sizes)[code]
        ids = flat[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
        return ids.astype("<u4"), np.append(0, offsets[np.searchsorted(starts, ends)])

    def lookup(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each of the distinct fragments in the cache, which is filled first, and the cache's ids and sizes."""
        if self.cached > CACHED:
            self.forget()
        number = np.fromiter(map(self.known.get, fragments, repeat(-1)), np.int64, len(fragments))
        new = np.flatnonzero(number < 0)
        if len(new):
            missing = [fragments[k] for k in new.tolist()]
            lengths = np.fromiter(map(len, missing), np.int64, len(missing)) // 2
            short = lengths <= LONG
            parts = [self.merge_short(self.first[np.frombuffer(b"".join([f for f, s in zip(missing, short) if s]), np.uint16)], lengths[short])] if short.any() else []
            parts += [(m := self.merge_long(self.first[np.frombuffer(missing[k], np.uint16)]), np.array([len(m)])) for k in np.flatnonzero(~short)]
            order = new[np.append(np.flatnonzero(short), np.flatnonzero(~short))]
            number[order] = len(self.sizes) + np.arange(len(order))
            self.known.update(zip([fragments[k] for k in order.tolist()], number[order].tolist()))
            self.ids = np.concatenate([self.ids, *[p[0] for p in parts]])
            self.sizes = np.concatenate([self.sizes, *[p[1] for p in parts]])
            self.cached += int(lengths.sum())
        return number, self.ids, self.sizes

    def decode(self, ids: pa.Array) -> pa.Array:
        """The tokens of each row of packed ids, joined by blanks."""
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        flat = np.frombuffer(ids.buffers()[2] or b"", "<u4")[offsets[0] // 4 : offsets[-1] // 4]
        bounds = (offsets - offsets[0]) // 4
        known = flat < self.size
        tokens = self.tokens.take(pa.array(np.where(known, flat, 0)))
        if not known.all() or tokens.null_count:
            keep = known & np.asarray(tokens.is_valid())
            bounds, tokens = np.append(0, np.cumsum(keep))[bounds], tokens.filter(pa.array(keep))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tokens), " ")


#: White space before an ASCII character: a piece may end after the former.
_SAFE = regex.compile(r"[\t-\r ](?=[\x21-\x7E])")


@lru_cache(maxsize=2)
def _coder(text: str) -> Coder:
    return Coder(text)


def _sent(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        text = file.read()
    Coder(text)  # a file of another kind is refused here, not in the tasks
    return docs.sparkSession.sparkContext.broadcast(text)


def _extended(docs: DataFrame, *fields: T.StructField) -> tuple[list[str], T.StructType, pa.Schema]:
    taken = {f.name.lower() for f in fields}
    kept = [c for c in docs.columns if c.lower() not in taken]
    schema = T.StructType([*docs.select(*kept).schema, *fields])
    return kept, schema, pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary: 32-bit little-endian integers) and ``n_tokens``."""
    bound_batches(docs.sparkSession)
    sent = _sent(docs, path)
    kept, schema, arrow = _extended(docs, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value)
        for batch in batches:
            for part in slices(batch, text_col):
                ids = coder.encode(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c).cast(arrow.field(c).type) for c in kept], pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())], schema=arrow)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the tokens of its packed ids, joined by blanks; null ids give an empty string."""
    bound_batches(encoded.sparkSession)
    sent = _sent(encoded, path)
    kept, schema, arrow = _extended(encoded, T.StructField("decoded", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value)
        for batch in batches:
            for part in slices(batch, ids_col):
                texts = coder.decode(pc.fill_null(part.column(ids_col), b""))
                yield pa.RecordBatch.from_arrays([*[part.column(c).cast(arrow.field(c).type) for c in kept], texts], schema=arrow)

    return encoded.mapInArrow(run, schema)
