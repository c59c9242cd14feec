import hashlib
import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import bpe, codes, search

from .fixtures import TEXTS, documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, prose(3, 30)), (2, TEXTS[0][1][:400]), (3, "été ÉTÉ данные one One two"), (3, "naïve"), (4, "nowhere nothing"), (5, None), (6, " .,; "), (None, prose(7, 50)), (1, prose(3, 30)), (7, "changed changed changed")]


def brute_search(rows, items, k=10):
    docs = [(i, Counter(w.translate(LOWER) for w in WORD.findall(t or ""))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, count = sum(n for *_, n in docs), len(docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = set()
    for item, text in {x for x in items if x[1] is not None}:
        asked = Counter(w.translate(LOWER) for w in WORD.findall(text))
        scored = []
        for doc, c, n in docs:
            m = 25 + 75 * n * count // total
            s = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, q in asked.items() if w in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out |= {(item, text, rank, None if null else doc, -s) for rank, (s, null, doc) in enumerate(sorted(scored)[:k], 1)}
    return out


def searched(spark, rows, items, k=10, **names):
    table = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    marks = {(r["item_id"], r["mark"]): r["text"] for r in table.select("item_id", "text", F.xxhash64("item_id", "text").alias("mark")).collect()}
    got = search.rank_documents(documents(spark, rows), table, k).collect()
    out = [(r["item"], marks[r["item"], r["mark"]], r["rank"], r["doc_id"], r["score"]) for r in got]
    assert len(out) == len(set(out))
    return set(out)


def test_search_equals_brute_force(spark, monkeypatch):
    rows = TEXTS + [(100 + k, prose(1000 + k % 7, 25)) for k in range(60)]  # many texts alike, thus ties
    want = brute_search(rows, ITEMS)
    assert searched(spark, rows, ITEMS) == want and len({w[0] for w in want}) >= 5
    monkeypatch.setattr(search, "RUN", 50)
    monkeypatch.setattr(search, "BLOCK_BYTES", 300)
    assert searched(spark, rows, ITEMS, 3) == brute_search(rows, ITEMS, 3)


def test_search_of_nothing(spark):
    assert searched(spark, TEXTS[:0], ITEMS) == set() == searched(spark, [(1, None), (2, " ")], ITEMS)
    assert searched(spark, TEXTS, []) == set() == searched(spark, TEXTS, [(1, None), (2, "")])


def test_search_ignores_clashing_columns(spark):
    docs = documents(spark).withColumns({c: F.lit("x") for c in ("item", "mark", "score", "rank", "id", "terms", "lengths")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("mark", F.lit(1)).withColumn("doc_id", F.lit(2))
    assert search.rank_documents(docs, items).count() == len(brute_search(TEXTS, ITEMS))


def test_radix_order_and_sums():
    rng = np.random.default_rng(5)
    for top in (3, 1 << 17, 1 << 40):
        keys, values = rng.integers(0, top, 3000), rng.integers(-5, 1 << 50, 3000)
        assert (search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
        got_keys, sums = search.summed(keys, values)
        want = Counter()
        for k, v in zip(keys.tolist(), values.tolist()):
            want[k] += v
        assert dict(zip(got_keys.tolist(), sums.tolist())) == want and (np.diff(got_keys) > 0).all()
    assert [len(x) for x in search.summed(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]


ODD = [
    None, "", " \n\t", "Hello  World's <|endoftext|>x ΑΣ 12's !'s ''s 'll 'LLama", "İstanbul ǅ ﬁ é ạ̊ Ᲊ ՘՘x 漢字かな 😀😀 𝒳",
    "a" * 5000, "ab'" * 3000, "\x00\x1c\x1d\x85 　 x\x1cy", "<|startoftext|><|endoftext|> <|endoftext|", "x́" * 300 + " ",
    "Ⅷ ½ ²³ ١٢٣ ꟎ \U00010d50", "thththth" * 400 + "ing " + "é" * 900, prose(3, 30000), "wordé é" * 500 + "\n" + "Été́ " * 2000,
]


@pytest.fixture(scope="module")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def library(vocabulary, texts):
    tokenizers = pytest.importorskip("tokenizers")
    coder = tokenizers.Tokenizer.from_file(vocabulary)
    ids = [coder.encode(t or "", add_special_tokens=False).ids for t in texts]
    return ids, [coder.decode(i, skip_special_tokens=False) for i in ids]


def test_bpe_equals_the_library(spark, vocabulary):
    texts = ODD + [t for _, t in TEXTS]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("Decoded", F.lit(1)).withColumn("extra", F.lit("e")).repartition(3)
    out = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    assert out.columns == ["doc_id", "text", "extra", "ids", "n_tokens", "decoded"]
    ids, decoded = library(vocabulary, texts)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts)
    for k in range(len(texts)):
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == ids[k], texts[k] and texts[k][:60]
        assert (got[k]["n_tokens"], got[k]["decoded"], got[k]["extra"], got[k]["text"]) == (len(ids[k]), decoded[k], "e", texts[k])
    assert bpe.decode(bpe.encode(docs.where("false"), vocabulary), vocabulary).count() == 0


def test_bpe_in_small_pieces_and_with_a_small_cache(vocabulary, monkeypatch):
    coder = bpe.Coder(open(vocabulary, encoding="utf-8").read())
    for name, value in (("PIECE", 40), ("GROUP", 200), ("CACHED", 30), ("LONG", 3)):
        monkeypatch.setattr(bpe, name, value)
    ids, _ = library(vocabulary, ODD)
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(ODD)] == ids


def test_bpe_cuts_are_certain(vocabulary):
    """No token of the vocabulary holds two symbols side by side that are cut apart."""
    spec = json.load(open(vocabulary, encoding="utf-8"))
    coder = bpe.Coder(json.dumps(spec))
    letters = bpe._byte_letters()
    assert sorted(letters.values()) == list(range(256))
    for token in list(spec["model"]["vocab"])[::7]:
        end = token.endswith("</w>")
        symbols = [letters[c] for c in token[: -4 if end else None]]
        if end and symbols:
            symbols[-1] += 256
        assert all(coder.inside[a, b] for a, b in zip(symbols, symbols[1:]))
    assert not coder.inside[256:].any()  # nothing goes on after the end of a word


def test_bpe_of_unknown_ids_and_other_files(spark, vocabulary, tmp_path):
    packed = np.array([343, 999999, 49407, 320], "<u4").tobytes()
    out = bpe.decode(spark.createDataFrame([(packed,), (None,), (b"",)], "ids binary"), vocabulary).collect()
    assert sorted(r["decoded"] for r in out) == ["", "", "x</w> <|endoftext|> a</w>"]
    spec = json.load(open(vocabulary, encoding="utf-8"))
    spec["model"]["end_of_word_suffix"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="word ends"):
        bpe.encode(spark.createDataFrame([("a",)], "text string"), str(tmp_path / "other.json"))


def brute_codes(rows, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    if not kept:
        return {}, ""
    width = -(-max(len(r[1]) for r in kept) // 4) * 4
    limit = codes._limit(width)
    x = [[max(-limit, min(limit, math.floor(1024 * c))) for c in r[1]] + [0] * (width - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0))
    step = width // 4
    cut = [[v[p * step : (p + 1) * step] for v in x] for p in range(4)]
    books = [[cut[p][k] for k in order[:entries]] for p in range(4)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p])) for v in cut[p]]

    for _ in range(rounds):
        for p in range(4):
            found = assign(p)
            for k in range(len(books[p])):
                if own := [v for v, (_, c) in zip(cut[p], found) if c == k]:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = [assign(p) for p in range(4)]
    total = Counter()
    for i, r in enumerate(kept):
        total[r[2]] += sum(f[i][0] for f in found)
    out = Counter((r[0], "".join(f"{f[i][1]:02x}" for f in found), sum(f[i][0] for f in found), total[r[2]]) for i, r in enumerate(kept))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    return [(int(k), rng.normal(size=width).astype(np.float32).tolist(), int(rng.integers(0, 3))) for k in range(n)]


def coded(spark, rows, **how):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("x", F.lit(1)).repartition(3)
    out, books = codes.coded_vectors(table, **how)
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), codes.digest(books)


def test_codes_equal_brute_force(spark):
    rows = vectors(1, 60, 8) + [(900, [0.5] * 8, None), (901, [0.5] * 8, None), (None, [0.25] * 8, 1), (902, [-0.5] * 8, 2)]
    rows += [(903, None, 1), (904, [1.0] * 7 + [None], 1), (905, [float("nan")] * 8, 1), (906, [1.0] * 7 + [float("inf")], 1)]
    assert coded(spark, rows, entries=16) == brute_codes(rows, 16)
    assert coded(spark, rows) == brute_codes(rows)  # fewer vectors than entries


def test_codes_of_repeated_short_and_huge_vectors(spark):
    rows = [(1, [0.1, 0.2, 0.3, 0.4, 0.5], 1)] * 3 + [(2, [], 1), (3, [1.0], 2), (4, [3.0e38, -3.0e38], 2), (5, [0.1] * 5, None)]
    assert coded(spark, rows, entries=2) == brute_codes(rows, 2)
    assert coded(spark, [(1, [], 1)]) == brute_codes([(1, [], 1)])


def test_codes_of_nothing(spark):
    assert coded(spark, [])[0] == coded(spark, [(1, None, 1), (2, [None], 1)])[0] == Counter()


def test_codes_stand_for_vectors_near_by(spark):
    rows = vectors(3, 400, 16)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    prepared, width = codes.prepare(table)
    errors = []
    for rounds in (0, 4):
        books = codes.fit(prepared, width, entries=64, rounds=rounds)
        out = codes.expand(codes.compress(prepared, books, width), books).collect()
        truth = {r[0]: np.floor(1024 * np.array(r[1])) for r in rows}
        assert all(round(float(((truth[r["vec_id"]] - 1024 * np.array(r["approximation"])) ** 2).sum())) == r["error"] for r in out) and len(out) == 400
        errors.append(sum(r["error"] for r in out))
    assert errors[1] < 0.9 * errors[0]


def test_nearest_takes_the_first_of_equal_entries():
    entries = np.array([[5, 5], [1, 1], [1, 1], [3, 3]])
    code, error = codes.nearest(np.array([[1, 1], [2, 2], [5, 5], [4, 4]]), entries)
    assert (code.tolist(), error.tolist()) == ([1, 1, 0, 0], [0, 2, 0, 2])
