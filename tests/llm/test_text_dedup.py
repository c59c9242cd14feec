import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import decontam, graph, lines, minhash, passages

from .fixtures import PASSAGE, SCHEMA, TEXTS, documents, edited, prose

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for k, b in sets:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(k)))
                parent[y] = x
    return {i: root(i) for i in parent}


def test_minhash_equals_brute_force(spark):
    rows = [*TEXTS, (20, prose(30, 60)), (21, edited(prose(30, 60), 40)), (22, "x " * 50), (22, prose(31, 20)), (23, prose(31, 20))]
    got = minhash.components(documents(spark, rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    sizes = {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] != 22}
    assert sizes == {i: len(shingle_set(t)) for i, t in rows if i != 22}
    assert len({want[i] for i in (1, 2, 3)}) == 1 and want[4] != 1 and want[8] == want[9] == 8


def test_minhash_large_buckets_and_empty_table(spark):
    """Many texts around one: each is near the first, few are near each other, so buckets hold many components."""
    core = prose(40, 60)
    rows = [(k, edited(core, 9) + " " + prose(100 + k, 3)) for k in range(70)] + [(200, core)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.components(documents(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert minhash.components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_minhash_keeps_one_of_each_group_with_other_columns(spark):
    docs = documents(spark).withColumn("component_id", F.lit("clash")).withColumn("minima", F.lit(1))
    left = minhash.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15]
    assert left.where("doc_id is null").count() == 1


def test_signatures_estimate_similarity():
    import pyarrow as pa

    a, b = prose(50, 400), edited(prose(50, 400), 40)
    hashes, many = minhash.shingles(pa.array([a.encode(), b.encode()], pa.binary()))
    s = minhash.signatures(hashes, many)
    true = len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))
    assert abs((s[0] == s[1]).mean() - true) < 0.12


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, k) for k in range(101, 130)] + [(7, 7), (5, None), (200, 150)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 1 for k in range(1, 31)}, **{k: 100 for k in range(100, 130)}, 150: 150, 200: 150}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def words_of(text):
    return ALNUM.findall((text or "").translate(LOWER))


def brute_decontamination(rows, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(str(item))
    out = []
    for i, text in rows:
        w = words_of(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return out


ITEMS = [(1, " ".join(PASSAGE.split()[10:40]).upper()), (10, "ONE, two!"), (2, None), (3, "..."), (4, prose(60, 30)), (5, " ".join(PASSAGE.split()[30:55])), (5, "naïve 数据")]


def test_decontamination_equals_brute_force(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_words", F.lit("clash"))
    index = decontam.build_index(documents(spark).withColumn("segment", F.lit("clash")))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted(brute_decontamination(TEXTS, ITEMS), key=key)

    def got():
        rows = decontam.report(decontam.match(index, bench)).collect()
        assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in rows)
        return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(sorted(r["items"]))) for r in rows), key=key)

    assert got() == want
    assert {w[0] for w in want if w[2]} == {8, 9, 10, 11, 13}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)  # several passes over the index
    assert got() == want


def test_proximity_and_removal(spark):
    rows = [(1, "alpha beta x gamma delta"), (2, "alpha beta gamma delta"), (3, "gamma alpha"), (None, "alpha beta gamma delta"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    index = decontam.build_index(docs)
    exact = {r["doc_id"] for r in decontam.match(index, bench).where("size(items) > 0").collect()}
    near = {r["doc_id"] for r in decontam.match(index, bench, slop=1).where("size(items) > 0").collect()}
    assert (exact, near) == ({2, None}, {1, 2, None})
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]
    assert decontam.decontaminate(docs, bench.where("false")).count() == 5
    assert decontam.match(decontam.build_index(docs.where("false")), bench).count() == 0


def test_line_dedup(spark):
    common, own = "  All rights reserved.\t", "own line"
    rows = [(k, f"{own} {k}\n{common}\n\nother {k}", f"s{k}") for k in range(12)]
    rows += [(20, common, "s1"), (21, None, "s2"), (22, "", "s3"), (23, f"near\nx\ny {common}", None), (23, f"near\nx\ny {common}", None)]
    rows += [(30 + k, f"nine sites\nz {k}\ny {k}", f"s{k}") for k in range(9)] + [(50 + k, f"ten sites\nz {k}\nw {k}", f"s{k % 10}") for k in range(11)]
    rows += [(70 + k, f"one site\nv {k}\nu {k}", "s1") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: r for r in lines.clean(docs).collect()}
    assert got[3]["text"] == "own line 3\n\nother 3" and (got[3]["n_lines"], got[3]["n_spread"], got[3]["n_removed"]) == (3, 1, 1)
    assert got[20]["text"] == common and (got[20]["n_spread"], got[20]["n_removed"]) == (1, 0)  # a copy as a whole stays
    assert (got[21]["text"], got[21]["n_lines"]) == (None, 0) and (got[22]["text"], got[22]["n_lines"]) == ("", 0)
    assert (got[23]["text"], got[23]["n_removed"]) == (f"near\nx\ny {common}", 0) and got[30]["n_removed"] == 0 and got[70]["n_removed"] == 0
    assert all(got[50 + k]["text"] == f"z {k}\nw {k}" for k in range(11))
    assert lines.clean(docs).count() == len(rows)
    assert lines.clean(docs.where("false")).count() == 0


def test_compact_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(0)
    h = minhash.mix64(rng.integers(0, 40, 130).astype(np.uint64))
    counts, width = np.array([30, 60, 0, 40]), 9
    low, c, high = passages.compact_windows(h, counts, width)
    value = (h & ~passages._PLACE_MASK) | np.arange(len(h), dtype=np.uint64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for k in range(4):
        for i in range(bounds[k], bounds[k + 1]):
            for j in range(i + width - 1, bounds[k + 1]):
                holds = [y for x, y, z in zip(low, c, high) if x <= i <= y <= j <= z]
                assert holds == [i + int(value[i : j + 1].argmin())]
    assert (high - low + 1 >= width).all()


def test_passages(spark):
    rows = [*TEXTS, (30, prose(70, 100) + " " + edited(PASSAGE, 71) + " " + prose(71, 30)), (31, PASSAGE), (32, PASSAGE)]
    got = passages.passages(documents(spark, rows).withColumn("key", F.lit("clash"))).collect()
    text = dict(rows)
    found = {(r["doc_id"], r["other_id"]) for r in got}
    for r in got:
        a, b = text[r["doc_id"]].lower().split()[r["start"] : r["end"]], text[r["other_id"]].lower().split()[r["other_start"] : r["other_end"]]
        s, t = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        assert len(a) >= 50 and len(b) >= 50 and abs(len(s & t) / len(s | t) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.75
    assert {(2, 1), (3, 1), (11, 10), (32, 31)} <= found and any(p[0] == 30 for p in found) and any(p[0] == 31 for p in found)
    assert not {p for pair in found for p in pair} & {5, 6, 7, 8, 9, 12, 13, 14, 15}
    exact = next(r for r in got if (r["doc_id"], r["other_id"]) == (11, 10))
    assert (exact["start"], exact["end"]) == (40, 110)
    assert passages.passages(documents(spark).where("false")).count() == 0


def brute_passage(x, y, width=46):
    """Whether any two ranges of at least ``width`` tokens (all different within a text) are similar enough."""
    at = {int(t): k for k, t in enumerate(y)}
    to = np.array([at.get(int(t), -1) for t in x])
    for s in range(len(x) - width + 1):
        for e in range(s + width, len(x) + 1):
            hit = np.sort(to[s:e][to[s:e] >= 0])
            for a in range(len(hit)):
                ends = np.maximum(hit[a:] + 1, hit[a] + width)
                n = np.where(ends <= len(y), ends - hit[a], np.maximum(hit[a:] + 1 - max(len(y) - width, 0), width))
                common = np.arange(1, len(n) + 1)
                if len(n) and (7 * common >= 3 * (e - s + n)).any() and len(y) >= width:
                    return True
    return False


def test_edited_passages_are_verified_at_every_position():
    import pyarrow as pa

    def edits(words):
        for k in range(len(words)):
            yield "word", words[:k] + ["changed"] + words[k + 1 :]
            yield "phrase", words[:k] + [f"new{m}" for m in range(6)] + words[k + 6 :]
            yield "insertion", words[:k] + [f"more{m}" for m in range(4)] + words[k:]

    lost, seen = [], 0
    for n in (50, 60, 70, 90):
        words = prose(500 + n, n).split()
        for kind, new in edits(words):
            # y is embedded in other text, as a passage of a longer document is
            own, other = " ".join(words), " ".join([*prose(600, 20).split(), *new, *prose(601, 20).split()])
            hashes, counts = minhash.shingles(pa.array([own.encode(), other.encode()], pa.binary()))
            x, y = hashes[: counts[0]], hashes[counts[0] :]
            got = passages.align(x, y)
            assert all(e - s >= 46 and oe - os >= 46 and passages.similar(x[s:e], y[os:oe]) == v >= 0.75 for s, e, os, oe, v in got)
            if kind == "word" or (n, kind) in ((60, "phrase"), (60, "insertion"), (90, "phrase")):
                want = brute_passage(x, y) if n < 70 else True
                seen += want
                if want and not got:
                    lost.append((n, kind, len(new)))
    assert seen > 150 and not lost


def test_windows_before_the_first_document_are_no_hits(spark):
    rng = random.Random(9)
    rows = [(1, "a b c d e f g h i a a a")] + [(10 + k, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))) for k in range(60)]
    items = [(1, "a a b c d e f g h i"), (2, "a b c d e f g h i"), *((10 + k, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))) for k in range(40))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame([*items, *items], "item_id long, text string")
    got = decontam.report(decontam.match(decontam.build_index(docs), bench)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], ",".join(sorted(r["items"]))) for r in got) == sorted(brute_decontamination(rows, items))
    first = next(r for r in got if r["doc_id"] == 1)
    assert "1" not in first["items"] and "2" in first["items"]


def brute_lines(rows, sites=10):
    seen = defaultdict(set)
    bare = lambda x: x.strip(" \t\r")
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if bare(line) and site is not None:
                seen[bare(line)].add(site)
    spread, out = {x for x, s in seen.items() if len(s) >= sites}, []
    for i, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        n, bad = sum(bool(bare(x)) for x in lines), sum(bare(x) in spread for x in lines)
        out.append((i, n, bad, bad if bad < n else 0, "\n".join(x for x in lines if bare(x) not in spread) if 0 < bad < n else text))
    return out


@pytest.mark.parametrize("listed", [lines.LISTED, 0])
def test_line_dedup_equals_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr(lines, "LISTED", listed)
    rng = random.Random(4)
    pool = [f"line {k}" for k in range(12)] + ["", "  ", "\tline 1 \r", "é" * 30]
    rows = [(k % 90, "\n".join([*(rng.choice(pool) for _ in range(rng.randint(0, 9))), *([f"own {k}"] if k % 3 else [])]), rng.choice([None, *(f"s{x}" for x in range(rng.choice([4, 9, 10, 30])))])) for k in range(120)]
    rows += [(500, None, "s1"), (501, "", None), (None, "line 1\nx", "s3"), (502, "line 2\n" * 20000 + "tail", "s2")]
    clash = ("n_spread", "_marked", "_lines", "_bad", "_id", "_print", "_own_print", "a", "b", "sites")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit(c).alias(c) for c in clash)).repartition(3)
    got = lines.clean(docs)
    assert got.columns == [*(c for c in docs.columns if c not in lines.OUTPUT), *lines.OUTPUT]
    got = got.collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_spread"], r["n_removed"], r["text"]) for r in got), key=key) == sorted(brute_lines(rows), key=key)
    assert all(r[c] == c for r in got for c in clash[1:])
    assert lines.clean(docs.where("false")).count() == 0


@pytest.mark.parametrize("sizes", [(2, 3, 2000), (2, 64, 4 << 20)])
def test_minhash_blocks_of_few_bytes(spark, monkeypatch, sizes):
    for name, value in zip(("SMALL", "BLOCK", "BLOCK_BYTES"), sizes):
        monkeypatch.setattr(minhash, name, value)
    core = prose(41, 80)
    rows = [(k, edited(core, 9 + k % 7) + " " + prose(300 + k, 2)) for k in range(40)] + [(200, core), (201, core), (300, None)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.components(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_removal_passes_columns_of_any_name(spark):
    names = ("gone", "bad", "_gone", "_bad", "doc", "a", "spans", "row")
    docs = documents(spark).select("*", *(F.lit(c).alias(c) for c in names))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("bad", F.lit(1))
    for left in (minhash.deduplicate(docs), decontam.decontaminate(docs, bench)):
        assert left.columns == docs.columns and all(r[c] == c for r in left.collect() for c in names)


def brute_runs(rows, least=46):
    """Pairs of texts with a common run of that many five-word shingles."""
    where, out = defaultdict(set), set()
    for i, text in rows:
        words = (text or "").split()
        for k in range(len(words) - least - 3):
            where[tuple(words[k : k + least + 4])].add(i)
    for ids in where.values():
        out |= {(b, a) for a in ids for b in ids if a < b}
    return out


def groups(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in list(parent)}


def test_exact_passages_around_a_block_that_many_texts_hold(spark, monkeypatch):
    """No link is lost: texts that share a passage are connected by passages, also if the first text of all their
    tokens holds only a block of it, and nothing else is connected."""
    monkeypatch.setattr(passages, "CROWD", 1000)
    block = prose(7000, 38)
    rows = [(k, f"{prose(7100 + k, 30)} {block} {prose(7300 + k, 30)}") for k in range(120)]
    for k, (left, right) in enumerate([(15, 0), (0, 15), (8, 8), (40, 40), (12, 0), (0, 12), (6, 6), (2, 2)]):
        ends = prose(8000 + k, left), prose(8100 + k, right)
        rows += [(1000 + 10 * k + m, f"{prose(8200 + 10 * k + m, 25)} {ends[0]} {block} {ends[1]} {prose(8400 + 10 * k + m, 25)}") for m in range(3)]
    rows = [(i, " ".join(t.split())) for i, t in rows]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute_runs(rows)
    assert len(want) == 21 and groups((r["doc_id"], r["other_id"]) for r in got) == groups(want)


def test_recall_of_near_passages(spark):
    """Passages with random edits in random texts, against a comparison of each planted pair by brute force."""
    import pyarrow as pa

    rng, rows = random.Random(77), []
    for k in range(120):
        words = prose(9000 + k, rng.randint(55, 120)).split()
        other = list(words)
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 2)] = prose(rng.randrange(1 << 30), rng.randint(0, 2)).split()
        rows += [(2 * k + m, " ".join([*prose(20000 + 2 * k + m, 40).split(), *w, *prose(30000 + 2 * k + m, 40).split()])) for m, w in enumerate((words, other))]
    got = {(r["doc_id"], r["other_id"]) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hashes, counts = minhash.shingles(pa.array([t.encode() for _, t in rows], pa.binary()))
    tokens = np.split(hashes, np.cumsum(counts)[:-1])
    want = {(2 * k + 1, 2 * k) for k in range(120) if passages.align(tokens[2 * k + 1], tokens[2 * k])}
    assert len(want) > 90 and len(got & want) >= 0.9 * len(want) and got <= want


def test_fingerprints_do_not_depend_on_what_is_beyond():
    rng = np.random.default_rng(5)
    a, b, p = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (30, 70, 46))
    for at in range(46):
        one, two = (set(passages.fingerprints(np.concatenate(x), np.array([len(x[0]) + at]))[0].tolist()) for x in ((a, p, b), (b, p, a)))
        assert one & two, at


def test_word_hashes_depend_on_the_word_only():
    import pyarrow as pa

    from chronolith.llm.common import word_hashes

    words = [b"a", b"ab", b"ba", b"ab" * 400, "é".encode(), b"\x00", b"\x00\x00", *(str(k).encode() for k in range(5000))]
    every = word_hashes(pa.array(words, pa.binary()))
    assert len(set(every.tolist())) == len(words) and len(word_hashes(pa.array([], pa.binary()))) == 0
    assert (word_hashes(pa.array([b"first", *words], pa.binary()).slice(1)) == every).all() and (word_hashes(pa.array(words, pa.binary()), 100) == every).all()
    assert word_hashes(pa.array(words[::-1], pa.binary())).tolist() == every.tolist()[::-1]


@pytest.mark.parametrize("block", [30, 36, 44])
def test_edited_passages_around_a_block_that_all_texts_hold(spark, block):
    """Pairs that share 62 words but one, the middle of which every text holds; most must be connected, and no others."""
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 8)))
    words = lambda n: [word() for _ in range(n)]
    middle, left, texts, pairs = words(block), (62 - block) // 2, [], []
    for _ in range(100):
        one = words(left) + middle + words(62 - block - left)
        two = list(one)
        two[rng.randrange(62)] = word()
        a, b = ({tuple(p[k : k + 5]) for k in range(58)} for p in (one, two))
        assert 100 * len(a & b) >= 75 * len(a | b)
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(words(rng.randint(20, 80)) + p + words(rng.randint(20, 80))) for p in (one, two)]
    place = list(range(len(texts)))
    rng.shuffle(place)
    docs = spark.createDataFrame([(place[k], t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {frozenset(r) for r in passages.passages(docs).select("doc_id", "other_id").collect()}
    wanted = {frozenset(place[x] for x in p) for p in pairs}
    if block < 42:  # else the block alone is a passage of any two texts
        assert found <= wanted
    assert len(found & wanted) >= 95


def test_passages_edited_on_both_sides_of_a_block_that_all_texts_hold(spark):
    """Pairs that share 75 words but the one before and the one after a block of all texts: every pair is connected."""
    middle, rows = prose(50000, 43).split(), []
    for k in range(60):
        left, right = prose(50100 + k, 16).split(), prose(50200 + k, 16).split()
        for m, (a, b) in enumerate(((left, right), ([*left[:15], f"before{k}"], [f"after{k}", *right[1:]]))):
            rows.append((2 * k + m, " ".join([*prose(50300 + 2 * k + m, 40).split(), *a, *middle, *b, *prose(50500 + 2 * k + m, 40).split()])))
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(2 * k + 1, 2 * k) for k in range(60)} <= {(r["doc_id"], r["other_id"]) for r in got}


def test_texts_of_a_cell_meet_if_each_has_enough_of_the_other():
    x = np.random.default_rng(3).permutation(1 << 16)[:900].astype(np.uint16)
    own, thin, beyond = x[:60], np.stack([x[:60], x[60:120], x[120:180]], 1).ravel(), x[180:200]
    scattered = np.concatenate([np.concatenate([[t], x[300 + 9 * k : 309 + 9 * k]]) for k, t in enumerate(own)])  # longer than the rows of a grid
    held, long = np.concatenate([beyond, own]), np.concatenate([beyond, own, x[300:800]])
    one, two = np.array([1, 2]), np.array([0, 0])
    for other, want in ((thin, []), (scattered, []), (held, [(2, 1)]), (long, [(2, 1)])):
        for near in ((other, own), (own, other)):
            met = passages._cell(one, two, one, two, [t.tobytes() for t in near])
            assert list(zip(met.column("doc").to_pylist(), met.column("other").to_pylist())) == want


def test_near_copies_edited_throughout_do_not_meet_in_a_cell():
    """Texts that miss a little of each other everywhere, so that no range is similar, make no pairs; the sum of both sides counts."""
    tokens = np.random.default_rng(4).permutation(1 << 16)[: 41 * 140].astype(np.uint16).reshape(41, 140)
    near = []
    for own in tokens[1:]:
        text = tokens[0].copy()
        for at in range(int(own[0]) % 24, 140, 24):
            text[at : at + 5] = own[at : at + 5]  # a word changed in every 24, in other places of each text
        near.append(text.tobytes())
    each, zero = np.arange(40), np.zeros(40, np.int64)
    assert passages._cell(each, each, each, zero, near).num_rows < 10  # of 780
    near[7] = np.concatenate([np.frombuffer(near[3], np.uint16)[:60], tokens[8][60:]]).tobytes()
    met = passages._cell(each, each, each, zero, near)
    assert (7, 3) in set(zip(met.column("doc").to_pylist(), met.column("other").to_pylist()))


def test_no_range_is_worth_more_than_is_counted(monkeypatch):
    monkeypatch.setattr(passages, "MIN_TOKENS", 6)
    rng, exact = np.random.default_rng(0), 0
    for _ in range(600):
        n = int(rng.integers(6, 24))
        x, y = rng.integers(0, rng.integers(2, 40), n), rng.integers(0, 40, rng.integers(1, 30))
        ranges = [set(x[s:e].tolist()) for s in range(n) for e in range(s + 6, n + 1)]
        most = max(len(r & set(y.tolist())) - 6 * len(r - set(y.tolist())) for r in ranges)
        got = passages.worth(np.isin(x, y)[None], *passages.repeats(x))[0]
        assert got >= most
        exact += got == most
    assert exact > 500
