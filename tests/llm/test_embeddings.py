import numpy as np
import pytest

from chronolith.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    good = [(i, np.asarray(v, float), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    parent, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a, y) in enumerate(good):
        for j, b, z in good[k + 1 :]:
            if y == z and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, w = sorted((root(i), root(j)))
                parent[w] = x
    return {i: (links[i], root(i)) for i in parent}


def table(seed=0, n=240, dim=16):
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.standard_normal(dim)
    for k in range(n):
        base = centre if k % 3 == 0 else rng.standard_normal(dim)
        rows.append((k, (base + (0.12 if k % 3 == 0 else 1) * rng.standard_normal(dim)).astype(np.float32).tolist(), int(k % 4 != 1)))
    for k in range(40):  # exact copies, and pairs around the limit
        rows.append((1000 + k, rows[3 * (k % 10)][1], rows[3 * (k % 10)][2]))
        a = np.asarray(rows[k][1])
        rows.append((2000 + k, (a + 0.38 * np.linalg.norm(a) / 4 * rng.standard_normal(dim)).astype(np.float32).tolist(), rows[k][2]))
    odd = [None, [], [0.0] * dim, [None, *[1.0] * (dim - 1)], [float("nan"), *[1.0] * (dim - 1)], [float("inf"), *[1.0] * (dim - 1)], [1.0, 2.0], [1.0, 2.0]]
    rows += [(3000 + k, v, 1) for k, v in enumerate(odd)] + [(3100, rows[0][1], None)]
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = table()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), recall=1.0).collect()
    want = brute(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_recall_below_one_stays_above_its_target(spark):
    rows = [r for r in table(1) if r[0] < 3000]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=0.95).collect()
    want = brute(rows)
    assert sum(r["n_links"] for r in got) % 2 == 0
    assert sum(r["n_links"] for r in got) >= 0.9 * sum(v[0] for v in want.values())
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)


def test_traversal_takes_cells_by_rising_bound_and_none_too_few():
    rng = np.random.default_rng(2)
    x = embeddings._unit([v.tobytes() for v in rng.standard_normal((400, 8))])
    grid = embeddings.fit(x, 4000, 0.9)
    own, least = grid.bounds(x)
    for i in range(0, 400, 40):
        cells = grid.visits(least[0][i], least[1][i])
        bounds = [least[0][i][c // len(grid.books[1])] + least[1][i][c % len(grid.books[1])] for c in cells]
        assert bounds == sorted(bounds) and len(set(cells)) == len(cells)
        near = np.flatnonzero(x @ x[i] >= 0.9)
        assert {int(own[0][k] * len(grid.books[1]) + own[1][k]) for k in near} <= set(cells)


def test_repeated_ids_and_empty_table(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a, 0), (2, a, 0), (2, b, 0), (3, b, 0), (None, a, 0), (4, [0.0, 0.0, 1.0, 0.0], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component_id"] for r in got if r["vec_id"] in (1, 2, 3)} == {1}
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, True)]
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_radius_does_not_depend_on_links_in_the_sample():
    """A sample that holds no linked pair, of a table of any size: pairs at the limit are found all the same."""
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    sample = unit(rng.standard_normal((4000, 64)))
    for n in (20_000, 400_000):
        grid = embeddings.fit(sample, n, 0.93, 0.9999)
        x = unit(rng.standard_normal((1500, 64)))
        way = rng.standard_normal(x.shape)
        way = unit(way - (way * x).sum(1)[:, None] * x)
        y = 0.93 * x + (1 - 0.93**2) ** 0.5 * way
        (first, second), (own_a, own_b) = grid.bounds(x)[1], grid.bounds(y)[0]
        at = np.arange(len(x))
        assert np.mean(first[at, own_a] + second[at, own_b] <= grid.radius) >= 0.998
    assert embeddings.fit(sample, 20_000, 0.93, 1.0).radius >= grid.radius


@pytest.mark.parametrize("block", [2048, 50])
def test_sparse_links_have_both_ends(spark, monkeypatch, block):
    """Pairs of cosine 0.93 to 0.99 among vectors that have no other link: found, and counted at both ends or at none."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng, rows = np.random.default_rng(8), []
    for k in range(400):
        a = rng.standard_normal(32)
        way = rng.standard_normal(32)
        way -= (way @ a) / (a @ a) * a
        cosine = rng.uniform(0.9301, 0.99)
        b = cosine * a / np.sqrt(a @ a) + np.sqrt(1 - cosine * cosine) * way / np.sqrt(way @ way)
        rows += [(2 * k, a.tolist(), k % 2), (2 * k + 1, b.tolist(), k % 2)]
    rows += [(1000 + k, rng.standard_normal(32).tolist(), k % 2) for k in range(1500)]
    for recall, least in ((0.9999, 0.99), (0.9, 0.9)):
        got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=recall).collect()
        links = {r["vec_id"]: r["n_links"] for r in got}
        assert all(links[2 * k] == links[2 * k + 1] <= 1 for k in range(400)) and not any(links[1000 + k] for k in range(1500))
        assert sum(links.values()) >= 2 * least * 400
