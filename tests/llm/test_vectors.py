"""Lattice near-duplicates and exact search against brute force."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusql.llm import lattice, pivots
from corpusql.llm.common import components

INF, NAN = float("inf"), float("nan")


def test_nearest_lattice_point():
    rng = np.random.default_rng(5)
    points = rng.uniform(-2, 2, (200, 8))
    near, second = (x / 2 for x in lattice.decode_e8(points))
    steps = [v for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1) for v in [np.eye(8)[i] * a + np.eye(8)[j] * b]]
    steps += [np.array(s) for s in itertools.product([0.5, -0.5], repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    others = ((points[:, None] - near[:, None] - np.array(steps)) ** 2).sum(axis=2)
    assert (others.min(axis=1) >= ((points - near) ** 2).sum(axis=1) - 1e-12).all()
    assert np.isclose(others.min(axis=1), ((points - second) ** 2).sum(axis=1)).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    u = lattice.unit_rows(rng.standard_normal((6000, 64)))
    w = rng.standard_normal((6000, 64))
    w = lattice.unit_rows(w - (w * u).sum(axis=1, keepdims=True) * u)
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * w
    index = lattice.Lattice(64, lattice.TABLES, lattice.BLOCKS, lattice.SCALE)
    a, b = ({(t, p): k for t, p, k in index.keys(x, lattice.PROBES)} for x in (u, v))
    hit = np.zeros(6000, bool)
    for t, p in a:
        hit |= (a[t, p] == b[t, 0]) | (b[t, p] == a[t, 0])
    assert hit.mean() >= 0.999


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90 and got[201] == 200


def vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 8))
    rows = [(i, (base[i % 40] + 0.05 * rng.standard_normal(8) * (i // 40 > 0)).tolist(), int(i % 3)) for i in range(120)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(30)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [1.0, None] + [1.0] * 6, 0), (303, [NAN] + [1.0] * 7, 0), (304, [INF] * 8, 1)]
    rows += [(305, base[0].tolist(), None), (306, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (309, [], 0), (350, [], 1), (None, base[0].tolist(), 0)]
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string"), rows


def test_near_duplicates(spark):
    df, rows = vectors(spark)
    got = lattice.near_duplicates(df).collect()
    assert len(got) == len(rows)

    def fine(r):
        return r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    good = [r for r in rows if fine(r)]
    links = Counter()
    root = {r[0]: r[0] for r in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(good, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1]), np.array(b[1])
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93 - 1e-12:
                links.update([a[0], b[0]])
                low, high = sorted((find(a[0]), find(b[0])))
                root[high] = low
    for row in got:
        assert row.n_links == links[row.vec_id]
        assert row.component_id == (find(row.vec_id) if row.vec_id is not None else None)
        assert row.kept == (row.vec_id == row.component_id)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows, block_rows", [(4, 16), (60, 1024), (10**6, 1024)])
def test_large_cells_are_compared_in_blocks(spark, cell_rows, block_rows):
    """Near, not equal, vectors in one cell and in several; the sizes of cells and blocks change no row."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((6, 16))
    rows = [(i, (centre[i % 6] + (0.05, 0.2)[i % 2] * rng.standard_normal(16)).tolist(), int(i % 7 == 0)) for i in range(600)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in lattice.near_duplicates(df, cell_rows=cell_rows, block_rows=block_rows).collect()}
    unit, label = lattice.unit_rows(np.array([r[1] for r in rows])), np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    index = lattice.Lattice(16, lattice.TABLES, lattice.BLOCKS, lattice.SCALE)
    keys = list(index.keys(unit, lattice.PROBES))
    own = {t: k for t, p, k in keys if p == 0}
    met = np.zeros_like(linked)
    for t, _, k in keys:
        met |= (own[t][:, None] == k[None]) | (own[t][None] == k[:, None])
    linked &= met | (unit @ unit.T >= 1 - 1e-12)
    np.fill_diagonal(linked, False)
    root = lattice._roots(linked, np.arange(len(rows)), np.arange(len(rows)), len(rows))
    assert linked.sum() > 20_000 and len(got) == len(rows)
    for k, (name, _, _) in enumerate(rows):
        assert got[name].n_links == linked[k].sum()
        assert got[name].component_id == rows[root[k]][0]


@pytest.mark.parametrize("ring_rows, query_rows", [(4096, 4096), (7, 3)])
def test_exact_top_k(spark, ring_rows, query_rows):
    df, rows = vectors(spark)
    got = pivots.top_k(df, F.col("id") % 50 == 0, pivots=4, ring_rows=ring_rows, query_rows=query_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    fine = [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = {r[0]: np.floor(256 * np.array(r[1])).astype(int) for r in fine}
    want = []
    for q in sorted(whole):
        if q % 50 == 0:
            scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert pivots.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_scores_beyond_floating_point():
    q = np.array([[2**40, 3]])
    assert pivots.products(q, np.array([[2**20, 1], [-(2**40), 1]]))[0].tolist() == [2**60 + 3, -(2**63)]
