"""Hard negatives against brute force, and the bounds they rest on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusql.llm import negatives

INF, NAN = float("inf"), float("nan")


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(4)
    for d in (1, 3, 8, 22, 64):
        x, y = rng.integers(-300, 300, (40, d)).astype(float), rng.integers(-300, 300, (30, d)).astype(float) + 50
        a, b = (negatives.pyramid(*negatives.summaries(v)) for v in (x, y))
        exact, room = x @ y.T, None
        for (ma, da), (mb, db) in zip(a, b):
            middle, spread = ma @ mb.T, da @ db.T
            assert (np.abs(exact - middle) <= spread + 1e-6).all()
            assert room is None or spread.sum() <= room.sum() + 1e-6
            room = spread


def rows_of():
    rng = np.random.default_rng(12)
    base = rng.standard_normal((6, 10))
    rows = [(i, (0.5 * base[i % 6] + 0.4 * rng.standard_normal(10) + 0.3).tolist(), int(i % 4)) for i in range(300)]
    rows += [(300 + i, base[0].tolist(), i % 2) for i in range(60)]
    rows += [(400, [1.0, 2.0], 1), (401, [1.0, 2.0], 1), (402, [0.5, 1.0], 2), (500, [], 1), (501, [], 2), (502, [], 1)]
    rows += [(600, None, 1), (601, [1.0] * 10, None), (700, [NAN] + [1.0] * 9, 1), (701, [INF] * 10, 1), (800, [1.0, None], 1), (None, base[0].tolist(), 1)]
    rows += [(100, base[1].tolist(), 0), (100, base[1].tolist(), 0), (7, base[2].tolist(), 3)]
    return rows


@pytest.mark.parametrize("cell_rows, turn_rows", [(4096, 2048), (9, 2)])
def test_against_brute_force(spark, cell_rows, turn_rows):
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, score int").repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, cell_rows=cell_rows, turn_rows=turn_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    fine = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [np.floor(256 * np.array(r[1])).astype(int) for r in fine]
    want = []
    for a, anchor in enumerate(fine):
        if anchor[0] % 100:
            continue
        scored = [(-int(whole[a] @ whole[c]), row[0], row[2]) for c, row in enumerate(fine) if c != a and len(row[1]) == len(anchor[1])]
        for score, positive, _ in sorted(s for s in scored if s[2] == anchor[2])[:5]:
            p = -score
            fit = sorted(s for s in scored if s[2] != anchor[2] and 30 * p <= -100 * s[0] <= 90 * p)[:10]
            want += [(anchor[0], positive, rank, n, p, -s) for rank, (s, n, _) in enumerate(fit, 1)]
    assert len(want) > 200
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_floating_point(spark):
    rows = [(100, [2.0**30, 1.0], "a"), (1, [2.0**29, 3.0], "a"), (2, [2.0**28, 1.0], "b"), (3, [2.0**28, 2.0], "b"), (4, [2.0**28, 2.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = [tuple(r) for r in negatives.mine(df, F.col("vec_id") == 100, n_negatives=2, scale=1).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 3, 2**59 + 3, 2**58 + 2), (100, 1, 2, 4, 2**59 + 3, 2**58 + 2)]
