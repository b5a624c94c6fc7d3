"""Statistics stored per batch against the whole rows."""

from collections import Counter

import numpy as np
import pytest

from corpusql.operators import statstore

SCHEMA = "k long, x double, s string, gone string, batch string"


@pytest.fixture
def made(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [
        (i, None if i % 9 == 0 else float(rng.normal()), f"v{int(rng.zipf(1.6)) % 400}" if i % 5 else None, None, f"b{i * 4 // 9000}")
        for i in range(9000)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = str(tmp_path / "store")
    for b in range(4):
        statstore.add_batch(df.filter(f"batch = 'b{b}'").drop("batch"), out, f"b{b}", 0.01)
    return rows, df, out


def test_merged_batches_describe_the_whole(spark, made):
    rows, df, out = made
    got = {r.column_name: r for r in statstore.stored_statistics(spark, out).collect()}
    xs = sorted(r[1] for r in rows if r[1] is not None)
    assert (got["x"].total_count, got["x"].non_null_count, got["x"].null_count) == (9000, len(xs), 9000 - len(xs))
    assert got["x"].mean == pytest.approx(np.mean(xs)) and (got["x"].min, got["x"].max) == (xs[0], xs[-1])
    for fraction, value in ((0.5, got["x"].p50), (0.95, got["x"].p95)):
        assert abs(np.searchsorted(xs, value) / len(xs) - fraction) < 0.01
    for name, i in (("k", 0), ("x", 1), ("s", 2)):
        exact = len({r[i] for r in rows} - {None})
        assert abs(got[name].approx_unique - exact) <= 0.06 * exact
    assert got["s"].mean is None and got["s"].p50 is None and got["gone"].non_null_count == got["gone"].approx_unique == 0
    some = {r.column_name: r for r in statstore.stored_statistics(spark, out, ["b1", "b2"]).collect()}
    assert (some["k"].min, some["k"].max) == (min(r[0] for r in rows if r[4] in ("b1", "b2")), max(r[0] for r in rows if r[4] in ("b1", "b2")))


def test_frequent_values_are_exact_and_follow_replaced_batches(spark, made):
    rows, df, out = made

    def want(rows):
        counts = Counter(r[2] for r in rows if r[2] is not None)
        return {v: n for v, n in counts.items() if n >= 0.012 * sum(counts.values())}

    def got(df):
        found = statstore.frequent_values(df, out, "batch", 0.012).collect()
        assert [r.value for r in sorted(found, key=lambda r: r["rank"])] == [r.value for r in sorted(found, key=lambda r: (-r.n, r.value))]
        return {r.value: r.n for r in found if r.column_name == "s"}

    assert got(df) == want(rows)
    assert got(df) == want(rows)
    # A rare value fills a new batch: its rows in the older batches have to be counted.
    more = [(10_000 + i, 1.0, "v399" if i % 2 else "v1", None, "b4") for i in range(400)]
    new = spark.createDataFrame(more, SCHEMA)
    statstore.add_batch(new.drop("batch"), out, "b4", 0.01)
    assert got(df.union(new)) == want(rows + more)
    # The same batch with other rows takes the place of its old counts.
    other = [(r[0], r[1], "v2", None, "b0") if r[4] == "b0" else r for r in rows]
    changed = spark.createDataFrame(other, SCHEMA)
    statstore.add_batch(changed.filter("batch = 'b0'").drop("batch"), out, "b0", 0.01)
    assert got(changed.union(new)) == want(other + more)


def test_batches_without_rows_and_wrong_names(spark, tmp_path):
    empty = spark.createDataFrame([], "k long, s string, batch string")
    out = str(tmp_path / "empty")
    statstore.add_batch(empty.drop("batch"), out, "none", 0.5)
    got = {r.column_name: r for r in statstore.stored_statistics(spark, out).collect()}
    assert got["k"].total_count == 0 and got["k"].mean is None and got["k"].p50 is None and got["s"].approx_unique == 0
    assert statstore.frequent_values(empty, out, "batch", 0.5).count() == 0
    with pytest.raises(ValueError):
        statstore.add_batch(empty, out, "../x")
    with pytest.raises(ValueError):
        statstore.frequent_values(empty, out, "batch", 0.1)
