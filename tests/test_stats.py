import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusql.operators import quantile, stats


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [
        (i, rng.choice([None, 0.0, 1.5, -2.0, 9.25]), rng.choice([None, "a", "b", "c"]), rng.choice([None, True, False]), None)
        for i in range(300)
    ]
    return rows, spark.createDataFrame(rows, "k int, x double, s string, b boolean, gone string").repartition(5)


def by_column(df):
    return {r.column_name: r for r in df.collect()}


def test_column_statistics_against_brute_force(table):
    rows, df = table
    got = by_column(stats.column_statistics(df, "t"))
    for i, name in enumerate(["k", "x", "s", "b", "gone"]):
        values = [r[i] for r in rows if r[i] is not None]
        r = got[name]
        assert (r.total_count, r.non_null_count, r.null_count) == (300, len(values), 300 - len(values))
        if name in ("k", "x"):
            assert r.mean == pytest.approx(np.mean(values))
            assert (r.min, r.max) == (min(values), max(values))
            assert r.non_zero_count == sum(v != 0 for v in values)
            assert r.unique_count is None
        elif name == "b":
            assert (r.true_count, r.false_count, r.unique_count) == (values.count(True), values.count(False), 2)
        else:
            assert r.unique_count == len(set(values))
            best = min(set(values), key=lambda v: (-values.count(v), v)) if values else None
            assert r.most_common == best


def test_parts_agree_with_the_whole(table):
    _, df = table
    whole = by_column(stats.column_statistics(df, "t"))
    for part in (stats.counts(df), stats.numeric(df), stats.boolean(df), stats.string(df)):
        for r in part.collect():
            for field in set(r.asDict()) & set(stats.STAT_COLUMNS):
                assert r[field] == whole[r.column_name][field]


def test_top_values_break_ties_by_text(spark):
    df = spark.createDataFrame([(v,) for v in "bbaaccd"], "s string")
    got = [(r.value, r.n) for r in stats.top_values(df, 3).orderBy("rank").collect()]
    assert got == [("a", 2), ("b", 2), ("c", 2)]


def test_top_values_are_limited_before_the_shuffle(spark, capsys):
    df = spark.range(1000).select(F.col("id").cast("string").alias("s"))
    stats.top_values(df).explain()
    plan = capsys.readouterr().out
    assert "row_number(), 50, Partial" in plan


def test_numbers_only_and_texts_only(spark):
    assert stats.column_statistics(spark.range(3), "n").count() == 1
    texts = spark.createDataFrame([("a",)], "s string")
    assert stats.extended(texts).collect()[0].percentile is None


def test_failing_table_is_skipped(spark):
    class Broken:
        @property
        def schema(self):
            raise RuntimeError("gone")

    made = stats.all_table_statistics({"bad": Broken(), "good": spark.range(2)})
    assert {r.table_name: r.error is None for r in made.collect()} == {"bad": False, "good": True}


def test_statistics_text(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "y", None), (None, "x", False)], "n int, s string, b boolean")
    got = {r.column_name: r.line for r in stats.statistics_text(df, "t").collect()}
    assert got["n"] == "- n (int): 2/3 non-null values, range [1.00 - 2.00], mean 1.50"
    assert got["s"] == "- s (string): 3/3 non-null values, values: ['x', 'y']"
    assert got["b"] == "- b (boolean): 2/3 non-null values, values: [False, True]"


@pytest.mark.parametrize("fraction", [0.0, 0.05, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("kind", ["spread", "ties", "hot"])
def test_percentiles_against_numpy(spark, fraction, kind):
    rng = np.random.default_rng(7)
    values = {
        "spread": rng.normal(size=997), "ties": rng.integers(0, 5, 1000).astype(float),
        "hot": np.where(rng.random(1000) < 0.6, 3.0, rng.normal(size=1000)),
    }[kind]
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)] + [(0, None)], "g int, v double")
    got = {r.g: r.percentile for r in quantile.exact_percentiles(df, "v", fraction, ["g"]).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(np.quantile(values[g::2], fraction), abs=1e-9)


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.951, 1.0])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_percentiles_in_rounds(spark, fraction, keys):
    """So few values may be walked that several rounds of cells are needed; null is a key of its own."""
    rng = np.random.default_rng(8)
    values = np.where(rng.random(30_000) < 0.3, 2.0, np.exp(rng.normal(size=30_000) * 6))
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, float(v)) for i, v in enumerate(values)], "g int, v double")
    got = {r.g if keys else 0: r.percentile for r in quantile.exact_percentiles(df, "v", fraction, keys, walk_rows=12).collect()}
    want = {None: values[::3], 1: values[1::3], 2: values[2::3]} if keys else {0: values}
    assert set(got) == set(want)
    for g, own in want.items():
        assert got[g] == pytest.approx(np.quantile(own, fraction), rel=1e-12)


def test_percentile_of_one_and_of_none(spark):
    one = spark.createDataFrame([(5.0,)], "v double")
    assert quantile.exact_percentiles(one, "v", 0.95).collect()[0].percentile == 5.0
    none = spark.createDataFrame([(None,)], "v double")
    assert [r.percentile for r in quantile.exact_percentiles(none, "v", 0.95).collect()] in ([], [None])


def test_mode(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,)], "n int")
    assert stats.extended(df).collect()[0]["mode"] == "2"
