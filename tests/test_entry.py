"""Every registered query runs on the smallest tables and agrees with its SQL."""

import math
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from corpusql.session import TABLES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


@pytest.fixture(scope="module")
def con(sf_dir):
    made = duckdb.connect()
    for table in TABLES:
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return made


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, sf_dir, con, name):
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in place) for r in result.fetchall())


def test_entry(spark, sf_dir):
    rows = entry(spark).collect()
    assert {r.lang for r in rows} == {"en", "fr", "de", "es"}
    assert all(r.filename and r.tokens > 0 for r in rows)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
