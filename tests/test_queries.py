"""Registered queries against their SQL, all of them on whole small tables."""

import math

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from moodfeed import oracles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return c


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def key(row):
    """Rows in one order on both sides; rounding must not part them."""
    return tuple(f"{x:.4f}" if isinstance(x, float) else str(x) for x in row)


def same(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)
    return x == y


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=key)
    rows = con.sql(oracle_sql()[name])
    assert sorted(rows.columns) == columns
    expected = sorted(rows.select(*columns).fetchall(), key=key)
    assert len(got) == len(expected)
    unlike = [(a, b) for a, b in zip(got, expected) if not all(map(same, a, b))]
    assert not unlike, unlike[:3]
