"""Every query that has SQL gives DuckDB's rows over the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from loomwright.registry import ORACLE_SQL, QUERIES
from loomwright import queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    return sorted((tuple(plain(v) for _, v in sorted(zip(columns, row, strict=True))) for row in rows), key=str)


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_are_those_of_sql(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() >= 0
