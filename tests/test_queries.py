"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.oracle import ORACLE
from checks.queries import QUERIES
from tools.compare import TABLES, rows_of

FOLDER = os.environ.get("QUERY_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for table in TABLES:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return base


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    result = queries()[name](spark, FOLDER)
    cursor = duck.execute(oracle_sql()[name])
    columns = [item[0] for item in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert rows_of(result.columns, [tuple(row) for row in result.collect()]) == rows_of(columns, cursor.fetchall())
