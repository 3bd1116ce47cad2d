"""Every registered query against its SQL, over the whole smallest tables."""

import decimal
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
SF_DIR = os.environ.get("CONFORMANCE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    return value


def sorted_rows(columns, found):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in places) for row in found), key=repr)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, oracle, name):
    df = queries()[name](spark, SF_DIR)
    found = sorted_rows(df.columns, df.collect())
    if name not in oracle_sql():
        assert found
        return
    result = oracle.execute(oracle_sql()[name])
    columns = [column[0] for column in result.description]
    expected = sorted_rows(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(found) == len(expected)
    different = [(a, b) for a, b in zip(found, expected) if a != b]
    assert not different, different[:3]
    assert found, "the query should have rows to compare"


def test_entry(spark):
    assert entry(spark).count() > 0
