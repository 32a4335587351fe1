"""Every query against its SQL on the smallest test data."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_points

SF_DIR = Path("/root/testdata/sf0.001")
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def in_order(rows):
    return sorted(rows, key=lambda row: [(v is None, 0 if v is None else v) for v in row])


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    frame = entry_points.queries()[name](spark, str(SF_DIR))
    columns = sorted(frame.columns)
    relation = db.sql(entry_points.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in frame.dtypes} == kinds
    places = [relation.columns.index(c) for c in columns]
    expected = in_order(tuple(row[i] for i in places) for row in relation.fetchall())
    assert in_order(tuple(row[c] for c in columns) for row in frame.collect()) == expected


def test_oracles_belong_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
