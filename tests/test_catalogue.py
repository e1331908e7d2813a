"""Every registered query against its SQL over the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

from knitgraph.catalogue import ORACLES, QUERIES

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in Path(SMALLEST).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, tables, name):
    found = QUERIES[name](spark, SMALLEST)
    names = sorted(found.columns)
    result = tables.execute(ORACLES[name])
    columns = [column[0] for column in result.description]
    assert sorted(columns) == names
    order = [columns.index(column) for column in names]
    expected = sorted(tuple(row[i] for i in order) for row in result.fetchall())
    assert sorted(tuple(row[column] for column in names) for row in found.collect()) == expected


def test_entry(spark):
    assert contract.entry(spark).columns == ["src", "dst", "support"]
