"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from wayset.plans import catalog

SF = "/root/testdata/sf0.001"


def canonical(rows):
    return sorted(repr(tuple(repr(v) if v is None or isinstance(v, (str, bool)) else repr(float(v)) for v in r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_matches_duckdb(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert canonical(expected) == canonical(tuple(r) for r in found.select(*columns).collect())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
