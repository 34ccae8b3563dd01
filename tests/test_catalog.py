"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans import catalog

SF = "/root/testdata/sf0.001"
#: Columns that queries hand through and that are null in these tables.
NULL_HERE = {"hour"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, float) or hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    found = df.collect()
    assert len(found) > 0 and all(len(r) == len(df.columns) for r in found)
    # No column is empty throughout: each says something of some row.
    assert [c for k, c in enumerate(df.columns) if all(r[k] is None for r in found) and c not in NULL_HERE] == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
