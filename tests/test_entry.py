"""The driver's contract, and every positional query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lockstep import queries as positional

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(positional.ORACLE_SQL) == set(positional.QUERIES)


@needs_tables
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(positional.QUERIES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = positional.QUERIES[name](spark, SF)
    cursor = con.execute(positional.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    plain = lambda rows: sorted(str([float(x) if isinstance(x, (int, float)) else x for x in r]) for r in rows)
    assert plain(found.select(*(f"`{n}`" for n in names)).collect()) == plain(cursor.fetchall())
