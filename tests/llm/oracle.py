"""A query of this subpackage against its DuckDB SQL on tables made for a test."""

import duckdb
import pyarrow as pa

from lockstep.llm import queries


def _plain(rows):
    return sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in rows)


def agrees(found, name, **tables):
    """Whether the DataFrame has the rows of the SQL of query ``name``; ``tables``: DataFrames by name."""
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(table, pa.table(df.toArrow()))
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    got, wanted = _plain(found.select(*names).collect()), _plain(cursor.fetchall())
    assert got == wanted
    return True
