"""The operators that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    want = con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*sorted(got.columns)).collect())
