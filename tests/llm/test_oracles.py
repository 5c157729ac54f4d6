"""Queries of the ten operators that SQL can express, against DuckDB at sf0.01."""

import duckdb
import pytest

from keyfold.llm import registry

from ..test_catalog import TABLES, rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    rel = con.sql(registry.ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
