"""Every core query equals its DuckDB oracle at sf0.01; those without one give rows."""

import math

import duckdb
import pytest

from keyfold.plans import catalog

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if sql := catalog.ORACLES.get(name):
        rel = duck.sql(sql)
        assert got == rows(rel.columns, rel.fetchall())
