"""Every registered query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from corpusloom.plans import further, queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else round(float(value), 5)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in queries.SQL:
        assert got
        return
    told = duck.execute(queries.SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in told.fetchall()), key=str)
