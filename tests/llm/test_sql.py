"""The registered SQL of the subpackage gives the rows of its queries."""

from __future__ import annotations

import duckdb
import pytest

from corpusloom.llm import queries
from tests.test_oracles import TABLES, plain


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, duck, name):
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    told = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    rows = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in told.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == rows
