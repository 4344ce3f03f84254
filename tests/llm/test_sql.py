"""Queries of the subpackage that have SQL give DuckDB's rows."""

import duckdb
import pytest

from colloquy.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, small, duck, name):
    got = queries()[name](spark, small)
    said = duck.execute(oracle_sql()[name])
    names = [c[0] for c in said.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(said.fetchall())
