"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from colloquy.plans.catalog import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canon(df):
    df = df[sorted(df.columns)]
    value = lambda x: None if x is None or x != x else round(x, 6) if isinstance(x, float) else int(x) if hasattr(x, "__index__") else x
    return sorted((tuple(value(x) for x in row) for row in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, small, duck, name):
    got = queries()[name](spark, small).toPandas()
    if name in oracle_sql():
        assert canon(got) == canon(duck.execute(oracle_sql()[name]).df())
    else:
        assert len(got)
