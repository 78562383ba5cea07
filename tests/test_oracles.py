"""Every registered query with an SQL form gives the rows that DuckDB gives."""

import duckdb
import pytest

from tributary.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda v: "" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return list(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, duck, name):
    got = rows(QUERIES[name](spark, data).toPandas())
    assert got[1] or name in ("join_window", "stream_join")
    if name in ORACLES:
        assert got == rows(duck.sql(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
