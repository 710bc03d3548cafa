"""Every query with SQL gives the SQL's rows."""

import os

import duckdb
import pytest

from loamix import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(values, names):
    at = [names.index(n) for n in sorted(names)]
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(clean(row[i]) for i in at)) for row in values)


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    result = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(result.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
