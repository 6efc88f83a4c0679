"""Every query of the library with an SQL twin gives what DuckDB gives, on the smallest data."""

import os

import duckdb
import pytest

from quillon.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def normal(rows):
    return sorted(tuple("null" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = df.select(*columns).collect()
    assert normal(got) == normal(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
