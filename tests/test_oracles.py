"""Every registered query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from sluice.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def compare(spark, duck, small, run, sql):
    df = run(spark, small)
    rel = duck.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [list(rel.columns).index(n) for n in names]
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, small, name):
    compare(spark, duck, small, registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert Path(e.__file__).exists()
