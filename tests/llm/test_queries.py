"""Registered queries of these operators against their SQL, and what is registered."""

import duckdb
import pytest

from sluice.llm import queries
from tests.test_oracles import TABLES, compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    compare(spark, con, small, queries.QUERIES[name], queries.ORACLES[name])


def test_all_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
