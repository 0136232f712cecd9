"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidewheel.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)

    def plain(rows):
        return sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows], key=repr)

    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_registry_is_consistent():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
