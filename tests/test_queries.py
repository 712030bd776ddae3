"""Every registered query of the library runs on the smallest tables and equals its SQL."""

import os

import duckdb
import pytest

from waymark import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, DATA)
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda row: tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in row)
    assert sorted(map(repr, map(plain, map(tuple, got.select(*names).collect())))) == sorted(map(repr, map(plain, found.fetchall())))
