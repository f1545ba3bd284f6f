"""Every query that has SQL, against DuckDB on the smallest tables."""


import duckdb
import pytest

import __spark_entry__ as entry
from claimspark.catalog import actions, core, history

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {**core.QUERIES, **history.QUERIES, **actions.QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    found = OWN[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert found.columns
        found.collect()
        return
    wanted = duck.sql(sql)
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    theirs = sorted(map(repr, wanted.select(*(f'"{c}"' for c in columns)).fetchall()))
    assert mine == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(OWN) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
