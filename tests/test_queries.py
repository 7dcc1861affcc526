"""Every query of the engine runs, and gives the rows of its SQL."""

import duckdb
import pytest

import __spark_entry__
from bindery.plans import queries as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "documents", "pages", "conversations", "lineitem", "customer", "supplier", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    found = __spark_entry__.queries()[name](spark, DATA)
    rows, order = found.collect(), sorted(found.columns)
    if name not in plans.ORACLES:
        assert rows
        return
    sql = db.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(sql.columns) == order
    assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str) == sorted((tuple(plain(r[sql.columns.index(c)]) for c in order) for r in sql.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
