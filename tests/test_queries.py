"""Every named query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, normal

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, db, name):
    got = QUERIES[name](spark, data).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = db.sql(SQL[name]).df()
    got, want = normal(got), normal(want)
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in want.columns:
        assert (want[c].map(repr) == got[c].map(repr)).all(), c


def test_entry(spark):
    top = entry(spark).limit(5).collect()
    assert len(top) == 5
    assert all(r["verdict"] in ("Auto-Approve", "Auto-Reject", "Escalate") for r in top)
