"""Every registered query with SQL gives the rows of DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from solvara import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def text(v):
    if v is None or v != v:
        return "-"
    return f"{v:.5g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, FOLDER)
    want = duck.sql(plans.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(c) for c in names]
    ours = sorted(tuple(text(v) for v in r) for r in got.select(*names).collect())
    theirs = sorted(tuple(text(r[k]) for k in order) for r in want.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
