"""Every query against its check SQL, at the smallest scale."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from scriptwell.plans.oracle import ORACLE
from scriptwell.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr))


def test_flagship(spark):
    assert entry.entry(spark).count() == 50


def test_every_check_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        columns = [d[0] for d in result.description]
        assert got == table(columns, result.fetchall())
    else:
        assert got[1]
