"""Every query with SQL gives the SQL's rows, over the smallest test tables."""

import math
import os

import duckdb
import pytest

from veilspark.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf}/{name}'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 9)
        return x if x is None or isinstance(x, (bool, int)) else str(x)

    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    frame = QUERIES[name](spark, sf)
    assert len(frame.collect()) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "answer_ord", "answer", "token"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
