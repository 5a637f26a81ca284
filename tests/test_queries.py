from __future__ import annotations

import os

import duckdb
import pytest

from equimap.plans import catalog

DATA = "/root/testdata/sf0.001"
CHECKED = sorted(catalog.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(float(v), 4) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(CHECKED)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
