import os

import duckdb
import pytest

from riverstone.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: v if v is None or isinstance(v, (str, bool)) else v.isoformat() if hasattr(v, "isoformat") else repr(round(float(v), 9) + 0.0)
    return sorted(tuple(str(value(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    made = QUERIES[name](spark, sf)
    rows = made.collect()
    assert rows and len(set(made.columns)) == len(made.columns)
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(made.columns) == sorted(want.columns)
        assert plain(rows, made.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(os.path.dirname(entry.__file__))
