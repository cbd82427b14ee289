"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from docketry.plans.registry import ORACLE, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(map(str, r)) for r in got.select(names).collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(ORACLE) <= set(entry_points.queries()) and set(entry_points.oracle_sql()) <= set(entry_points.queries())
