"""Every query of the entry point against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from codeloom.queries import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canonical(value):
    return round(value, 9) if isinstance(value, float) else [canonical(v) for v in value] if isinstance(value, (list, tuple)) else str(value)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([canonical(v) for v in r]) for r in df.select(columns).collect())
    res = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = sorted(str([canonical(r[names.index(c)]) for c in columns]) for r in res.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
