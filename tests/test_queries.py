"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tools_check import TABLES, table  # noqa: E402


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return c


def test_entry(spark):
    assert entry(spark).columns == ["tag", "job_count"]


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    got = table(df.collect(), df.columns)
    if name in oracle_sql():
        cur = con.execute(oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == table(cur.fetchall(), names)
