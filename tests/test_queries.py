import os

import pytest

import __spark_entry__ as entry
import verify

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql:
        cur = verify.views(DATA).execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert verify.bag(df.columns, rows) == verify.bag(names, cur.fetchall())


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
