import math

import duckdb
import pytest

import __spark_entry__ as E
from lorespark.plans import catalog as C

DIR = "/root/testdata/sf0.001"
TABLES = "customer orders events documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(C.ORACLE))
def test_rows_are_those_of_the_sql(spark, con, name):
    df = C.QUERIES[name](spark, DIR)
    cur = con.execute(C.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    tidy = lambda v: f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)
    got = sorted(tuple(map(tidy, r)) for r in df.collect())
    want = sorted(tuple(tidy(r[i]) for i in at) for r in cur.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w


def test_entry_and_names(spark):
    assert E.entry(spark).count() > 0 and set(E.oracle_sql()) <= set(E.queries())
