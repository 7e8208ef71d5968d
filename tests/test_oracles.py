"""Every harness query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from cohortstats import queries as q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = q.queries()[name](spark, DIR)
    names = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in names]) for r in got.collect())
    result = db.execute(q.oracle_sql()[name])
    have = [c[0] for c in result.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_gives_rows(spark, name):
    assert q.queries()[name](spark, DIR).count() > 0
