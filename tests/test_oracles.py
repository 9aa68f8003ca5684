"""Every registered query against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from tidemark import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

plans.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(plans.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert found == want


def test_queries_without_sql_run(spark):
    for name in sorted(plans.QUERIES.keys() - plans.SQL.keys()):
        assert plans.QUERIES[name](spark, DATA).count() > 0
