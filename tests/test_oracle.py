"""Each registered query against its DuckDB counterpart."""

import datetime
import os

import duckdb
import pytest

from umbra.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([[plain(r[i]) for i in order] for r in data])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if not sql:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    want = rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    assert got == want, [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3]
