"""Every registered core query against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from vframe.queries import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(values):
    def plain(v):
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr(tuple(map(plain, r))) for r in values)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, con, name):
    got = queries()[name](spark, SF)
    want = con.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(tuple(r[i] for i in place) for r in want.fetchall())
