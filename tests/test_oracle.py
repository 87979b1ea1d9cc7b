"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
OWN = [n for n in entry.catalogue.ORACLE_SQL]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.5f}"
        return f"{v:.5f}" if isinstance(v, int) and not isinstance(v, bool) else v if v is None else str(v)

    return [columns[i] for i in order], sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, duck, name):
    df = entry.catalogue.QUERIES[name](spark, DATA)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.catalogue.ORACLE_SQL[name])
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    assert got == want
