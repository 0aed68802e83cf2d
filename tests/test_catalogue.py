"""Every catalogue query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from granary.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(v, 8) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        assert ours
        return
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert cols == sorted(names)
    at = [names.index(c) for c in cols]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
