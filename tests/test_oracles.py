"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import collections
import math
import os

import duckdb
import pytest

from gleanspark.catalog import ORACLES, QUERIES

TABLES = "documents pages conversations benchmark labels".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows, names = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        return
    cur = duck.execute(ORACLES[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    want = collections.Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert collections.Counter(tuple(plain(r[c]) for c in names) for r in rows) == want
