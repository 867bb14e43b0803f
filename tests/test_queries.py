"""Every query with a DuckDB twin gives the same rows."""

import math
import os
from collections import Counter

import duckdb
import pytest

from foliomill.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        want = Counter(tuple(plain(dict(zip(columns, r))[c]) for c in names) for r in found.fetchall())
        assert list((got - want).items())[:2] == [] == list((want - got).items())[:2]
