"""Every query with SQL returns what DuckDB returns; the others return rows of a fixed schema."""

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from tesserae import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert Counter(rows) == Counter(want)
