"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from plumbline import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v == int(v) else round(v, 4)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).collect() is not None
