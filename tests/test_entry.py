"""The driver contract, and every oracle of the library on the smallest tables."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from bibspark import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float | Decimal):
        return "nan" if math.isnan(v) else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    q = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()]
    assert Counter(map(str, (tuple(plain(r[c]) for c in cols) for r in df.collect()))) == Counter(map(str, want))
