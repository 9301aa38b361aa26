"""Every query with an SQL twin gives the same rows in both engines."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import quarrylens.plans  # noqa: F401
from quarrylens import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    own = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.sql(registry.ORACLE_SQL[name])
    expected = rows(found.columns, found.fetchall())
    assert sorted(df.columns) == sorted(found.columns)
    assert own == expected
