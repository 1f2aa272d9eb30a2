"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tieweave import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float | decimal.Decimal):
        return "nan" if math.isnan(x) else float(f"{float(x):.8g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    found = duck.execute(SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    assert len(found.description) == len(columns)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", ["R10_clusters", "D6_gold_set", "G11_betweenness"])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
