"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from cadenza.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float | decimal.Decimal):
        return "nan" if math.isnan(x) else round(float(x), 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    return tuple(sorted((k, plain(y)) for k, y in x.items())) if isinstance(x, dict) else x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in found.collect()]
    if name in SQL:
        want = duck.execute(SQL[name])
        assert table(found.columns, rows) == table([c[0] for c in want.description], want.fetchall())
    else:
        assert rows
    spark.catalog.clearCache()
