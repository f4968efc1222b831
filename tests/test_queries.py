"""Every registered query with SQL against DuckDB on the smallest tables, the others for their rows."""

import datetime
import decimal
import os

import duckdb
import pytest

from placeloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return round(x, 5)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr(tuple(plain(r[i]) for i in order)) for r in rows))


def check(spark, duck, queries, oracles, name):
    df = queries[name](spark, SF)
    found = rows_of(df.columns, df.collect())
    if name in oracles:
        wanted = duck.execute(oracles[name])
        assert sorted(df.columns) == sorted(c[0] for c in wanted.description)
        assert [x.replace("1.0,", "1,") for x in found] == [x.replace("1.0,", "1,") for x in rows_of([c[0] for c in wanted.description], wanted.fetchall())]


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    check(spark, duck, plans.QUERIES, plans.ORACLES, name)
