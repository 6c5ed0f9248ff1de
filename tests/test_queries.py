"""Every registered query with a DuckDB twin gives the twin's rows on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from veldspar.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    expected = duck.sql(ORACLES[name])
    assert columns == sorted(expected.columns)
    assert ordered(df.select(*columns).collect()) == ordered(duck.sql("SELECT {} FROM ({})".format(", ".join(f'"{c}"' for c in columns), ORACLES[name])).fetchall())
