"""Every registered query that has SQL for DuckDB, against DuckDB: names, types as text, values."""

import datetime
import math
import os

import duckdb
import pytest

from stratalog.plans import catalogue

from .conftest import DATA

TABLES = [f.removesuffix(".parquet") for f in os.listdir(DATA)]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


EMPTY = {"between_reversed", "not_in_with_null", "anti_not_in_null", "empty_in"}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_as_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got_cols = sorted(df.columns)
    got = sorted(([norm(r[c]) for c in got_cols] for r in df.collect()), key=repr)
    rel = duck.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    rows = [dict(zip(cols, r, strict=True)) for r in rel.fetchall()]
    assert got_cols == sorted(cols)
    assert got == sorted(([norm(r[c]) for c in got_cols] for r in rows), key=repr)
    if name in EMPTY:
        assert not got
