"""Every registered plan against its SQL in DuckDB, and hypothesis identities."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from loomframe.queries import QUERIES, SQL

SF = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def test_every_plan_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_matches_sql(spark, db, name):
    want = db.sql(SQL[name])
    got = QUERIES[name](spark, str(SF))
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*want.columns).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
