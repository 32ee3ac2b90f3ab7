"""Every registered query of the engine against its SQL."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from sigspark.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    assert name in ORACLE
    cur = db.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted(tuple(str(plain(dict(zip(columns, r, strict=True))[c])) for c in order) for r in cur.fetchall())
    assert sorted(tuple(str(plain(r[c])) for c in order) for r in got.collect()) == want
