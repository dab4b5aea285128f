"""Every query with SQL against DuckDB, value for value."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from glimmer.plans import load_all
from glimmer.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    out = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(out.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=str)
    got = sorted((tuple(plain(v) for v in r) for r in out.select(*order).collect()), key=str)
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not wrong, (len(wrong), order, wrong[:3])
