"""Registered queries against their brute-force SQL."""

from __future__ import annotations

import duckdb
import pytest

from glimmer.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op6_minhash", "op7_linededup", "op10_embeddup", "op11_periodic", "op12_suffixdup", "op13_divergence"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cursor = con.execute(LLM_ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    out = LLM_QUERIES[name](spark, SF)
    assert sorted(names) == sorted(out.columns)
    assert sorted(str(tuple(r)) for r in out.select(*names).collect()) == want
