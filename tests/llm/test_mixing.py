"""Mixing: the distribution, determinism, odd rows, and agreement with its SQL."""

from __future__ import annotations

import duckdb

from glimmer.llm.mixing import ORACLE, mix
from glimmer.llm.queries import op9_mixing


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(ORACLE).fetchall())
    got = sorted(tuple(r) for r in op9_mixing(spark, sf).select("doc_id", "copy", "source", "shuffle_key", "text").collect())
    assert got == want


def test_weights(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 100 = 1 then 'rare' when id % 7 = 2 then null else 'x' end as source", "'t' as text", "5 as w", "'y' as parts")
    out = mix(df, weights={"hot": 1, "rare": 2, None: 1}, total=40_000)
    assert out.columns == [*df.columns, "_copy", "_shuffle"]
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"hot", "rare", None}
    assert abs(n["hot"] - 10_000) < 500 and abs(n["rare"] - 20_000) < 700 and abs(n[None] - 10_000) < 500
    # variance of the copies of one source is its mean
    per = [r["count"] for r in out.where("source = 'rare'").groupBy("doc_id").count().collect()]
    mean = n["rare"] / 134
    assert 0.5 < sum((x - mean) ** 2 for x in per) / len(per) / mean < 1.6
    again = mix(df.repartition(7), weights={"hot": 1, "rare": 2, None: 1}, total=40_000)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_odd_rows(spark):
    rows = [(1, "a", None), (1, "a", None), (None, None, "x"), (None, None, "x"), (2, "", "b"), (3, "y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(df, total=60).collect()
    assert {(r.doc_id, r.text, r.source) for r in out} <= set(rows) and len(out) > 20
    assert mix(df.limit(0)).count() == 0
    assert mix(df, weights={"none": 1}).count() == 0
    assert mix(df, weights={}).count() == 0


def test_shuffled(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "'s' as source", "'t' as text")
    ids = [r.doc_id for r in mix(df).collect()]
    assert sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids) < 0.55


def test_any_names_ties_and_long_texts(spark):
    rows = [(1, "s", "x" * 3_000_000), (2, "s", "t"), (2, "s", "t"), (3, "u", "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "7 as _mix_n", "8 as _mix_source", "9 as _mix_who", "10 as `a.b`")
    once = mix(df, total=40)
    assert once.columns == [*df.columns, "_copy", "_shuffle"]
    twice = mix(once, total=80)
    assert twice.columns == [*once.columns, "_copy_", "_shuffle_"]
    kept = once.collect()
    assert {(r.doc_id, r.source, r.text) for r in kept} <= set(rows) and all(tuple(r)[3:7] == (7, 8, 9, 10) for r in kept)
    # rows that repeat an id get equally many copies
    assert sum(r.doc_id == 2 for r in kept) % 2 == 0 and twice.count() > 40
