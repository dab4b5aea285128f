"""Removal of repeated byte strings against brute force, and the sorted collection under it."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import bwt, suffixdup
from glimmer.llm.suffixdup import remove_repeats


def brute(rows, size):
    """(spans, kept) of each row, by a dictionary of all strings."""
    low: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for at in range(len(t) - size + 1 if i is not None else 0):
            low[t[at : at + size]] = min(i, low.get(t[at : at + size], i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for at in range(len(t) - size + 1 if i is not None else 0):
            if low[t[at : at + size]] < i:
                gone[at : at + size] = b"\1" * size
        spans = []
        for at, g in enumerate(gone):
            if g and (at == 0 or not gone[at - 1]):
                spans.append([at, at])
            if g:
                spans[-1][1] = at + 1
        out.append((spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def result(spark, rows, **options):
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "k int, doc_id long, text string").repartition(3)
    out = remove_repeats(df, **options)
    assert out.columns == ["k", "doc_id", "text", "spans", "kept"]
    got = sorted(out.collect())
    assert [(r.doc_id, r.text) for r in got] == rows
    return [([[s.start, s.end] for s in r.spans], bytes(r.kept)) for r in got]


def mixed(seed, n=120):
    rng = random.Random(seed)
    words = [rng.choice(["ab", "b", "zażółć", "aaaa", "日本", "x y", "\n", "qu"]) for _ in range(40)]
    shared = ["".join(rng.choices(words, k=25)) for _ in range(5)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([rng.choice(shared), "".join(rng.choices(words, k=9)), "ab" * rng.randrange(30)]) for _ in range(rng.randrange(4)))
        rows.append((rng.randrange(n), text))
    return [*rows, (None, shared[0] * 2), (3, None), (4, ""), (5, shared[1]), (5, shared[1]), (2**40, shared[1])]


@pytest.mark.parametrize("size,hot,block", [(50, 4096, 6 << 20), (50, 4096, 300), (12, 3, 500), (5, 2, 300), (3, 1, 1000)])
def test_against_brute_force(spark, monkeypatch, size, hot, block):
    monkeypatch.setattr(suffixdup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffixdup, "SHARD_BYTES", 10 * block)
    rows = mixed(size * hot)
    assert result(spark, rows, size=size, hot=hot) == brute(rows, size)


def test_one_passage_everywhere_and_periodic_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixdup, "BLOCK_BYTES", 2000)
    passage = "the very same words stand in every document, and are more than fifty bytes long. "
    rows = [(i, f"{i} begins. {passage * (1 + i % 3)}{i * 7919} ends" + "a" * (i % 5) * 40) for i in range(150)]
    assert result(spark, rows) == brute(rows, 50)


def test_long_texts_cross_chunks(monkeypatch):
    monkeypatch.setattr(suffixdup, "CHUNK", 1 << 12)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 40_000).astype(np.uint8)
    first = np.array([0, 30_000, 30_000, 30_020, 40_000])
    plan = suffixdup.Blocks(50, 4096, 3)
    start, windows, _, _ = plan.pieces(data, first, np.array([True, True, True, True]))
    at = np.concatenate([s + np.arange(n) for s, n in zip(start.tolist(), windows.tolist(), strict=True)])
    # every window of every text is in one piece
    assert sorted(at.tolist()) == [*range(30_000 - 49), *range(30_020, 40_000 - 49)]
    assert windows.max() <= plan.span


def test_equal_hashes_are_told_apart():
    data = np.frombuffer(b"abcabdabc", dtype=np.uint8)
    same = np.zeros(3, dtype=np.uint64)
    order, first = suffixdup._classes(data, np.array([0, 3, 6]), np.array([3, 3, 3]), same, same)
    assert first.sum() == 2 and sorted(order.tolist()) == [0, 1, 2]


def test_names_that_clash_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x" * 60, 5, "k")], "doc_id long, text string, spans int, kept string")
    out = remove_repeats(df)
    assert out.columns == ["doc_id", "text", "spans", "kept", "spans_", "kept_"]
    r = out.first()
    assert (r["spans"], r["kept"], r["spans_"], bytes(r["kept_"])) == (5, "k", [], b"x" * 60)
    assert remove_repeats(df.where(F.lit(False))).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(df, size=2)


def test_packed_texts_are_not_moved(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = remove_repeats(spark.createDataFrame([(1, "a" * 99)], "doc_id long, text string"))
        physical = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # only what was decided is dealt by block
    assert "Bucketed: true" in physical and physical.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("seed", range(30))
def test_collections_are_sorted(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 14, rng.integers(1, 9))
    lengths[0] = 13
    data = rng.integers(97, 98 + seed % 3, lengths.sum()).astype(np.uint8)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    docs = [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    want = sorted(d[len(d) - n :] for d in docs for n in range(len(d) + 1))
    found = bwt.build(data, lengths)
    got = [b""] * len(want)
    for n, which, rows in found.rows():
        for d, r in zip(which.tolist(), rows.tolist(), strict=True):
            got[r] = docs[d][len(docs[d]) - n :]
    assert got == want
    common = [0] + [next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) for x, y in zip(want, want[1:], strict=False)]
    assert found.common.tolist() == common
