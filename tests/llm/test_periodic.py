"""Periodic runs against brute force over words."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import periodic
from glimmer.llm.derived import with_repeats
from glimmer.llm.periodic import digests, find_runs, runs_of


def brute(words, least=12):
    """Runs (start, length, period) by their definition."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, n=60):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "a " * 100, "a b " * 50 + "c", "x", "é " * 13 + "\x85 " * 14]
    for _ in range(n):
        words = []
        while len(words) < rng.randrange(200):
            part = rng.choices("abc", k=rng.randrange(1, 8))
            words += part * rng.choice([1, 1, 2, 3, 7])
        out.append(rng.choice(" \n") .join(words))
    return out


@pytest.mark.parametrize("seed,pairs", [(1, 1 << 19), (2, 50), (3, 1)])
def test_runs(monkeypatch, seed, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    groups = [(t or "").split() for t in texts(seed)]
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for g in groups for w in g], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum([len(g) for g in groups])))
    got = runs_of(ids, first)
    for i, g in enumerate(groups):
        assert sorted(tuple(r[1:]) for r in got[got[:, 0] == i].tolist()) == brute(g), g


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(periodic, "mix", lambda h: h * np.uint64(0))
    words = "a b c d e f a b c d e f a b c d e f g h".split()
    ids = np.unique(words, return_inverse=True)[1].astype(np.int64)
    assert [tuple(r[1:]) for r in runs_of(ids, np.array([0, len(ids)])).tolist()] == brute(words)


def test_texts_and_clashing_names(spark):
    rows = [(i, t, i * 2) for i, t in enumerate(texts(4))]
    rows += [rows[3], (None, "z " * 12, 0)]
    out = find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3))
    assert out.columns == ["doc_id", "text", "runs", "runs_", "collapsed"]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.runs, [tuple(s) for s in r.runs_], r.collapsed) for r in out.collect()), key=str)
    want = []
    for i, t, k in rows:
        words = [w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        want.append((i is None, i or 0, t, k, brute(words), collapse(words, brute(words))))
    assert got == sorted(want, key=str)
    assert find_runs(spark.createDataFrame([], "text string")).collect() == []


def test_long_texts(spark):
    text = "same " * 200_000 + "other " + "one two " * 100_000
    r = find_runs(spark.createDataFrame([(text,)], "text string")).first()
    assert [tuple(s) for s in r.runs] == [(0, 200_000, 1), (200_001, 200_000, 2)]
    assert r.collapsed == "same other one two"


def test_made_repeats_and_digests(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(300)] + [(None, "a b"), (10**12, None)]
    out = {r.doc_id: r for r in digests(find_runs(with_repeats(spark.createDataFrame(rows, "doc_id long, text string")))).collect()}
    assert len(out) == len(rows)
    repeated = 0
    for i, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
        runs = brute(words)
        repeated += bool(runs)
        r = out[i]
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        assert (r.start, r.length, r.period) == ((best[1], -best[0], best[2]) if best else (None, None, None))
        assert r.exponent_milli == (1000 * -best[0] // best[2] if best else None)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert repeated > 5


def test_repeats_need_only_two_columns(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, _w int")
    assert with_repeats(df.withColumn("n_runs", F.lit(1))).columns == ["doc_id", "text"]
