"""Line deduplication against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from glimmer.llm.linededup import MIN_WORDS, deduplicate_lines


def words(line):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def alike(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """rows: (doc_id, copy, text) -> text by (doc_id, copy)."""
    todo = sorted({r for r in rows if r[2] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, out = [], {}
    by_half: dict = {}
    for d, c, t in todo:
        kept = []
        for line in t.split("\n"):
            w = words(line)
            if not w:
                kept.append(line)
                continue
            keys = [("s", tuple(w[:3])), ("e", tuple(w[-3:])), ("s2", tuple(w[1:4])), ("all", tuple(w))]
            rivals = {i for k in keys for i in by_half.get(k, ())}
            if not any(alike(seen[i], w) for i in rivals):
                kept.append(line)
            seen.append(w)
            for k in keys:
                by_half.setdefault(k, []).append(len(seen) - 1)
        out[d, c] = "\n".join(kept)
    return out


def check(df):
    rows = [(r.doc_id, r.copy, r.text) for r in df.select("doc_id", F.xxhash64("text").alias("copy"), "text").collect()]
    want = brute(rows)
    got = sorted(((r.doc_id, r.old, r.text) for r in deduplicate_lines(df.withColumn("old", F.xxhash64("text"))).collect()), key=str)
    assert got == sorted(((d, c, None if t is None else want[d, c]) for d, c, t in rows), key=str)


def test_odd_rows(spark):
    long = "one two three four five six seven eight nine"
    rows = [(3, long), (1, None), (2, ""), (4, long.upper() + "\n\n  \n" + long + " ten"), (5, "short line\nshort line\nshort lines"), (None, "short line"), (None, "x\ny"), (6, "x"), (6, "x"), (7, "one two three four five six seven eighth nine ten\nk"), (8, "é ß ñ é ß ñ é ß ñ\r\né ß ñ é ß n é ß ñ"), (9, "q " * 30_000 + "\n" + "q " * 29_999)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'z' as line", "1 as hash", "2 as _other")
    check(df)
    assert deduplicate_lines(df).columns == df.columns
    assert deduplicate_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_edits(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(12)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 14))] for _ in range(12)]
    lines = []
    for _ in range(600):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        lines.append(" ".join(w))
    rows = [(i // 2, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_text_ids_and_any_names(spark):
    rows = [("b", "one two three\nown line b"), ("a", "one two three"), ("10", "One two three\nx"), (None, "y"), ("9", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("doc_id", "text", "1 as _hash", "2 as _id", "3 as _gone", "4 as _copy", "5 as `a.b`", "6 as _in_0")
    out = deduplicate_lines(df)
    assert out.columns == df.columns
    # ids that aren't whole numbers are ordered as text, null first
    assert {(r.doc_id, r.text) for r in out.collect()} == {(None, "y"), ("10", "One two three\nx"), ("9", ""), ("a", ""), ("b", "own line b")}
    assert all(tuple(r)[2:] == (1, 2, 3, 4, 5, 6) for r in out.collect())


def test_very_long_text():
    from glimmer.llm import linededup

    text = "\n".join(f"line {i} has some words {i * 7} of its own {i % 5}" for i in range(90_000)) + "\n" + "w " * 1_200_000 + "\nlast"
    parts = list(linededup._blocks(["a b", text, None, "c"]))
    assert len(parts) > 3
    whole = linededup.Lines([text])
    mine = [p for at, p in parts if at == 1]
    assert sum((p.number.tolist() for p in mine), []) == whole.number.tolist()
    assert sum((p.hashes().tolist() for p in mine), []) == whole.hashes().tolist()
    assert max(len(p.sums) for p in mine[:3]) < len(whole.sums) / 2
