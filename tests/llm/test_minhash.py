"""Near-duplicates against brute force."""

from __future__ import annotations

import random
import re

import pytest

from glimmer.llm.minhash import deduplicate, near_duplicates


def brute(rows, width: int, percent: int):
    """(doc_id, text) -> sorted (doc_id, n_shingles, component_id, kept)."""

    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    ids: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    out = [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]
    return sorted(((*x, x[0] == x[2]) for x in out), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def family(rng, vocabulary, n, changes):
    base = [rng.choice(vocabulary) for _ in range(n)]
    while True:
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(n)] = rng.choice(vocabulary)
        yield " ".join(w)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, None), (4, ""), (6, " \t\n"), (7, "one"), (8, "ONE"), (None, "one"), (None, "alone here"), (9, "a b c d e"), (9, "a b c d e"), (3, "A B c d e"), (10, long), (11, long + " x"), (12, "é\x0b\x0cß é"), (13, "É ß É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as key", "2 as bands")
    assert got(near_duplicates(df, width=2)) == brute(rows, 2, 80)
    kept = deduplicate(df, width=2)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["5", "4", "6", "7", "None", "3", "10", "12", "13"])
    assert near_duplicates(df.limit(0)).count() == 0
    assert deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_about_the_threshold(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)]
    rows = []
    for _ in range(25):
        f = family(rng, vocabulary, rng.randint(3, 60), rng.randint(0, 5))
        rows += [next(f) for _ in range(rng.choice([1, 2, 3, 12]))]
    big = family(rng, vocabulary, 80, 6)
    rows += [next(big) for _ in range(150)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(df, width=2)) == brute(rows, 2, 80)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(near_duplicates(df, width=2)) == brute(rows, 2, 80)


def test_any_names(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("1 as _copy", "doc_id", "2 as _id", "text", "3 as `group`", "4 as `rows`", "5 as `a.b`", "6 as _of")
    out = deduplicate(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 2, "a b c d e f", 3, 4, 5, 6), (1, 3, 2, "g h i", 3, 4, 5, 6)]


def test_a_shared_passage_makes_no_pairs(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from glimmer.llm import minhash

    def pairs_of(n):
        rng = np.random.default_rng(n)
        passage = rng.integers(0, 2**63, 870, dtype=np.uint64)
        sets = [np.sort(np.concatenate((passage, rng.integers(0, 2**63, 130, dtype=np.uint64)))) for _ in range(n)]
        rows = [(i.to_bytes(4, "big"), i.to_bytes(4, "big"), len(s), s.tobytes()) for i, s in enumerate(sets)]
        df = spark.createDataFrame(rows, "key binary, component binary, n long, shingles binary")
        return minhash._by_prefix(df, 80).count()

    # every two sets share 870 of 1130 shingles: 0.77, and none of the pairs may be looked at
    assert pairs_of(300) == 0 and pairs_of(3000) == 0

    text = " ".join(f"p{i}" for i in range(300))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), *(F.concat(F.lit(f" t{j}x"), F.col("id").cast("string")) for j in range(45))).alias("text"))
    assert near_duplicates(docs, width=1).where("not kept").count() == 0
