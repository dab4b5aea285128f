"""Nearest neighbours and near-duplicate embeddings against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import ann, embeddup
from glimmer.llm.ann import search

SCHEMA = "vec_id long, embedding array<float>"


def usable(v):
    return bool(v) and None not in v and all(map(math.isfinite, v)) and any(v)


def brute_links(rows, threshold=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if usable(v)]
    up, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    units = {i: np.array(rows[i][1], dtype=float) / np.linalg.norm(np.array(rows[i][1], dtype=float)) for i in ok}
    for a, i in enumerate(ok):
        for j in ok[:a]:
            if len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                n[i] += 1
                n[j] += 1
                up[find(i)] = find(j)
    ids: dict = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, n[i], least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def linked(df):
    return sorted((tuple(r) for r in embeddup.near_duplicates(df).collect()), key=str)


def family(rng, n, dim=16):
    base = rng.normal(size=dim)
    return [(base + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.22, 0.4])).astype(np.float32).tolist() for _ in range(n)]


ODD = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [2.0, 4.0]), (None, [1.0, 2.0]), (9, [1.0, -2.0]), (10, [1.0, 2.0, 0.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]), (None, None)]


def test_links_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("embedding", "vec_id", "1 as key", "2 as size")
    assert linked(df) == brute_links(ODD)
    assert embeddup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2048, 32])
def test_links_of_families(spark, monkeypatch, block):
    monkeypatch.setattr(embeddup, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = sum((family(rng, n) for n in (1, 2, 3, 5, 8, 200, 40)), []) + [rng.normal(size=16).astype(np.float32).tolist() for _ in range(200)]
    vectors += [vectors[10]] * 60
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    assert linked(spark.createDataFrame(rows, SCHEMA)) == brute_links(rows)


def test_links_of_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert linked(df) == brute_links([(r.vec_id, r.embedding) for r in df.collect()])


def nearest(rows, k):
    rows = sorted({(d, tuple(v)) for d, v in rows if d is not None and usable(v)})
    out = {}
    for n in {len(v) for _, v in rows}:
        mine = [(d, v) for d, v in rows if len(v) == n]
        x = np.array([v for _, v in mine], dtype=float)
        for d, v in mine:
            if d % 20 == 0:
                scores = (np.array(v, dtype=float) * x).sum(axis=1)
                found = sorted(((-float(s), e) for s, (e, _) in zip(scores, mine, strict=True) if e != d))[:k]
                if found:
                    out[d] = found
    return out


def run(df, k=20):
    out: dict = {}
    for r in search(df, df.where(F.col("vec_id") % 20 == 0), k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({e for _, e in want[q]} & {e for _, e in got.get(q, [])}) for q in want)
    return hits / sum(len(v) for v in want.values())


def test_search_of_odd_rows(spark):
    rows = ODD + [(20, [1.0, 1.0]), (40, [1.0, 1.0]), (60, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("embedding", "vec_id", "1 as key", "2 as least")
    assert run(df) == nearest(rows, 20)
    assert run(df, 2) == nearest(rows, 2)
    assert search(df.limit(0), df.limit(0)).count() == 0


def test_search_by_split_lists_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHORT", 16)
    monkeypatch.setattr(ann, "LONG", 16)
    monkeypatch.setattr(ann, "SAMPLE", 600)
    rng = np.random.default_rng(6)
    vectors = sum((family(rng, n) for n in (40, 900)), []) + [rng.normal(size=16).astype(np.float32).tolist() for _ in range(1500)]
    vectors += [rng.normal(size=5).astype(np.float32).tolist() for _ in range(120)] + [rng.normal(size=24).astype(np.float32).tolist() for _ in range(500)]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = run(df), nearest(rows, 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    classes = ann.keyed(df, "vec_id", "embedding")
    index = ann.fit(classes.where("key is not null"), 20)
    assert set(index) == {5, 16, 24}
    mine = classes.where("dim = 16")
    sizes = ann._sizes(mine, index[16].groups, index[16].longest)
    # the number of lists has grown with the rows, and none is long
    assert sizes.sum() == mine.count() and sizes.max() <= ann.MOST * 16 and len(sizes) > 600 // ann.PER_CENTROID


def test_search_with_copies_and_lengths(spark):
    rng = np.random.default_rng(5)
    vectors = sum((family(rng, n) for n in (30, 50, 700)), []) + [(rng.normal(size=16) * rng.uniform(0.1, 3)).astype(np.float32).tolist() for _ in range(1500)]
    vectors += [vectors[3]] * 300
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    got, want = run(spark.createDataFrame(rows, SCHEMA)), nearest(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 and v == sorted(v) for v in got.values())
    assert recall(got, want) >= 0.9


@pytest.mark.parametrize("sf,lists", [("sf0.01", 8), ("sf0.1", 20)])
def test_search_of_embeddings(spark, sf, lists):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    index = ann.fit(ann.keyed(df, "vec_id", "embedding").where("key is not null"), 20)
    assert all(len(i.centroids) >= lists for i in index.values()) and index
    assert recall(run(df), nearest([(r.vec_id, r.embedding) for r in df.collect()], 20)) >= 0.95


def test_memory_for_centroids_is_shared(spark, monkeypatch):
    monkeypatch.setattr(ann, "CENTROID_BYTES", 8 * 17 * 30)
    rng = np.random.default_rng(8)
    vectors = [rng.normal(size=16).astype(np.float32).tolist() for _ in range(1500)] + [rng.normal(size=8).astype(np.float32).tolist() for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(vectors)), SCHEMA)
    index = ann.fit(ann.keyed(df, "vec_id", "embedding").where("key is not null"), 20)
    assert 2 <= len(index[16].centroids) + len(index[8].centroids) and sum(8 * i.centroids.size for i in index.values()) <= 2 * 8 * 17 * 30


def test_many_queries_of_one_list(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8)
    monkeypatch.setattr(ann, "TOGETHER", 1)
    rng = np.random.default_rng(7)
    vectors = family(rng, 300, 6) + [rng.normal(size=6).astype(np.float32).tolist() for _ in range(200)]
    df = spark.createDataFrame([(20 * i, v) for i, v in enumerate(vectors)], SCHEMA)
    got, want = run(df), nearest([(20 * i, v) for i, v in enumerate(vectors)], 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_queries_are_sent_once_to_a_cell(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHORT", 8)
    monkeypatch.setattr(ann, "LONG", 8)
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)], SCHEMA)
    classes = ann.keyed(df, "vec_id", "embedding").withColumn("least", F.col("vec_id"))
    found = ann.fit(classes, 20)
    index = found[16]
    assert index.width > 1
    placed = ann._placed(classes.where("vec_id % 20 = 0"), spark.sparkContext.broadcast(found), True).collect()
    # a row for each cell and not for each list, and all lists are there
    assert len({(r.key, r.cell) for r in placed}) == len(placed) < sum(len(r.lists) for r in placed) / 2
    for key in {r.key for r in placed}:
        mine = [r for r in placed if r.key == key]
        lists = index.search(index.asked(np.array([mine[0].vector]))[0])
        assert sorted(t for r in mine for t in r.lists) == sorted(lists)
        assert [r.cell for r in mine if r.nearest] == [lists[0] // index.width]


def test_products_are_exact():
    rng = np.random.default_rng(9)
    for dim in (64, 1500, 4096):
        a, b = (rng.choice([-127, 126, 127], size=(20, dim)).astype(np.float32) for _ in range(2))
        a[0], b[0] = 127, 127
        assert (embeddup.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


@pytest.mark.parametrize("block,most", [(2, 1e9), (16, 1e9), (16, 3.0)])
def test_links_by_many_pivots(spark, monkeypatch, block, most):
    monkeypatch.setattr(embeddup, "BLOCK", block)
    monkeypatch.setattr(embeddup, "COPIES", most)
    rng = np.random.default_rng(4)
    vectors = sum((family(rng, n) for n in (100, 30, 60, 5, 5)), []) + [rng.normal(size=16).astype(np.float32).tolist() for _ in range(800)]
    rows = list(enumerate(vectors))
    assert linked(spark.createDataFrame(rows, SCHEMA)) == brute_links(rows)


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_copies_are_bounded():
    rng = np.random.default_rng(12)
    reach = embeddup._reach(0.95)
    for spread, cells in ((0.02, 50), (9.0, 0)):  # clusters keep their cells; without clusters few stay
        centers = unit(rng.normal(size=(200, 32)))
        x = unit(centers[rng.integers(0, 200, 24_000)] + spread * rng.normal(size=(24_000, 32)))
        pivots = embeddup.pivots_of(x[:8000], 1_000_000, 0.95)
        assert len(pivots) >= cells
        if len(pivots):
            assert len(embeddup._margins(x[8000:], pivots, reach)[1]) <= 1.1 * embeddup.COPIES * 16_000
