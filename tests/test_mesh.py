"""Meshes: triangulation, colours, drawing and sizes."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import mesh, metrics
from glimmer.plans import meshes
from glimmer.sources import pictures

SCHEMA = "id int, w int, h int, r array<int>, g array<int>, b array<int>"


def rows(*images):
    return [(i, img.shape[1], img.shape[0], *(img[..., k].reshape(-1).tolist() for k in range(3))) for i, img in enumerate(images)]


def gradient(w, h):
    y, x = np.mgrid[:h, :w]
    return np.stack((x * 255 // max(w - 1, 1), y * 255 // max(h - 1, 1), np.full((h, w), 64)), axis=-1)


@pytest.mark.parametrize("seed", range(6))
def test_triangulation_is_delaunay(seed):
    rng = np.random.default_rng(seed)
    w, h = 40 + seed, 30
    t = mesh.Triangulation(np.array([(0, 0), (w, 0), (0, h), (w, h)]))
    for p in {(int(x), int(y)) for x, y in zip(rng.integers(0, w + 1, 60), rng.integers(0, h + 1, 60), strict=True)} - {(0, 0), (w, 0), (0, h), (w, h)}:
        t.add(np.array(p))
    area = 0
    for a, b, c in t.points[t.triangles].tolist():
        twice = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        assert twice > 0
        area += twice
        # no point lies strictly within the circle
        for p in t.points.tolist():
            m = [(u - p[0], v - p[1], (u - p[0]) ** 2 + (v - p[1]) ** 2) for u, v in (a, b, c)]
            assert round(np.linalg.det(np.array(m, dtype=float))) <= 0
    # the triangles cover the rectangle once
    assert area == 2 * w * h
    edges = Counter(tuple(sorted((t[i], t[j]))) for t in t.triangles.tolist() for i, j in ((0, 1), (1, 2), (2, 0)))
    assert set(edges.values()) <= {1, 2}


def test_median_cut():
    img = np.array([[0, 0, 0]] * 5 + [[10, 0, 0]] * 3 + [[200, 100, 0]] * 8 + [[200, 0, 50]])
    assert mesh.median_cut(img, 1).tolist() == [np.floor(img.mean(axis=0) + 0.5).tolist()]
    two = mesh.median_cut(img, 2)
    assert sorted(two.tolist()) == [[4, 0, 0], [200, 89, 6]]
    # no more colours than there are
    assert len(mesh.median_cut(img, 9)) == 4 and len(mesh.median_cut(img[:5], 4)) == 1
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, (40, 40, 3))
    errors = [((noise - p[mesh.nearest(noise, p)]) ** 2).mean() for p in (mesh.median_cut(noise, k) for k in (2, 8, 32))]
    assert errors[0] > errors[1] > errors[2]


@pytest.mark.parametrize("w,h,grid,budget", [(24, 24, 16, 14), (13, 20, 5, 40), (7, 9, 20, 50), (2, 2, 3, 9)])
def test_meshes_in_step_are_those_of_single_pictures(w, h, grid, budget):
    rng = np.random.default_rng(4)
    target = np.concatenate((rng.integers(0, 256, (6, h, w, 3)), np.full((1, h, w, 3), 9), rng.integers(0, 2, (4, h, w, 3)) * 200))
    palette = np.stack([np.concatenate((mesh.median_cut(t, 5), np.zeros((5, 3), dtype=np.int64)))[:5] for t in target])
    points, chosen, mse = mesh._fits(target, palette, grid, budget, 1)
    for t, colors, p, c, error in zip(target, palette, points, chosen, mse, strict=True):
        one, used = mesh._Mesh(w, h, grid), set(map(tuple, p[:4].tolist()))
        assert used == {(0, 0), (grid - 1, 0), (0, grid - 1), (grid - 1, grid - 1)} and len(p) == min(budget, grid * grid)
        index = mesh.nearest(t, colors)
        gy, gx = (a.reshape(-1) for a in np.mgrid[:grid, :grid])
        px, py = one.pixel(gx, gy)
        for x, y in p[4:].tolist():
            own = colors[index[one.pixel(*np.array(one.vertices).T)[::-1]]]
            score = ((one.blended(own.astype(float)) - t) ** 2).sum(axis=-1)[py, px]
            worst = int(np.where([v in used for v in zip(gx.tolist(), gy.tolist(), strict=True)], -1, score).argmax())
            assert (x, y) == (gx[worst], gy[worst])
            used.add((x, y))
            one.add(x, y)
        assert np.isclose(error, ((one.blended(colors[c].astype(float)) - t) ** 2).mean(), rtol=1e-9, atol=1e-9)


def test_meshes_of_pictures(spark):
    rng = np.random.default_rng(2)
    plain, ramp, noise = np.full((12, 20, 3), 77), gradient(24, 18), rng.integers(0, 256, (9, 9, 3))
    bad = [(9, 3, 3, [1] * 9, None, [1] * 9), (10, 3, 3, [1] * 8, [1] * 9, [1] * 9), (11, 1, 5, [1] * 5, [1] * 5, [1] * 5), (12, None, 3, [1], [1], [1])]
    df = spark.createDataFrame(rows(plain, ramp, noise) + bad, SCHEMA)
    got = {r.id: r for r in mesh.fitted(df, 8, 20, 6).collect()}
    assert all(got[i].mesh is None and got[i].mse is None and got[i].bytes is None for i in (9, 10, 11, 12))
    assert got[0].mse < 1e-20 and got[0].mesh.palette == [77 << 16 | 77 << 8 | 77]
    for i, img in enumerate((plain, ramp, noise)):
        m = got[i].mesh
        places = [(v.gx, v.gy) for v in m.vertices]
        assert len(set(places)) == 20 and places[:4] == [(0, 0), (7, 0), (0, 7), (7, 7)]
        assert all(0 <= v.color < len(m.palette) for v in m.vertices)
        used = Counter(v.color for v in m.vertices)
        index = -sum(n * math.log2(n / 20) for n in used.values())
        p = 20 / 64
        occupied = -64 * (p * math.log2(p) + (1 - p) * math.log2(1 - p))
        assert got[i].bytes == math.ceil(round((16 + occupied + 6 * 18 + index) / 8, 9))
        # the decoder draws what was fitted
        d = mesh.drawn(spark.createDataFrame([(m,)], mesh.T.StructType([mesh.T.StructField("mesh", mesh.MESH)])), img.shape[1], img.shape[0]).first()
        back = np.stack([d.r, d.g, d.b], axis=-1).reshape(img.shape)
        assert abs(((back - img) ** 2).mean() - got[i].mse) <= 0.5 + 0.02 * got[i].mse


def test_more_vertices_and_passes_fit_better(spark):
    df = pictures.synthetic(spark, "quadrants", 32, 24)
    px = df.toPandas().sort_values(["y", "x"])
    img = px[["r", "g", "b"]].to_numpy().reshape(24, 32, 3)
    df = spark.createDataFrame(rows(img), SCHEMA)
    few, many = (mesh.fitted(df, 16, n, 8).first().mse for n in (6, 60))
    assert many < few
    none, one, three = (mesh.fitted(df, 16, 20, 8, passes=p).first().mse for p in (0, 1, 3))
    assert three <= one <= none


def test_descent_is_the_best_single_colour(spark):
    """After a pass that changes nothing no vertex has a better colour, by drawing each."""
    rng = np.random.default_rng(3)
    img = rng.integers(0, 256, (10, 12, 3))
    r = mesh.fitted(spark.createDataFrame(rows(img), SCHEMA), 6, 9, 4, passes=20).first()
    m = r.mesh.asDict(recursive=True)
    one = mesh._Mesh(12, 10, 6)
    for v in m["vertices"][4:]:
        one.add(v["gx"], v["gy"])
    palette = np.array(m["palette"])[:, None] >> np.array((16, 8, 0)) & 255
    chosen = [v["color"] for v in m["vertices"]]

    def error(c):
        return ((one.blended(palette[c].astype(float)) - img) ** 2).mean()

    assert abs(error(chosen) - r.mse) < 1e-6
    for i in range(len(chosen)):
        assert min(error(chosen[:i] + [c] + chosen[i + 1 :]) for c in range(len(palette))) >= r.mse - 1e-6


def test_curve(spark):
    df = spark.createDataFrame(rows(gradient(40, 30)), SCHEMA)
    out = mesh.curve(df, mesh.RATE_POINTS[:3]).orderBy("vertices").collect()
    assert [(r.grid, r.vertices, r.colors) for r in out] == mesh.RATE_POINTS[:3]
    assert out[0].bytes < out[1].bytes < out[2].bytes and out[2].psnr > out[0].psnr
    for bad in ((1, 9, 4), (8, 3, 4), (8, 9, 0)):
        with pytest.raises(ValueError):
            mesh.fitted(df, *bad)


def test_curve_reads_and_searches_pictures_once(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([*rows(*rng.integers(0, 256, (5, 9, 11, 3)), np.full((9, 11, 3), 5)), (9, 3, 3, [1] * 9, None, [1] * 9)], SCHEMA)
    out = mesh.curve(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r.id, r.grid): (r.bytes, r.psnr) for r in out.collect()}
    assert len(got) == 7 * len(mesh.RATE_POINTS)
    for grid, vertices, colors in mesh.RATE_POINTS:
        for r in mesh.fitted(df, grid, vertices, colors).withColumn("psnr", metrics.psnr(F.col("mse"))).collect():
            assert got[r.id, grid] == (r.bytes, r.psnr)
    assert got[9, 16][0] is None and got[5, 16][1] == math.inf


def test_smaller_palettes_are_steps_to_larger_ones():
    rng = np.random.default_rng(8)
    images = np.concatenate((rng.integers(0, 256, (4, 60, 3)), rng.integers(0, 2, (4, 60, 3)) * 255, np.full((1, 60, 3), 3)))
    for size, palettes in zip((2, 5, 16), mesh._median_cuts(images, [2, 5, 16]), strict=True):
        assert [p.tolist() for p in palettes] == [mesh.median_cut(i, size).tolist() for i in images]
    assert [len(p) for p in palettes] == [16] * 4 + [8] * 4 + [1]


def test_growing_meshes_draw_only_where_points_are(monkeypatch):
    drawn, cover = [], mesh._Meshes.cover
    monkeypatch.setattr(mesh._Meshes, "cover", lambda self, *a: drawn.append(cover(self, *a)) or drawn[-1])
    target = np.random.default_rng(9).integers(0, 256, (2, 60, 60, 3))
    mesh._fits(target, np.stack([mesh.median_cut(t, 4) for t in target]), 6, 12, 1)
    # 36 pixels of each picture hold points; all are drawn once at the end
    assert len(drawn) == 9 and all(place.max() < 72 and len(place) < 150 for place, *_ in drawn[:-1])
    assert len(np.unique(drawn[-1][0])) == 2 * 60 * 60


@pytest.mark.parametrize("w,h,grid", [(24, 30, 40), (260, 90, 50)])
def test_circles_of_meshes_are_exact(w, h, grid):
    """In doubles or, where numbers are too large for them, in integers: triangles are those of single points put in."""
    rng = np.random.default_rng(10)
    meshes = mesh._Meshes(3, w, h, grid, 40)
    assert (meshes.circle.dtype == float) == (w < 100)
    singles = [mesh.Triangulation(meshes.points[:, i, :4].T.astype(np.int64)) for i in range(3)]
    corners = {0, grid - 1, grid * (grid - 1), grid * grid - 1}
    for places in np.stack([rng.permutation([p for p in range(grid * grid) if p not in corners])[:36] for _ in range(3)], axis=1):
        p = np.column_stack((places % grid, places // grid))
        meshes.add(p)
        for t, one in zip(singles, p, strict=True):
            t.add(one * meshes.scale)
    of, triangles = meshes.all()
    for i, t in enumerate(singles):
        assert set(map(tuple, triangles[:, of == i].T.tolist())) == set(map(tuple, t.triangles.tolist()))


def test_means_are_of_every_rate_point(spark, tmp_path):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(6)] + [(6, None)], "vec_id long, embedding array<float>")
    d.write.parquet(f"{tmp_path}/embeddings.parquet")
    each = meshes.mesh_curve(spark, str(tmp_path)).collect()
    means = meshes.mesh_means(spark, str(tmp_path)).orderBy("vertices").collect()
    assert [(r.grid, r.vertices, r.colors, r.n) for r in means] == [(*p, 6) for p in mesh.RATE_POINTS]
    for r in means:
        own = [e for e in each if e.grid == r.grid]
        assert math.isclose(r.bytes, sum(e.bytes for e in own) / 6, abs_tol=1e-6) and math.isclose(r.psnr, sum(e.psnr for e in own) / 6, abs_tol=2e-6)
