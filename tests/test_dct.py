"""Frequency hashes: published vectors, round trips, broken input."""

from __future__ import annotations

import numpy as np

from glimmer.operators import dct


def frame(spark, pictures, alpha=None):
    rows = []
    for name, img in pictures.items():
        h, w, _ = img.shape
        rows.append((name, w, h, *(img[:, :, c].reshape(-1).tolist() for c in range(3)), alpha.reshape(-1).tolist() if alpha is not None else [255] * (w * h)))
    return spark.createDataFrame(rows, "name string, w int, h int, r array<int>, g array<int>, b array<int>, a array<int>")


def gradient(w, h):
    return np.stack(np.broadcast_arrays(np.arange(w) * 255 // (w - 1), np.arange(h)[:, None] * 255 // (h - 1), 64), axis=-1).astype(np.uint8)


def solid(w, h, rgb):
    return np.full((h, w, 3), rgb, dtype=np.uint8)


# Published hashes of these pictures.
VECTORS = {
    "red": (solid(100, 100, (255, 0, 0)), "e8af037f0088888888888888888888888888888888888808"),
    "blue": (solid(100, 60, (0, 0, 255)), "1c04009e008888888888888888888888888888"),
    "gradient": (gradient(100, 60), "6765139e37938787517778797776926e390964"),
    "random": ((np.random.default_rng(42).random((96, 64, 3)) * 255).astype(np.uint8), "e8b905661176798688966878866999669665779596"),
}


def test_vectors(spark):
    d = frame(spark, {k: v for k, (v, _) in VECTORS.items()})
    got = {r.name: r for r in dct.encode(d).withColumn("n", dct.byte_length(d.w, d.h, d.w < 0)).collect()}
    assert {k: r.hash for k, r in got.items()} == {k: v for k, (_, v) in VECTORS.items()}
    assert all(r.n * 2 == len(r.hash) for r in got.values())


def test_opacity_and_decoding(spark):
    img = gradient(12, 8)
    alpha = np.full((8, 12), 255)
    alpha[:, 6:] = 40
    clear = dct.encode(frame(spark, {"x": img}), a="a")
    half = dct.encode(frame(spark, {"x": img}, alpha), a="a")
    assert clear.collect()[0].hash == dct.encode(frame(spark, {"x": img})).collect()[0].hash
    rows = dct.decode(half.select("name", "hash"), base=12).collect()
    assert len(rows) == 12 * rows[0].h and rows[0].w == 12
    left, right = [np.mean([r.a for r in rows if (r.x < 6) == side]) for side in (True, False)]
    assert left > 220 and right < 90
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in dct.decode(clear.select("name", "hash"), base=12).collect()}
    assert np.abs(np.array([got[y, x] for y in range(8) for x in range(12)]) - img.reshape(-1, 3)).mean() < 30


def test_broken(spark):
    bad = spark.createDataFrame([("a", 2, 2, [1], [1], [1]), ("b", 0, 0, [], [], []), ("c", 1, 1, [7], [8], [9]), ("d", None, None, None, None, None)], "name string, w int, h int, r array<int>, g array<int>, b array<int>")
    got = {r.name: r.hash for r in dct.encode(bad).collect()}
    assert got["a"] is None and got["b"] is None and got["d"] is None and len(got["c"]) == 48
    cut = spark.createDataFrame([("",), ("e8af037f00",), ("e8",)], "hash string")
    assert dct.decode(cut, base=4).count() > 0
