"""What SQL isn't stated for: blended cells and the search of scales, against numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from glimmer.codec import of
from glimmer.functions.rows import computed
from glimmer.operators import dct, shapes


def test_blended_cells(spark):
    rng = np.random.default_rng(4)
    hash_ = "7f" + rng.integers(0, 256, 32, dtype=np.uint8).tobytes().hex()
    d = spark.createDataFrame([(hash_,)], "hash string")
    sharp = {(r.y, r.x): (r.r, r.g, r.b) for r in shapes.decode(d, of("pixel", 16), base=4).collect()}
    cells = np.array([[sharp[y, x] for x in range(4)] for y in range(4)], dtype=float)
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in shapes.decode(d, of("pixel", 16), base=11, smooth=True).collect()}
    for (y, x), rgb in got.items():
        fy, fx = (y + 0.5) * 4 / 11 - 0.5, (x + 0.5) * 4 / 11 - 0.5
        y0, x0 = min(max(int(np.floor(fy)), 0), 3), min(max(int(np.floor(fx)), 0), 3)
        y1, x1 = min(y0 + 1, 3), min(x0 + 1, 3)
        dy, dx = np.clip(fy - y0, 0, 1), np.clip(fx - x0, 0, 1)
        want = (1 - dy) * ((1 - dx) * cells[y0, x0] + dx * cells[y0, x1]) + dy * ((1 - dx) * cells[y1, x0] + dx * cells[y1, x1])
        assert np.abs(np.array(rgb) - np.floor(want + 1e-9)).max() == 0


def error(ac: np.ndarray, q: int, steps: int, p: float) -> float:
    scale = q / steps
    if q == 0:
        return float((ac**2).sum())
    levels = (np.arange(16) / 7.5 - 1) * scale**p
    n = np.abs((np.sign(ac) * np.abs(ac) ** p)[:, None] - levels).argmin(axis=1)
    kept = np.sign(levels[n]) * np.abs(levels[n]) ** (1 / p)
    return float(((ac - kept) ** 2).sum())


def test_best_scale(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=27) * rng.choice([0.001, 0.02, 0.1, 0.4])).tolist()) for i in range(40)] + [(40, [0.0] * 5), (41, [])]
    d = computed(spark.createDataFrame(rows, "id int, ac array<double>"), s=dct.best_scale(F.col("ac"), 31, 0.6))
    found = {r.id: r.s for r in d.collect()}
    assert found[40] == 0 and found[41] == 0
    for i, ac in rows[:40]:
        ac = np.array(ac)
        top = np.abs(ac).max()
        tried = {0} | {int(np.floor(31 * (0.55 + 0.45 * k / 18) * top + 0.5)) for k in range(19)} | {int(np.floor(31 * top + 0.5)) + k for k in (-1, 0, 1, 2)}
        best = min(error(ac, q, 31, 0.6) for q in tried if q >= 0)
        assert abs(error(ac, round(found[i] * 31), 31, 0.6) - best) < 1e-9


def test_rows_are_dealt_evenly(spark):
    """A read whose rows all lie in one of many partitions."""
    from glimmer.plans.fixtures import ROWS, spread

    few = spark.range(0, 80_000, 1, 8).where("id < 10000")
    many = spark.range(0, 1_000_000, 1, 8).where("id < 100000")
    for df, n in ((few, 10_000), (many, 100_000)):
        sizes = spread(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        cores = spark.sparkContext.defaultParallelism
        assert sum(sizes) == n and len(sizes) >= cores and max(sizes) <= min(ROWS, n // cores) * 1.1
