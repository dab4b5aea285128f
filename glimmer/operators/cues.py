"""Weights of pixels by what the eye looks at, and what weighted fits start from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUES = ("uniform", "edge", "center", "saliency")


def differences(pixels: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``pixels`` (keys, y, x) with gx and gy, differences of the two neighbours; 0 at the picture's edges."""
    d = pixels.withColumn("_v", value)
    across = Window.partitionBy(*keys, "y").orderBy("x")
    down = Window.partitionBy(*keys, "x").orderBy("y")
    between = lambda w: F.coalesce(F.lead("_v").over(w) - F.lag("_v").over(w), F.lit(0.0))
    return d.withColumns({"gx": between(across), "gy": between(down)}).drop("_v")


def weighted(pixels: DataFrame, keys: list[str], cue: str, strength: float) -> DataFrame:
    """``pixels`` (keys, y, x, r, g, b in linear light) with ``weight``: 1 + strength * cue, the cue at most 1.

    ``edge`` is the steepness of luminance, ``center`` falls off from the middle, and
    ``saliency`` is the distance from the picture's mean colour, times ``center``.  All
    windows are pictures, or rows or columns of one.
    """
    if cue not in CUES:
        raise ValueError(f"a cue is one of {CUES}")
    if cue == "uniform" or strength == 0:
        return pixels.withColumn("weight", F.lit(1.0))
    names, whole = pixels.columns, Window.partitionBy(*keys)
    if cue == "edge":
        d = differences(pixels, keys, 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b"))
        d = d.withColumn("_cue", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    else:
        off = lambda c: F.pow((F.col(c) - F.max(c).over(whole) / 2) / ((F.max(c).over(whole) + 1) / 2), F.lit(2.0))
        d = pixels.withColumn("_cue", F.exp(-1.5 * (off("y") + off("x"))))
        if cue == "saliency":
            apart = sum((F.pow(F.col(c) - F.avg(c).over(whole), F.lit(2.0)) for c in "rgb"), F.lit(0.0))
            d = d.withColumn("_apart", F.sqrt(apart))
            d = d.withColumn("_cue", F.col("_cue") * F.col("_apart") / (F.max("_apart").over(whole) + 1e-9))
    return d.select(*names, (1 + strength * F.col("_cue") / (F.max("_cue").over(whole) + 1e-9)).alias("weight"))


def planes(light: np.ndarray, cue: str, strength: float) -> np.ndarray:
    """The weights of :func:`weighted` for pictures (pictures, h, w, 3) in linear light, inside a task."""
    n, h, w = light.shape[:3]
    if cue == "uniform" or strength == 0:
        return np.ones((n, h, w))
    if cue == "edge":
        lum = light @ np.array([0.2126, 0.7152, 0.0722])
        across, down = np.zeros_like(lum), np.zeros_like(lum)
        across[:, :, 1:-1] = lum[:, :, 2:] - lum[:, :, :-2]
        down[:, 1:-1] = lum[:, 2:] - lum[:, :-2]
        out = np.hypot(across, down)
    else:
        y, x = ((np.arange(k) - (k - 1) / 2) / (k / 2) for k in (h, w))
        out = np.broadcast_to(np.exp(-1.5 * (y[:, None] ** 2 + x**2)), (n, h, w))
        if cue == "saliency":
            apart = np.linalg.norm(light - light.mean(axis=(1, 2), keepdims=True), axis=-1)
            out = out * apart / (apart.max(axis=(1, 2), keepdims=True) + 1e-9)
    return 1 + strength * out / (out.max(axis=(1, 2), keepdims=True) + 1e-9)


def background(weighted_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, g, b): the weighted mean colour that a fit starts from."""
    return weighted_.groupBy(*keys).agg(*((F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c) for c in "rgb"))


def worst_place(errors: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gy, gx, e): of each picture the place of the largest error that isn't used yet; of equals the first by gy, gx.

    ``errors`` is (keys, gy, gx, e) and ``used`` (keys, gy, gx).  A picture whose places are all
    used has no row.
    """
    free = errors.join(used.select(*keys, "gy", "gx"), [*keys, "gy", "gx"], "left_anti").where("e IS NOT NULL")
    best = F.max(F.struct("e", (-F.col("gy")).alias("y"), (-F.col("gx")).alias("x"))).alias("best")
    return free.groupBy(*keys).agg(best).select(*keys, (-F.col("best.y")).alias("gy"), (-F.col("best.x")).alias("gx"), "best.e")
