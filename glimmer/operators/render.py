"""Effects on decoded pixels: palettes, dithering, blur, reveal order."""

from __future__ import annotations

from math import ceil, exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color


def posterised(pixels: DataFrame, palette: str, dither: bool = False, pitch: int = 1) -> DataFrame:
    """``pixels`` (…, y, x, r, g, b) with idx, the nearest palette colour, and its bytes in r, g, b.

    With ``dither`` pixels are first shifted by an ordered threshold times the palette's
    mean spacing; ``pitch`` is a dot's size in pixels.  The palette is a literal, so this
    neither joins nor shuffles.
    """
    n = len(palette) // 6
    rgb = [tuple(int(palette[6 * i + j : 6 * i + j + 2], 16) for j in (0, 2, 4)) for i in range(n)]
    gaps = [min((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5 for j, q in enumerate(rgb) if j != i), default=0.0) for i, p in enumerate(rgb)]
    spread = sum(gaps) / n if dither and n > 1 else 0.0
    at = lambda v: F.floor(F.col(v) / pitch).cast("int")
    shift = (color.dither_threshold(at("x"), at("y")) - 0.5) * spread
    # squared distances are rounded so that equal ones stay equal
    far = lambda c: F.round(sum(((F.col(k) + shift - v) * (F.col(k) + shift - v) for k, v in zip("rgb", c, strict=True)), F.lit(0.0)), 6)
    best = F.array_min(F.array(*(F.struct(far(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(rgb))))["i"]
    d = pixels.withColumn("idx", best)
    table = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("rgb", c, strict=True))) for c in rgb))
    return d.withColumns({k: F.element_at(table, F.col("idx") + 1)[k] for k in "rgb"})


def kernel(sigma: float) -> list[float]:
    """A normalised Gaussian of radius ceil(3 sigma), at least 1."""
    r = max(1, ceil(3 * sigma))
    k = [exp(-i * i / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [v / sum(k) for v in k]


def blurred(pixels: DataFrame, sigma: float, keys: list[str], dither: bool = False) -> DataFrame:
    """``pixels`` (keys, w, h, y, x, r, g, b, …) blurred along rows, then columns; opacity stays.

    Each pass collects one row or column of a picture in order and weighs it with the
    kernel; a picture's edge repeats.
    """
    if sigma <= 0:
        return pixels
    weights = kernel(sigma)
    radius = len(weights) // 2
    table = F.array(*map(F.lit, weights))
    out = pixels
    for axis, other, size in (("x", "y", "w"), ("y", "x", "h")):
        line = out.groupBy(*keys, other).agg(*(F.transform(F.array_sort(F.collect_list(F.struct(axis, F.col(c).alias("v")))), lambda s: s["v"]).alias(f"_{c}") for c in "rgb"))
        out = out.join(line, [*keys, other])

        def at(c: str, axis: str = axis, size: str = size) -> Column:
            place = lambda i: F.least(F.greatest(F.col(axis) + i - radius, F.lit(0)), F.col(size) - 1)
            return F.aggregate(F.transform(table, lambda k, i: k * F.element_at(f"_{c}", (place(i) + 1).cast("int"))), F.lit(0.0), lambda a, v: a + v)

        out = out.withColumns({c: at(c) for c in "rgb"}).drop("_r", "_g", "_b")
    t = color.dither_threshold(F.col("x"), F.col("y")) if dither else 0.5
    # sums of a flat line may end an ulp below their byte
    return out.withColumns({c: color.quantised(F.round(F.col(c), 9), t) for c in "rgb"})


def revealed(shapes: DataFrame, key: str, area: Column, span: float = 1.0, tiers: int = 4) -> DataFrame:
    """``shapes`` with their slot (largest first), delay within ``span`` and tier of ``tiers``."""
    order = Window.partitionBy(key).orderBy(area.desc(), "idx")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    d = shapes.withColumns({"slot": F.row_number().over(order) - 1, "_n": n})
    delay = F.when(F.col("_n") > 1, F.lit(span) * F.col("slot") / F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(0.0)
    return d.withColumns({"delay": delay, "tier": F.least(F.lit(tiers - 1), F.floor(F.col("slot") / F.col("_n") * tiers).cast("int"))}).drop("_n")


