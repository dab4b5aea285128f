"""Sums behind shape fitting, and integrals, as aggregates and windows over pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")


def shape_sums(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the sums of target, canvas, their squares and product by channel, and the count.

    ``pixels`` has t_r, t_g, t_b (target) and c_r, c_g, c_b (canvas) of the pixels that a
    shape covers.  Partial sums are combined map-side; only one row a key and task moves.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in CHANNELS:
        t, c = F.col(f"t_{k}"), F.col(f"c_{k}")
        aggs += [F.sum(t).alias(f"st_{k}"), F.sum(c).alias(f"sc_{k}"), F.sum(t * t).alias(f"stt_{k}"), F.sum(c * c).alias(f"scc_{k}"), F.sum(t * c).alias(f"stc_{k}")]
    return pixels.groupBy(*keys).agg(*aggs)


def best_color(alpha: Column) -> dict[str, Column]:
    """The colour that a shape of that opacity should have, within 0..1."""
    out = {}
    for k in CHANNELS:
        free = F.when((alpha > 0) & (F.col("n") > 0), (F.col(f"st_{k}") - (1 - alpha) * F.col(f"sc_{k}")) / F.when(alpha * F.col("n") > 0, alpha * F.col("n"))).otherwise(0.0)
        out[k] = F.least(F.greatest(free, F.lit(0.0)), F.lit(1.0))
    return out


def error_change(alpha: Column, colors: dict[str, Column]) -> Column:
    """How much the squared error changes if the shape is drawn in these colours."""
    rest = 1 - alpha
    total = F.lit(0.0)
    for k, p in colors.items():
        st, sc, scc, stc = (F.col(f"{x}_{k}") for x in ("st", "sc", "scc", "stc"))
        before = -2 * stc + scc
        after = -2 * rest * stc + rest * rest * scc - 2 * alpha * p * st + 2 * alpha * rest * p * sc + alpha * alpha * p * p * F.col("n")
        total = total + after - before
    return total


def finalised(sums: DataFrame, alpha: Column) -> DataFrame:
    """``sums`` with alpha, the best colour and the change of error."""
    d = sums.withColumn("alpha", alpha)
    colors = best_color(F.col("alpha"))
    d = d.withColumns({f"p_{k}": c for k, c in colors.items()})
    return d.withColumn("delta", F.when(F.col("n") == 0, 0.0).otherwise(error_change(F.col("alpha"), {k: F.col(f"p_{k}") for k in CHANNELS})))


def swept(sums: DataFrame, levels: list[float], keys: list[str], digits: int = 12) -> DataFrame:
    """For each key the opacity with the least error (to ``digits`` decimals), the first of equals, with its colour."""
    d = finalised(sums.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(levels)))).alias("level")), F.col("level.v"))
    row = F.struct(F.round("delta", digits).alias("delta"), F.col("level.i").alias("code"), "alpha", "p_r", "p_g", "p_b")
    return d.groupBy(*keys).agg(F.min(row).alias("best")).select(*keys, "best.*")


def squared_error(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the squared error ``sse`` between target and canvas."""
    err = sum(((F.col(f"t_{k}") - F.col(f"c_{k}")) * (F.col(f"t_{k}") - F.col(f"c_{k}")) for k in CHANNELS), F.lit(0.0))
    return pixels.groupBy(*keys).agg(F.sum(err).alias("sse"))


def row_integral(pixels: DataFrame, value: Column, key: str = "vec_id") -> DataFrame:
    """Running sums along each row of a picture."""
    w = Window.partitionBy(key, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("along", F.sum(value).over(w))


def area_integral(pixels: DataFrame, value: Column, key: str = "vec_id") -> DataFrame:
    """Sums of everything above and left of each pixel."""
    w = Window.partitionBy(key, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return row_integral(pixels, value, key).withColumn("area", F.sum("along").over(w))


def box_sums(pixels: DataFrame, boxes: DataFrame, value: Column, width: int | str, height: int | str, key: str = "vec_id", box: str = "box") -> DataFrame:
    """(key, box, total): sums of ``value`` inside boxes (key, box, x0, y0, x1, y1), from four corners each.

    Corners are inclusive and are cut at the picture's edges, whose ``width`` and ``height`` are
    numbers or columns of ``boxes``; a box without pixels has 0.  Whatever its size a box meets
    four rows of the integral, where it would meet all its pixels.
    """
    wide, tall = (F.col(v) if isinstance(v, str) else F.lit(v) for v in (width, height))
    left, right = F.greatest(F.col("x0"), F.lit(0)), F.least(F.col("x1") + 1, wide)
    top, bottom = F.greatest(F.col("y0"), F.lit(0)), F.least(F.col("y1") + 1, tall)
    filled = ((left < right) & (top < bottom)).cast("int")
    corners = [F.struct((x - 1).cast("int").alias("x"), (y - 1).cast("int").alias("y"), (filled * sign).alias("sign")) for x, y, sign in ((right, bottom, 1), (left, bottom, -1), (right, top, -1), (left, top, 1))]
    area = area_integral(pixels, value, key).select(key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "area")
    met = boxes.select(key, box, F.inline(F.array(*corners))).join(area, [key, "y", "x"], "left")
    return met.groupBy(key, box).agg(F.sum(F.col("sign") * F.coalesce("area", F.lit(0))).alias("total"))


def residual_cdf(pixels: DataFrame, width: int, key: str = "vec_id") -> DataFrame:
    """Running squared error in reading order; what new shapes' places are drawn from."""
    err = sum(((F.col(f"t_{k}") - F.col(f"c_{k}")) * (F.col(f"t_{k}") - F.col(f"c_{k}")) for k in CHANNELS), F.lit(0.0))
    w = Window.partitionBy(key).orderBy(F.col("y") * width + F.col("x")).rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("cdf", F.sum(err).over(w))
