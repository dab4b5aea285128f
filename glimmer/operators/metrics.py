"""Measures of pictures and of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psnr(mse: Column) -> Column:
    """Peak signal to noise of bytes in dB; infinite for equal pictures."""
    return F.when(mse <= 1e-12, F.lit(float("inf"))).otherwise(20 * F.log10(255 / F.sqrt(F.greatest(mse, F.lit(1e-300)))))


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    # what a lambda refers to is evaluated for every element: counts and their sum are bound once each
    bound = lambda value, f: F.transform(F.array(value), f)[0]
    of = lambda n, total: F.aggregate(n, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0))
    return bound(counts, lambda n: bound(F.aggregate(n, F.lit(0.0), lambda a, c: a + c), lambda total: of(n, total)))


def mesh_bytes(cells: Column, used: Column, colors: Column, counts: Column | None = None) -> Column:
    """Bytes of a mesh: which cells are used (binary entropy), a palette of 18 bits a colour, an index a vertex, 16 bits.

    With ``counts``, how often each colour is used, indices take what their entropy allows instead of whole bits.
    """
    p = used / cells
    occupied = F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p)) * cells).otherwise(0.0)
    each = F.ceil(F.log2(F.greatest(colors, F.lit(2)))) if counts is None else entropy(counts)
    # rounded, so that the order of a sum can't move a size across a whole byte
    return F.ceil(F.round((occupied + 18 * colors + used * each + 16) / 8, 9)).cast("int")


def ssim(pixels: DataFrame, key: str, a: str, b: str, reach: int = 3, peak: float = 255.0) -> DataFrame:
    """(key, ssim): mean structural similarity of two columns of pixel rows (key, y, x).

    Square windows of 2 reach + 1 pixels that lie wholly in the picture, equal weights,
    sample covariances.  Means of rows, then of columns, by two window frames; pictures
    smaller than a window are null.
    """
    side = 2 * reach + 1
    across = Window.partitionBy(key, "y").orderBy("x").rowsBetween(-reach, reach)
    down = Window.partitionBy(key, "x").orderBy("y").rowsBetween(-reach, reach)
    terms = {"a": F.col(a), "b": F.col(b), "aa": F.col(a) * F.col(a), "bb": F.col(b) * F.col(b), "ab": F.col(a) * F.col(b)}
    d = pixels.select(key, "y", "x", *(v.cast("double").alias(k) for k, v in terms.items()))
    d = d.select(key, "y", "x", F.count(F.lit(1)).over(across).alias("n"), *(F.avg(k).over(across).alias(k) for k in terms))
    d = d.select(key, F.col("n").alias("nx"), F.count(F.lit(1)).over(down).alias("ny"), *(F.avg(k).over(down).alias(k) for k in terms))
    whole = (F.col("nx") == side) & (F.col("ny") == side)
    unbiased = side * side / (side * side - 1)
    va, vb, vab = ((F.col(p + q) - F.col(p) * F.col(q)) * unbiased for p, q in ("aa", "bb", "ab"))
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    value = (2 * F.col("a") * F.col("b") + c1) * (2 * vab + c2) / ((F.col("a") * F.col("a") + F.col("b") * F.col("b") + c1) * (va + vb + c2))
    return d.groupBy(key).agg(F.avg(F.when(whole, value)).alias("ssim"))
