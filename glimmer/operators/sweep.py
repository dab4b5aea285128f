"""Pictures by methods: rate and distortion of every codec of a sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codec import Codec, of
from . import images, metrics

#: Numbers of shapes or cells that a sweep goes through.
COUNTS = (4, 8, 12, 24, 48)


def methods(shapes: tuple[str, ...] = ("pixel", "circle", "triangle", "rect"), counts: tuple[int, ...] = COUNTS) -> dict[str, Codec]:
    """Frequencies, and every shape with every number of shapes."""
    return {"dct": of("dct")} | {f"{s}-{n}": of(s, n) for s in shapes for n in counts}


def _squares(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, v: s + v)


def rate_distortion(df: DataFrame, keys: list[str], codecs: dict[str, Codec], base: int, seed: int = 0) -> DataFrame:
    """(keys, method, bytes, psnr, error) of pictures (keys, w, h, r, g, b) with a long edge of ``base``, encoded and drawn again.

    ``psnr`` is null where the drawn picture has another size than the picture, as the
    aspect ratio is rounded or the long edge isn't ``base``; ``error`` is why there is no
    picture.  Each method is a branch of its own, and nothing shuffles.
    """
    if not codecs:
        raise ValueError("a sweep needs a method")
    original = [F.col(c).alias(f"_{c}") for c in ("w", "h", "r", "g", "b")]
    same = (F.col("w") == F.col("_w")) & (F.col("h") == F.col("_h"))
    mse = sum((_squares(F.col(f"_{c}"), F.col(c)) for c in "rgb"), F.lit(0)) / (3 * F.col("_w") * F.col("_h"))
    out = None
    for name, codec in codecs.items():
        hashed = images.encode(df.select(*keys, "w", "h", "r", "g", "b"), codec, seed=seed)
        drawn = images.decode(hashed.select(*keys, "hash", F.col("error").alias("_why"), *original), codec, base=base)
        rows = drawn.select(*keys, F.lit(name).alias("method"), (F.length("hash") / 2).cast("int").alias("bytes"), F.when(same, metrics.psnr(mse)).alias("psnr"), F.coalesce("_why", "error").alias("error"))
        out = rows if out is None else out.unionByName(rows)
    return out
