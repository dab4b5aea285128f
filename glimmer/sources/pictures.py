"""Pictures from files to arrays of bytes, resized, and back to files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLANES = "origin string, w int, h int, r array<int>, g array<int>, b array<int>, a array<int>"


def read(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Pictures below ``path`` as Spark's image source decodes them, without resource forks."""
    d = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("dropInvalid", "true").load(path)
    return d.where(~F.col("image.origin").rlike(r"(^|/)\._[^/]*$|/__MACOSX/"))


def _weights(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Windowed-sinc weights (three lobes) that take ``n`` samples to ``m``, as 22-bit integers, and first samples."""
    scale = max(n / m, 1.0)
    reach = 3 * scale
    centers = (np.arange(m) + 0.5) * n / m
    low = np.maximum((centers - reach + 0.5).astype(int), 0)
    high = np.minimum((centers + reach + 0.5).astype(int), n)
    k = np.arange(int((high - low).max()))
    x = (low[:, None] + k - centers[:, None] + 0.5) / scale
    w = np.where((np.abs(x) < 3) & (k < (high - low)[:, None]), np.sinc(x) * np.sinc(x / 3), 0)
    w /= w.sum(axis=1, keepdims=True)
    return np.floor(w * (1 << 22) + 0.5).astype(np.int64), low


def resized(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bytes (rows, columns, channels) resampled along rows, then columns, rounding to bytes after each."""
    for axis, m in ((1, w), (0, h)):
        n = img.shape[axis]
        if n == m:
            continue
        weights, low = _weights(n, m)
        line = np.moveaxis(img, axis, 0).astype(np.int64)
        at = np.minimum(low[:, None] + np.arange(weights.shape[1]), n - 1)
        total = np.einsum("mk,mk...->m...", weights, line[at]) + (1 << 21)
        img = np.moveaxis(np.clip(total >> 22, 0, 255).astype(np.uint8), 0, axis)
    return img


def fitted(w: int, h: int, target: int) -> tuple[int, int]:
    """Size with the long edge at most ``target``; halves to even."""
    if max(w, h) <= target:
        return w, h
    return (target, max(1, round(h * target / w))) if w >= h else (max(1, round(w * target / h)), target)


def planes(images: DataFrame, target: int | None = None, keep_alpha: bool = False) -> DataFrame:
    """Rows of the image source as (origin, w, h, r, g, b, a), long edge at most ``target``.

    A picture without opacity, or whose opacity isn't kept, is 255 throughout.  One row is
    one picture; only it is in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, w, h, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                img = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n)
                img = np.repeat(img, 3, axis=2) if n == 1 else img[:, :, [2, 1, 0, 3][:n]]
                if img.shape[2] == 3 or not keep_alpha:
                    img = img[:, :, :3]
                if target:
                    img = resized(img, *fitted(w, h, target))
                flat = [pa.array([img[:, :, i].reshape(-1).astype(np.int32)] if i < img.shape[2] else [np.full(img.shape[0] * img.shape[1], 255, dtype=np.int32)], type=pa.list_(pa.int32())) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([origin]), pa.array([img.shape[1]], type=pa.int32()), pa.array([img.shape[0]], type=pa.int32()), *flat], names=["origin", "w", "h", "r", "g", "b", "a"])

    return images.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").mapInArrow(run, PLANES)


def pixel_rows(planes_: DataFrame, key: str = "origin") -> DataFrame:
    """A row for each pixel: key, y, x, r, g, b."""
    d = planes_.select(key, "w", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "p"))
    return d.select(key, F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), "p.r", "p.g", "p.b")


def png(w: int, h: int, rgb: bytes) -> bytes:
    """A PNG file of 8-bit RGB."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + rgb[i * w * 3 : (i + 1) * w * 3] for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def as_png(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, png) of decoded pixel rows (keys, w, h, y, x, r, g, b); opacity is dropped."""
    whole = pixels.groupBy(*keys, "w", "h").agg(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p"))
    flat = whole.select(*keys, "w", "h", F.flatten(F.transform("p", lambda p: F.array(p["r"], p["g"], p["b"]))).alias("rgb"))
    names = [*keys, "png"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys)
            files = [png(w, h, bytes(rgb)) for w, h, rgb in zip(*(batch.column(n + i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(files, type=pa.binary())], names=names)

    from pyspark.sql import types as T

    schema = T.StructType([*(flat.schema[k] for k in keys), T.StructField("png", T.BinaryType())])
    return flat.mapInArrow(run, schema)


def synthetic(spark: SparkSession, kind: str, w: int, h: int, rgb: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Pixel rows (y, x, r, g, b) of a test picture: solid, gradient, quadrants or checkerboard."""
    d = spark.range(w * h).select(F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    y, x = F.col("y"), F.col("x")
    pick = lambda table, i: [F.element_at(F.array(*(F.lit(c[k]) for c in table)), (i + 1).cast("int")) for k in range(3)]
    if kind == "solid":
        values = [F.lit(v) for v in rgb]
    elif kind == "gradient":
        values = [F.round(x * 255 / max(w - 1, 1)).cast("int"), F.round(y * 255 / max(h - 1, 1)).cast("int"), F.lit(64)]
    elif kind == "quadrants":
        values = pick([(220, 60, 60), (60, 200, 90), (70, 100, 230), (240, 200, 80)], F.floor(y * 2 / h) * 2 + F.floor(x * 2 / w))
    elif kind == "checkerboard":
        values = pick([(220, 60, 60), (40, 80, 200)], (F.floor(x / 8) + F.floor(y / 8)) % 2)
    else:
        raise ValueError(f"unknown picture {kind!r}")
    return d.select("y", "x", *(v.alias(k) for v, k in zip(values, "rgb", strict=True)))
