"""Vectors as rows: validity, classes of equal vectors, k-means on a bounded sample, blocks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block; a block is what one task step holds.
BLOCK = 2048


def keyed(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, key, dim, vector) with vectors of doubles; ``key`` is null for those that take no part.

    Null, empty and zero vectors and those with null or non-finite components take no part.
    Equal vectors have equal keys.
    """
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, out = [], [], []
            for v in batch.column(1).to_pylist():
                ok = bool(v) and None not in v
                if ok:
                    x = np.asarray(v, dtype=np.float64) + 0.0  # no negative zeros
                    ok = bool(np.isfinite(x).all() and x.any())
                keys.append(blake2b(x.tobytes(), digest_size=16).digest() if ok else None)
                dims.append(len(v) if ok else None)
                out.append(x if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, type=pa.binary()), pa.array(dims, type=pa.int32()), pa.array(out, type=pa.list_(pa.float64()))], names=["vec_id", "key", "dim", "vector"])

    return rows.mapInArrow(run, "vec_id long, key binary, dim int, vector array<double>")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column of vectors of one length as a matrix."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of the rows of ``c`` to each of ``x``, in pieces that fit in memory."""
    square = (c * c).sum(axis=1)
    step = max(1, (1 << 22) // len(c))
    return np.concatenate([np.argmin(square[None] - 2 * x[at : at + step] @ c.T, axis=1) for at in range(0, len(x), step)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centroids of a sample that fits in memory; at most ``k``, none empty."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = nearest(x, c)
        order = np.argsort(home, kind="stable")
        n = np.bincount(home, minlength=len(c))
        starts = (np.cumsum(n) - n)[n > 0]
        c = np.add.reduceat(x[order], starts, axis=0) / n[n > 0][:, None]
        if len(c) < k:
            c = np.concatenate((c, x[rng.choice(len(x), k - len(c), replace=False)]))
    return np.unique(c, axis=0)


def sample(classes: DataFrame, n: int, numbers: int) -> np.ndarray:
    """At most ``n`` vectors of the most frequent length, and of ``numbers`` components; the same ones each time."""
    top = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if top is None:
        return np.zeros((0, 0))
    rows = classes.where(F.col("dim") == top["dim"]).select("key", "vector").orderBy(F.xxhash64("key"), "key").limit(max(1, min(n, numbers // top["dim"]))).select("vector").toArrow()
    return matrix(rows.column("vector").combine_chunks(), top["dim"])
