"""How drawn pictures are finished: palettes, dithering and blur, on batches of planes inside tasks.

The rules are those of ``render``, whose functions work on pixel rows; here a picture stays
in its row, and nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.color import BAYER
from . import fit, render

_BAYER = (np.array(BAYER, dtype=float) + 0.5) / 64


@dataclass(frozen=True)
class RenderStyle:
    """Options of drawing: none of them changes what a hash holds.

    ``samples`` each way a pixel of shapes is sampled, their light averaged; ``smooth`` blends the cells of pixel
    hashes.  ``palette`` (hex) maps what is drawn to its nearest colours; with ``dither`` by ordered
    thresholds as wide as the palette's mean spacing, in dots of ``pitch`` pixels (0: the long edge / 128, one at
    least).  ``blur`` is a Gaussian's deviation in pixels.  Without a palette ``dither`` rounds what
    frequencies and blur give.
    """

    samples: int = 1
    smooth: bool = False
    palette: str | None = None
    dither: bool = False
    pitch: int = 0
    blur: float = 0.0

    def __post_init__(self) -> None:
        if self.samples < 1 or self.pitch < 0 or not 0 <= self.blur < 1e4:
            raise ValueError("samples are one at least, pitch and blur not negative")
        if self.palette is not None and (not self.palette or len(self.palette) % 6):
            raise ValueError("a palette has six digits a colour")

    def effective_blur(self, older: float = 0.0) -> float:
        """The style's blur, or, if it has none, the one given beside it."""
        return self.blur if self.blur > 0 else max(older, 0.0)


def thresholds(w: int, h: int, pitch: int = 1) -> np.ndarray:
    """Ordered thresholds (h, w) in dots of ``pitch`` pixels."""
    return _BAYER[np.arange(h)[:, None] // pitch % 8, np.arange(w) // pitch % 8]


def spacing(palette: np.ndarray) -> float:
    """Mean distance of a palette's colours (k, 3) to their nearest others; 0 for one colour."""
    if len(palette) < 2:
        return 0.0
    d = np.sqrt(((palette[:, None] - palette[None]) ** 2).sum(axis=-1).astype(float))
    np.fill_diagonal(d, np.inf)
    return float(d.min(axis=1).mean())


def posterised(planes: np.ndarray, style: RenderStyle) -> np.ndarray:
    """Pictures (n, h, w, 3) in the style's palette."""
    palette = np.frombuffer(bytes.fromhex(style.palette), dtype=np.uint8).reshape(-1, 3).astype(np.int64)
    h, w = planes.shape[1:3]
    pitch = style.pitch or max(1, max(w, h) // 128)
    shift = (thresholds(w, h, pitch) - 0.5) * spacing(palette) if style.dither else np.zeros((h, w))
    out = np.empty_like(planes)
    for i, one in enumerate(planes):
        # squared distances are rounded so that equal ones stay equal; one palette colour after the other keeps this small
        best, index = np.full((h, w), np.inf), np.zeros((h, w), dtype=np.int64)
        for k, c in enumerate(palette):
            d = np.round(((one + shift[..., None] - c) ** 2).sum(axis=-1), 6)
            nearer = d < best
            best[nearer], index[nearer] = d[nearer], k
        out[i] = palette[index]
    return out


def _band(n: int, sigma: float) -> np.ndarray:
    """The matrix that blurs a line of ``n`` pixels, whose ends repeat."""
    weights = np.array(render.kernel(sigma))
    reach = len(weights) // 2
    out = np.zeros((n, n))
    rows = np.arange(n)
    for k, weight in enumerate(weights):
        np.add.at(out, (rows, np.clip(rows + k - reach, 0, n - 1)), weight)
    return out


def blurred(planes: np.ndarray, sigma: float, dither: bool = False) -> np.ndarray:
    """Pictures (n, h, w, 3) blurred along both axes by two matrix products a plane."""
    h, w = planes.shape[1:3]
    down, across = _band(h, sigma), _band(w, sigma)
    soft = down @ planes.transpose(0, 3, 1, 2).astype(float) @ across.T
    t = thresholds(w, h) if dither else 0.5
    # sums of a flat line may end an ulp below their byte
    return np.clip(np.floor(np.round(soft, 9) + t), 0, 255).astype(planes.dtype).transpose(0, 2, 3, 1)


def finished(planes: np.ndarray, style: RenderStyle) -> np.ndarray:
    """Bytes (n, h, w, 3) in the style's palette, then blurred; pictures that hold -1 (they have no colour) stay as they are."""
    if style.palette is None and style.blur <= 0:
        return planes
    out, good = planes.copy(), ~(planes < 0).any(axis=(1, 2, 3))
    some = planes[good]
    if style.palette is not None:
        some = posterised(some, style)
    if style.blur > 0:
        some = blurred(some, style.blur, style.dither)
    out[good] = some
    return out


def finish(df: DataFrame, style: RenderStyle) -> DataFrame:
    """``df`` whose pictures (w, h and flat byte arrays r, g, b) are finished in ``style``.

    Arrays that don't fit the size, or hold nulls, become null.
    """
    kept = [f for f in df.schema if f.name not in ("w", "h", "r", "g", "b")]
    added = [T.StructField(c, T.IntegerType()) for c in "wh"] + [T.StructField(c, T.ArrayType(T.ShortType())) for c in "rgb"]
    schema, size = T.StructType([*kept, *added]), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes, ws, hs = fit.sized(batch, size)
            out: list[list] = [[None] * len(batch) for _ in range(3)]
            for (w, h), rows in fit.by_size(planes, ws, hs).items():
                for at in range(0, len(rows), step := max(1, (1 << 20) // (w * h))):
                    some = rows[at : at + step]
                    target = np.stack([np.stack([planes[k][i] for k in range(3)], axis=-1) for i in some]).reshape(len(some), h, w, 3)
                    for i, one in zip(some, finished(target.astype(np.int64), style), strict=True):
                        for k in range(3):
                            out[k][i] = one[..., k].reshape(-1)
            arrays = [pa.array(p, type=pa.list_(pa.int16())) for p in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[: size + 2], *arrays], names=schema.names)

    of = [F.col(f"`{f.name}`").alias(f"_in_{i}") for i, f in enumerate(kept)]
    given = [F.col(c).cast("int").alias(f"_{c}") for c in "wh"] + [F.col(c).cast("array<int>").alias(f"_{c}") for c in "rgb"]
    return df.select(*of, *given).mapInArrow(run, schema).select(*df.columns)
