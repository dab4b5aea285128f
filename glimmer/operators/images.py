"""Pictures as rows: encoded to hashes and decoded from them in Arrow batches, whatever the codec, without a shuffle.

A picture is a row with its width, height and flat arrays of its bytes.  A codec is one for
all rows, or a struct column beside each row; then the distinct codecs, of which at most
CODECS are allowed, are found first and each gets its own branch of the plan.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import reduce
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codec import SCHEMA, Codec, bytes_total, long_enough
from ..functions import quant
from . import dct, effects, fit, shapes
from .effects import RenderStyle
from .kernel import LINEAR, Colors, Forms, _companded, aspect_code, fields, packed, srgb_u8

#: Distinct codecs of a column.
CODECS = 256
#: Pixels that are encoded or drawn at once; what a task holds is some dozens of numbers for each, whatever its rows.
STEP = 1 << 18
PLANES = ["w", "h", "r", "g", "b"]
#: Shapes with corners to round.
ROUNDED = ("rect", "square", "rotrect")


def over_white(c: Column, a: Column) -> Column:
    """A byte seen through its opacity byte on white, truncated."""
    share = a / F.lit(255.0)
    return F.floor(share * c + (1 - share) * 255).cast("int")


def _grid(n: int, aspect: float) -> tuple[int, int]:
    pairs = [(g, n // g) for g in range(1, n + 1) if n % g == 0]
    goal = np.log(max(aspect, 1e-9))
    return min(pairs, key=lambda p: (abs(np.log(p[0] / p[1]) - goal), p[0]))


def _edges(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where cells begin and end; each has a pixel at least, as far as there are any."""
    at = np.floor(np.arange(n + 1) * size / n + 0.5).astype(np.int64)
    return at[:-1], np.minimum(np.maximum(at[1:], at[:-1] + 1), size)


def _cells(target: np.ndarray, codec: Codec) -> list[str]:
    """Pixel hashes of pictures of one size, from the mean light of a grid's cells."""
    n, h, w = target.shape[:3]
    gw, gh = _grid(codec.n_shapes, codec.grid_aspect if codec.grid_aspect is not None else 2.0 ** (aspect_code(w, h) / 254 * 6 - 3))
    total = np.zeros((n, h + 1, w + 1, 3))
    np.cumsum(np.cumsum(target, axis=1), axis=2, out=total[:, 1:, 1:])
    (x0, x1), (y0, y1) = _edges(gw, w), _edges(gh, h)
    area = np.maximum((y1 - y0)[:, None] * (x1 - x0), 0)
    sums = total[:, y1][:, :, x1] - total[:, y0][:, :, x1] - total[:, y1][:, :, x0] + total[:, y0][:, :, x0]
    # means are rounded so that the order of a sum can't move a colour across a code's edge
    mean = np.where(area[..., None] > 0, np.round(sums / np.maximum(area, 1)[..., None], 9), 0.0)
    return packed([(np.full(n, aspect_code(w, h)), 8), (Colors(codec).code(mean), codec.color_field)], n)


def cells(df: DataFrame, codec: Codec, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """``df`` (with w, h and the arrays) and ``hash``, its pixel hash; null where the arrays don't fit the size."""
    kept = [f for f in df.schema if f.name != "hash"]
    schema = T.StructType([*kept, T.StructField("hash", T.StringType())])
    size = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes, ws, hs = fit.sized(batch, size)
            out: list[str | None] = [None] * len(batch)
            for (w, h), rows in fit.by_size(planes, ws, hs).items():
                for at in range(0, len(rows), step := max(1, STEP // (w * h))):
                    some = rows[at : at + step]
                    target = np.stack([np.stack([planes[k][i] for k in range(3)], axis=-1) for i in some]).reshape(len(some), h, w, 3)
                    for i, text in zip(some, _cells(LINEAR[target], codec), strict=True):
                        out[i] = text
            yield pa.RecordBatch.from_arrays([*batch.columns[:size], pa.array(out, type=pa.string())], names=schema.names)

    of = [F.col(f"`{f.name}`").alias(f"_in_{i}") for i, f in enumerate(kept)]
    given = [F.col(c).cast("int").alias(f"_{c}") for c in "wh"] + [F.col(f"`{c}`").cast("array<int>").alias(f"_{k}") for c, k in zip((r, g, b), "rgb", strict=True)]
    return df.select(*of, *given).mapInArrow(run, schema)


def by_codec(df: DataFrame, codec: Codec | str, work: Callable[[DataFrame, Codec], DataFrame]) -> DataFrame:
    """``work`` on the rows of each codec; a column of codecs must hold at most CODECS distinct ones.

    Rows whose codec is null, or isn't one, come back from ``work`` of no codec: with null results.
    """
    if isinstance(codec, Codec):
        return work(df, codec)
    found = df.select(codec).distinct().limit(CODECS + 1).collect()
    if len(found) > CODECS:
        raise ValueError(f"more than {CODECS} codecs; group the rows by codec first")
    parts, left = [], F.lit(True)
    for row in found:
        value = row[0]
        try:
            one = Codec(**{**value.asDict(), "alpha_levels": tuple(value.alpha_levels) if value.alpha_levels is not None else None})
        except (ValueError, TypeError, AttributeError):
            continue
        same = reduce(lambda a, b: a & b, (F.col(codec)[f.name].eqNullSafe(F.lit(value[f.name]) if f.name != "alpha_levels" or value[f.name] is None else F.array(*map(F.lit, value[f.name]))) for f in SCHEMA))
        here = F.col(codec).isNotNull() & same
        parts.append(work(df.where(here), one))
        left = left & ~here
    parts.append(work(df.where(left), None))
    return reduce(DataFrame.unionByName, parts)


def encode(df: DataFrame, codec: Codec | str, seed: int = 0, options: fit.SearchOptions | None = None, a: str | None = None) -> DataFrame:
    """``df`` (w, h, r, g, b) with ``hash`` and ``error``, by one codec or a column of them.

    ``a`` names an array of opacity bytes: frequency hashes keep it, all others see the picture on white.
    ``error`` says why a hash is null: no codec, or arrays that don't fit the size.  Columns
    of ``df`` by these two names give way to them.
    """
    names = [c for c in df.columns if c not in ("hash", "error")]
    flat = df.select(*(f"`{c}`" for c in names))

    def work(rows: DataFrame, one: Codec | None) -> DataFrame:
        if one is None:
            return rows.select(*(f"`{c}`" for c in names), F.lit(None).cast("string").alias("hash"), F.lit("the codec is null or not valid").alias("error"))
        if one.shape == "dct":
            out = dct.encode(rows, a=a)
        else:
            seen, planes = rows, ("r", "g", "b")
            if a:
                planes = ("_white_r", "_white_g", "_white_b")
                seen = rows.withColumns({new: F.when(F.size(a) == F.size(c), F.zip_with(c, a, over_white)) for new, c in zip(planes, "rgb", strict=True)})
            out = cells(seen, one, *planes) if one.shape == "pixel" else fit.fitted(seen, one, seed, options, "w", "h", *planes)
        error = F.when(F.col("hash").isNull(), F.lit("the arrays do not fit the size"))
        return out.select(*(f"`{c}`" for c in names), "hash", error.alias("error"))

    return by_codec(flat, codec, work)


def target_edge(codec: Column) -> Column:
    """The long edge to which pictures are brought before they are encoded: 100 for frequency hashes, else 48."""
    return F.when(codec["shape"] == "dct", 100).otherwise(48)


class _Drawn:
    """Hashes of one codec drawn at one size; ``bits`` is (pictures, bits)."""

    def __init__(self, codec: Codec, w: int, h: int, style: RenderStyle = RenderStyle()):
        self.codec, self.w, self.h, self.colors, self.style = codec, w, h, Colors(codec), style

    def _read(self, bits: np.ndarray, at: int, n: int) -> np.ndarray:
        return (bits[:, at : at + n].astype(np.int64) << np.arange(n)).sum(axis=1)

    def run(self, bits: np.ndarray, quantised: float) -> np.ndarray:
        """Bytes (pictures, h, w, 3); -1 where a colour is beyond the palette."""
        return effects.finished(self.pixel(bits, quantised) if self.codec.shape == "pixel" else self.painted(bits), self.style)

    def pixel(self, bits: np.ndarray, quantised: float) -> np.ndarray:
        c = self.codec
        gw, gh = _grid(c.n_shapes, c.grid_aspect if c.grid_aspect is not None else quantised)
        code = np.stack([self._read(bits, 8 + i * c.color_field, c.color_field) for i in range(c.n_shapes)], axis=1)
        rgb = self._checked(code)
        if self.style.smooth:
            return self._blended(rgb.reshape(len(bits), gh, gw, 3))
        # a pixel belongs to the last cell that begins at or before it
        column = np.searchsorted(np.floor(np.arange(gw) * self.w / gw + 0.5), np.arange(self.w), side="right") - 1
        row = np.searchsorted(np.floor(np.arange(gh) * self.h / gh + 0.5), np.arange(self.h), side="right") - 1
        return rgb.reshape(len(bits), gh, gw, 3)[:, row][:, :, column]

    def _blended(self, cells: np.ndarray) -> np.ndarray:
        """Cells (pictures, rows, columns, 3) blended between their centres, truncated to bytes."""

        def places(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = (np.arange(size) + 0.5) * n / size - 0.5
            low = np.clip(np.floor(at), 0, n - 1).astype(np.int64)
            return low, np.minimum(low + 1, n - 1), np.clip(at - low, 0, 1)

        (y0, y1, dy), (x0, x1, dx) = places(cells.shape[1], self.h), places(cells.shape[2], self.w)
        dy, dx = dy[:, None, None], dx[:, None]
        top = (1 - dx) * cells[:, y0][:, :, x0] + dx * cells[:, y0][:, :, x1]
        low = (1 - dx) * cells[:, y1][:, :, x0] + dx * cells[:, y1][:, :, x1]
        out = np.floor((1 - dy) * top + dy * low + 1e-9).astype(np.int64)
        out[(cells < 0).any(axis=(1, 2, 3))] = -1
        return out

    def _checked(self, code: np.ndarray) -> np.ndarray:
        rgb = self.colors.u8(code)
        return np.where((code < self.codec.colors)[..., None], rgb, -1) if self.codec.palette is not None else rgb

    def painted(self, bits: np.ndarray) -> np.ndarray:
        c, n, fine = self.codec, len(bits), self.style.samples
        forms, one = Forms(c, self.w * fine, self.h * fine), np.float32(1)
        ground = self._checked(self._read(bits, 8, c.color_field))
        bad = (ground < 0).any(axis=-1)
        light = LINEAR.astype(np.float32)
        canvas = np.broadcast_to(light[np.maximum(ground, 0)][:, None, None], (n, self.h * fine, self.w * fine, 3)).copy()
        at, levels = 8 + c.color_field, np.array(c.levels, dtype=np.float32)
        for _ in range(c.n_shapes):
            codes = []
            for _, b in fields(c):
                codes.append(self._read(bits, at, b))
                at += b
            rgb = self._checked(self._read(bits, at, c.color_field))
            bad |= (rgb < 0).any(axis=-1)
            at += c.color_field
            a = levels[np.minimum(self._read(bits, at, c.alpha_bits), len(levels) - 1)]
            at += c.alpha_bits
            low, high = forms.spans(np.stack(codes, axis=-1))
            color = light[np.maximum(rgb, 0)]
            for i in range(n):
                rows = np.flatnonzero(high[i] > low[i])
                if len(rows):
                    box = slice(rows[0], rows[-1] + 1), slice(low[i][rows].min(), high[i][rows].max())
                    part = canvas[i][box]
                    x = np.arange(box[1].start, box[1].stop)
                    hit = (x >= low[i][box[0], None]) & (x < high[i][box[0], None])
                    canvas[i][box] = np.where(hit[..., None], (one - a[i]) * part + a[i] * color[i], part)
        canvas = canvas.astype(np.float64)
        if fine > 1:
            canvas = canvas.reshape(n, self.h, fine, self.w, fine, 3).mean(axis=(2, 4))
        out = srgb_u8(canvas)
        out[bad] = -1
        return out


def _bits(hashes: list[str], n: int) -> np.ndarray:
    """Bits of hashes, lowest first; those past the end are zero."""
    raw = b"".join(bytes.fromhex(t[: 2 * n]).ljust(n, b"\0") for t in hashes)
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(len(hashes), n), axis=1, bitorder="little")


def _size(aspect: float, base: int, strict: bool = False) -> tuple[int, int]:
    wide = aspect > 1 if strict else aspect >= 1
    return (base, max(int(np.floor(base / aspect + 0.5)), 1)) if wide else (max(int(np.floor(aspect * base + 0.5)), 1), base)


def decode(df: DataFrame, codec: Codec | str, hash_: str = "hash", base: int = 256, aspect: float | None = None, style: RenderStyle = RenderStyle()) -> DataFrame:
    """``df`` with w, h, r, g, b (flat byte arrays) of its hashes drawn in ``style``, and ``error``.

    ``error`` says why a picture is null: no codec, a hash that is no hex or too short for
    its codec, or a colour beyond the palette.  Columns by these names give way.
    """
    names = [c for c in df.columns if c not in (*PLANES, "error")]
    fields_ = [df.schema[c] for c in names]
    added = [T.StructField(c, T.IntegerType()) for c in "wh"] + [T.StructField(c, T.ArrayType(T.ShortType())) for c in "rgb"] + [T.StructField("error", T.StringType())]
    schema = T.StructType([*fields_, *added])
    flat = df.select(*(f"`{c}`" for c in names))

    def work(rows: DataFrame, one: Codec | None) -> DataFrame:
        same = [F.col(f"`{c}`") for c in names]
        if one is None:
            return rows.select(*same, *(F.lit(None).cast(f.dataType).alias(f.name) for f in added[:-1]), F.lit("the codec is null or not valid").alias("error"))
        plain = F.lower(F.col(f"`{hash_}`"))
        good = plain.rlike("^([0-9a-f]{2})+$") & long_enough(plain, one.column())
        if one.shape == "dct":
            return _frequencies(rows.select(*same, F.when(good, plain).alias("_hash")), names, schema, base, style)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, total = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
                sizes: dict[int, list[int]] = {}
                for i, t in enumerate(texts):
                    if t is not None:
                        sizes.setdefault(int(t[:2], 16), []).append(i)
                for part, drawn in _batches(texts, sizes, one, base, aspect, total, style):
                    yield _emitted(batch, part, drawn, names, schema)
                bad = [i for i, t in enumerate(texts) if t is None]
                if bad:
                    yield _emitted(batch, bad, None, names, schema)

        of = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(names)]
        return rows.select(*of, F.when(good, plain).alias("_hash"), bytes_total(one.column()).alias("_bytes")).mapInArrow(run, schema)

    return by_codec(flat, codec, work)


def _batches(texts: list, sizes: dict[int, list[int]], codec: Codec, base: int, aspect: float | None, total: list, style: RenderStyle) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows and their bytes (rows, h, w, 3), a few pictures at a time."""
    for code, rows in sizes.items():
        quantised = float(2.0 ** (code / 254 * 6 - 3))
        w, h = _size(quantised if aspect is None else float(aspect), base)
        drawer = _Drawn(codec, w, h, style)
        for at in range(0, len(rows), step := max(1, STEP // (w * h * style.samples**2))):
            some = rows[at : at + step]
            yield some, drawer.run(_bits([texts[i] for i in some], total[some[0]]), quantised)


def _emitted(batch: pa.RecordBatch, rows: list[int], drawn: np.ndarray | None, names: list[str], schema: T.StructType) -> pa.RecordBatch:
    """The rows of a batch with their pictures; without any where ``drawn`` is None."""
    take, n = pa.array(rows), len(rows)
    kept = [c.take(take) for c in batch.columns[: len(names)]]
    if drawn is None:
        nothing = [pa.nulls(n, pa.int32())] * 2 + [pa.nulls(n, pa.list_(pa.int16()))] * 3
        return pa.RecordBatch.from_arrays([*kept, *nothing, pa.array(["the hash is no hex or too short"] * n)], names=schema.names)
    h, w = drawn.shape[1:3]
    bad = (drawn < 0).any(axis=(1, 2, 3))
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (h * w))
    mask = pa.array(bad)
    planes = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(drawn[..., k]).reshape(-1).astype(np.int16)), mask=mask) for k in range(3)]
    sizes = [pa.array(np.full(n, v, dtype=np.int32)) for v in (w, h)]
    return pa.RecordBatch.from_arrays([*kept, *sizes, *planes, pa.array(np.where(bad, "a colour is beyond the palette", None), type=pa.string())], names=schema.names)


def _frequencies(rows: DataFrame, names: list[str], schema: T.StructType, base: int, style: RenderStyle) -> DataFrame:
    """Frequency hashes drawn by two matrix products a plane; opacity isn't part of the three planes."""
    found = dct.coefficients(rows, "_hash")
    w, h = quant.output_size(F.col("_head_aspect"), base, strict=True)
    of = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(names)]
    size = len(names)

    def basis(n: int, most: int) -> np.ndarray:
        c = np.arange(most)[:, None]
        return np.where(c == 0, 1.0, 2.0) * np.cos(pi / n * c * (np.arange(n) + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws, hs = np.asarray(batch.column(size)), np.asarray(batch.column(size + 1))
            there = np.asarray(batch.column(size + 2).is_valid())
            if not there.all():
                yield _emitted(batch, np.flatnonzero(~there).tolist(), None, names, schema)
            grids = []
            for k in range(3):
                column = batch.column(size + 2 + k)
                grid = np.zeros((len(batch), 8, 8))
                row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(column.offsets)))
                flat = column.flatten()
                grid[row, np.asarray(flat.field("cy")), np.asarray(flat.field("cx"))] = np.asarray(flat.field("v"))
                grids.append(grid)
            for wide, tall in sorted(set(zip(ws[there].tolist(), hs[there].tolist(), strict=True))):
                rows_ = np.flatnonzero(there & (ws == wide) & (hs == tall))
                by, bx = basis(tall, 8), basis(wide, 8)
                for at in range(0, len(rows_), step := max(1, STEP // (wide * tall))):
                    some = rows_[at : at + step]
                    lab = [by.T @ g[some] @ bx for g in grids]
                    yield _emitted(batch, some.tolist(), effects.finished(_from_lab(*lab, style), style), names, schema)

    planes = [F.when(F.col("_hash").isNotNull(), F.col(c)).alias(c) for c in ("_l", "_p", "_q")]
    return found.select(*of, w.alias("_w"), h.alias("_h"), *planes).mapInArrow(run, schema)


def _from_lab(light: np.ndarray, a: np.ndarray, b: np.ndarray, style: RenderStyle) -> np.ndarray:
    from ..functions.color import CHROMA, LAB_BACK, LMS_BACK

    lab = np.stack((light, a / CHROMA, b / CHROMA), axis=-1)
    roots = lab @ np.array(LAB_BACK).T
    lin = (roots * roots * roots) @ np.array(LMS_BACK).T
    if style.dither and style.palette is None:
        t = effects.thresholds(light.shape[2], light.shape[1])[..., None]
        return np.clip(np.floor(_companded(np.clip(lin, 0, 1)) * 255 + t), 0, 255).astype(np.int64)
    return srgb_u8(lin)


def to_svg(df: DataFrame, codec: Codec | str, hash_: str = "hash", base: int = 256, blur: float = 0.0, corner_radius: float = 0.0, style: RenderStyle = RenderStyle()) -> DataFrame:
    """``df`` with ``svg`` and ``error``; frequency hashes have no SVG.

    The style's blur goes before ``blur``.  A corner radius counts for rectangles only; a warning says where it doesn't.
    """
    blur = style.effective_blur(blur)
    if corner_radius > 0 and isinstance(codec, Codec) and codec.shape not in ROUNDED:
        warnings.warn(f"a corner radius doesn't count for {codec.shape} hashes", stacklevel=2)
    names = [c for c in df.columns if c not in ("svg", "error")]

    def work(rows: DataFrame, one: Codec | None) -> DataFrame:
        nothing = "the codec is null or not valid" if one is None else "frequency hashes have no SVG" if one.shape == "dct" else None
        if nothing:
            return rows.select(*(f"`{c}`" for c in names), F.lit(None).cast("string").alias("svg"), F.lit(nothing).alias("error"))
        plain = F.lower(F.col(f"`{hash_}`"))
        good = F.coalesce(plain.rlike("^([0-9a-f]{2})+$") & long_enough(plain, one.column()), F.lit(False))
        radius = corner_radius if one.shape in ROUNDED else 0.0
        d = shapes.to_svg(rows.withColumn("_hash", F.when(good, plain).otherwise("00" * 8)), one, "_hash", base, blur=blur, corner_radius=radius)
        return d.select(*(f"`{c}`" for c in names), F.when(good, F.col("svg")).alias("svg"), F.when(~good, F.lit("the hash is no hex or too short")).alias("error"))

    return by_codec(df.select(*(f"`{c}`" for c in names)), codec, work)
