"""Numpy helpers of the picture operators, for Arrow batches inside tasks.

All of them work on a batch of pictures of one size: planes are (pictures, h, w), codes
(pictures, candidates, fields).  Rules are those of ``functions``; tests hold both together.
"""

from __future__ import annotations

from functools import lru_cache
from math import pi

import numpy as np

from ..codec import Codec

_U8 = np.arange(256) / 255
#: sRGB bytes as linear light.
LINEAR = np.where(_U8 <= 0.04045, _U8 / 12.92, ((_U8 + 0.055) / 1.055) ** 2.4)


def _companded(lin: np.ndarray) -> np.ndarray:
    return np.where(lin <= 0.0031308, lin * 12.92, np.maximum(lin, 0.0) ** (1 / 2.4) * 1.055 - 0.055)


_STEPS = 1 << 14
#: First guesses of a byte by linear light, and the light from which each byte begins.
_GUESS = np.clip(np.floor(_companded(np.arange(_STEPS + 1) / _STEPS) * 255 + 0.5), 0, 255).astype(np.int32)
_EDGE = (np.arange(256) - 0.5) / 255
_BEGINS = np.concatenate(([-np.inf], np.where(_EDGE[1:] <= 0.0031308 * 12.92, _EDGE[1:] / 12.92, ((_EDGE[1:] + 0.055) / 1.055) ** 2.4), [np.inf]))


def srgb_u8(lin: np.ndarray) -> np.ndarray:
    """Linear light as sRGB bytes; a guess from a table, set right by the bytes' own edges."""
    lin = np.clip(np.nan_to_num(lin, nan=0.0), 0.0, 1.0)
    u = _GUESS[(lin * _STEPS).astype(np.int32)]
    for _ in range(2):
        u = u + (lin >= _BEGINS[u + 1]) - (lin < _BEGINS[u])
    return u


def rounded(x: np.ndarray) -> np.ndarray:
    """Halves away from zero, as whole numbers."""
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)


def fields(codec: Codec) -> list[tuple[str, int]]:
    """Names and bits of a shape's geometric codes, in the order of the hash."""
    x, y, r = ("x", codec.cx_bits), ("y", codec.cy_bits), codec.r_bits
    more = {"circle": [("r", r)], "square": [("r", r)], "rect": [("w", r), ("h", r)], "rotrect": [("w", r), ("h", r), ("t", codec.theta_bits)], "triangle": [("x1", x[1]), ("y1", y[1]), ("x2", x[1]), ("y2", y[1])]}
    return [x, y, *more[codec.shape]]


#: Forms of a canvas whose spans are kept, if there are no more.
KEPT = 1 << 18


@lru_cache(maxsize=8)
def _kept(codec: Codec, w: int, h: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
    """What each code adds to the number of a form, and the spans of all forms by number; None where there are many."""
    forms, step, adds, values = Forms(codec, w, h), 1, [], []
    for t in forms.tables:
        value, first, number = np.unique(t, return_index=True, return_inverse=True)
        adds.append(number * step)
        values.append(first)
        step *= len(value)
    if step > KEPT:
        return None
    low, high = [], []
    for at in range(0, step, 1 << 14):
        rest, codes = np.arange(at, min(at + (1 << 14), step)), []
        for v in values:
            rest, which = np.divmod(rest, len(v))
            codes.append(v[which])
        for out, found in zip((low, high), forms.computed_spans(np.stack(codes, axis=-1)), strict=True):
            out.append(found)
    return adds, np.concatenate(low), np.concatenate(high)


class Forms:
    """What codes mean on a canvas, and the span of each row that a form covers."""

    def __init__(self, codec: Codec, w: int, h: int):
        self.codec, self.w, self.h = codec, w, h

        def places(bits: int, edge: int) -> np.ndarray:
            return rounded(np.arange(1 << bits) / max((1 << bits) - 1, 1) * max(edge - 1, 0))

        def extents(bits: int, short: int, long: int) -> np.ndarray:
            least = max(1.0, short / 24)
            most = max(least + 1, float(long))
            return rounded(least * (most / least) ** (np.arange(1 << bits) / max((1 << bits) - 1, 1)))

        r = codec.r_bits
        by_name = {"x": places(codec.cx_bits, w), "y": places(codec.cy_bits, h), "r": extents(r, min(w, h), max(w, h)), "w": extents(r, w, w), "h": extents(r, h, h), "t": (np.arange(1 << codec.theta_bits) + 0.5) / (1 << codec.theta_bits) * pi}
        #: The meaning of every code, by field.
        self.tables = [by_name[name] if name in by_name else by_name[name[0]] for name, _ in fields(codec)]
        self.tables = [t if t.dtype.kind == "f" else t.astype(np.int32) for t in self.tables]

    def spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First column and one past the last of each row (..., h); equal where a row isn't covered."""
        kept = _kept(self.codec, self.w, self.h) if self.w * self.h <= 256 else None
        if kept is None:
            return self.computed_spans(codes)
        adds, low, high = kept
        number = sum(add[codes[..., i]] for i, add in enumerate(adds))
        return low[number], high[number]

    def computed_spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``spans`` gives, from the codes' meaning."""
        v = [t[codes[..., i]][..., None] for i, t in enumerate(self.tables)]
        y = np.arange(self.h, dtype=np.int32)
        kind = self.codec.shape
        if kind == "circle":
            left = v[2] * v[2] - (y - v[1]) ** 2
            half = np.sqrt(np.maximum(left, 0)).astype(np.int32)  # whole roots are exact
            low, high = v[0] - half, np.where(left >= 0, v[0] + half + 1, v[0] - half)
        elif kind in ("square", "rect"):
            wide, tall = v[2], v[2] if kind == "square" else v[3]
            top = v[1] - tall // 2
            low = v[0] - wide // 2
            high = np.where((y >= top) & (y <= top + np.maximum(tall - 1, 0)), low + np.maximum(wide, 1), low)
            low = np.broadcast_to(low, high.shape)
        elif kind == "triangle":
            low, high = self._polygon([(v[0], v[1]), (v[2], v[3]), (v[4], v[5])], y)
        else:
            c, s = np.cos(v[4]), np.sin(v[4])
            corners = []
            for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
                dx, dy = v[2] * a, v[3] * b
                corners.append((rounded(v[0] + (dx * c - dy * s)), rounded(v[1] + (dx * s + dy * c))))
            low, high = self._polygon(corners, y)
        low, high = np.clip(low, 0, self.w), np.clip(high, 0, self.w)
        return low, np.maximum(low, high)

    def _polygon(self, points: list, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of a convex polygon with its edges; one without area (by its first three corners) is empty."""
        (ax, ay), (bx, by), (cx, cy) = points[:3]
        area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        turn = np.sign(area)
        low, high = np.float64(0), np.float64(self.w)
        for i, (px, py) in enumerate(points):
            qx, qy = points[(i + 1) % len(points)]
            # inside: m * x <= k; quotients of whole numbers this small have the right floor
            m = turn * (qy - py)
            k = turn * ((qx - px) * (y - py) + (qy - py) * px)
            with np.errstate(divide="ignore", invalid="ignore"):
                bound = k / m
            high = np.where(m > 0, np.minimum(high, np.floor(bound) + 1), np.where((m == 0) & (k < 0), -1, high))
            low = np.where(m < 0, np.maximum(low, np.ceil(bound)), low)
        return low.astype(np.int32), np.where(area == 0, low, high).astype(np.int32)

    def mask(self, codes: np.ndarray) -> np.ndarray:
        """Pixels that forms cover, (..., h, w)."""
        low, high = self.spans(codes)
        x = np.arange(self.w)
        return (x >= low[..., None]) & (x < high[..., None])


class Colors:
    """The wire's colours: codes of linear colours, and the light that a decoder reads from them."""

    def __init__(self, codec: Codec):
        self.codec = codec
        if codec.palette is not None:
            raw = bytes.fromhex(codec.palette)[: 3 * codec.colors]
            self.bytes = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int64)
            self.table = LINEAR[self.bytes]

    def code(self, lin: np.ndarray) -> np.ndarray:
        if self.codec.palette is not None:
            # sums channel by channel, as the columns do
            d = ((lin[..., None, 0] - self.table[:, 0]) ** 2 + (lin[..., None, 1] - self.table[:, 1]) ** 2) + (lin[..., None, 2] - self.table[:, 2]) ** 2
            return d.argmin(axis=-1)
        r, g, b = (srgb_u8(lin[..., k]).astype(np.int64) for k in range(3))
        if self.codec.color_bits == 16:
            return (r >> 3) << 11 | (g >> 2) << 5 | b >> 3
        return r | g << 8 | b << 16

    def u8(self, code: np.ndarray) -> np.ndarray:
        """Bytes (..., 3) of codes; an index beyond the palette is black."""
        if self.codec.palette is not None:
            there = code < len(self.bytes)
            return np.where(there[..., None], self.bytes[np.where(there, code, 0)], 0)
        if self.codec.color_bits == 16:
            r, g, b = code >> 11, code >> 5 & 63, code & 31
            return np.stack((r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2), axis=-1)
        return np.stack((code & 255, code >> 8 & 255, code >> 16 & 255), axis=-1)

    def light(self, code: np.ndarray) -> np.ndarray:
        return LINEAR[self.u8(code)]


def aspect_code(w: int, h: int) -> int:
    return int(np.clip(np.floor((np.log2(w / h) + 3) / 6 * 254 + 0.5), 0, 254))


def packed(columns: list[tuple[np.ndarray, int]], n: int) -> list[str]:
    """Hex of numbers of ``n`` pictures written one after another with their bits, lowest first."""
    parts = [(np.asarray(v, dtype=np.int64).reshape(n, -1)[:, :, None] >> np.arange(b) & 1).astype(np.uint8) for v, b in columns if b]
    bits = np.concatenate([p.reshape(n, -1) for p in parts], axis=1)
    return [row.tobytes().hex() for row in np.packbits(bits, axis=1, bitorder="little")]


def records(codes: np.ndarray, colors: np.ndarray, alphas: np.ndarray, codec: Codec) -> np.ndarray:
    """The bits of all shapes, (pictures, shapes, bits)."""
    all_ = [(codes[..., i], b) for i, (_, b) in enumerate(fields(codec))] + [(colors, codec.color_field), (alphas, codec.alpha_bits)]
    return np.concatenate([(np.asarray(v, dtype=np.int64)[..., None] >> np.arange(b) & 1).astype(np.uint8) for v, b in all_], axis=-1)
