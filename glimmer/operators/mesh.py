"""Meshes: a picture as triangles between grid points, whose colours blend from corner to corner.

A picture's vertices are points of a grid; their triangles are the Delaunay triangulation,
which a decoder makes again, so that only the points used, a palette and an index a
vertex count as bytes.  Points are added where the error is largest, each by replacing the
triangles whose circle it lies in; only these are drawn again.  Then each vertex takes the
palette colour of least squared error while the others stay, in closed form, as the drawn
picture is linear in a vertex's colour.

A picture is a row, searched inside the task that holds it, without a shuffle.  Pictures of one
size grow in step, a vertex each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fit, metrics

#: Grid edge, vertices and colours of the usual rate points (fixed values).
RATE_POINTS = [(16, 14, 8), (24, 28, 8), (32, 48, 12), (40, 80, 12), (48, 130, 16)]

VERTEX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("gx", "gy", "color")])
#: Numbers of a kind that pictures searched together hold at most.
STEP = 1 << 18
MESH = T.StructType([T.StructField("grid", T.IntegerType()), T.StructField("vertices", T.ArrayType(VERTEX)), T.StructField("palette", T.ArrayType(T.IntegerType()))])
FITTED = T.StructType([T.StructField("mesh", MESH), T.StructField("mse", T.DoubleType())])


def median_cut(pixels: np.ndarray, colors: int) -> np.ndarray:
    """At most ``colors`` bytes (k, 3): the box of largest count times widest channel is halved at its median, again and again.

    Pixels equal in the channel stay together; a box of one colour isn't cut.
    """
    return _median_cuts(pixels.reshape(1, -1, 3), [colors])[0][0]


def _median_cuts(pixels: np.ndarray, sizes: list[int]) -> list[list[np.ndarray]]:
    """:func:`median_cut` of pictures of bytes (n, pixels, 3) to each of ``sizes``: smaller palettes are steps on the way to larger ones."""
    n, most, one = len(pixels), max(sizes), np.arange(len(pixels))
    planes = np.ascontiguousarray(np.moveaxis(pixels, -1, 0).astype(np.uint8))
    box = np.zeros(planes.shape[1:], dtype=np.int32)
    low, high = np.zeros((2, n, most, 3), dtype=np.int64)
    count, place = np.zeros((2, n, most), dtype=np.int64)
    low[:, 0], high[:, 0], count[:, 0] = planes.min(axis=2).T, planes.max(axis=2).T, planes.shape[2]
    number, live, out = np.ones(n, dtype=np.int64), one, {}
    for made in range(1, most + 1):
        if made in sizes:
            out[made] = _box_means(planes, box, place, number, count)
        score = (high[live] - low[live]).max(axis=-1) * count[live]
        # of equal boxes the first in place
        at = (score * most - place[live]).argmax(axis=1)
        cut = score[np.arange(len(live)), at] > 0
        live, at = live[cut], at[cut]
        if made == most or not len(live):
            break
        channel = (high[live, at] - low[live, at]).argmax(axis=-1)
        value, within = planes[channel, live], box[live] == at[:, None]
        row, column = np.nonzero(within)
        many = np.bincount(row * 256 + value[row, column], minlength=256 * len(live)).reshape(-1, 256)
        below = np.cumsum(many, axis=1) - many
        off = np.where((many > 0) & (below > 0), np.abs(2 * below - count[live, at, None]), np.iinfo(np.int64).max)
        above = within & (value >= off.argmin(axis=1)[:, None])
        within &= ~above
        box[live] = np.where(above, made, box[live])
        for k in range(3):
            own = planes[k, live]
            for to, part in ((at, within), (made, above)):
                low[live, to, k] = np.where(part, own, 255).min(axis=1)
                high[live, to, k] = np.where(part, own, 0).max(axis=1)
        count[live, at], count[live, made] = within.sum(axis=1), above.sum(axis=1)
        own = place[live]
        own += own > own[np.arange(len(live)), at][:, None]
        own[:, made] = own[np.arange(len(live)), at] + 1
        place[live] = own
        number[live] += 1
    last = _box_means(planes, box, place, number, count)
    return [out.get(k, last) for k in sizes]


def _box_means(planes: np.ndarray, box: np.ndarray, place: np.ndarray, number: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """The mean colour of each picture's boxes, in the order of their places."""
    n, most = place.shape
    key = (np.arange(n)[:, None] * most + box).reshape(-1)
    sums = np.stack([np.bincount(key, p.reshape(-1), n * most) for p in planes], axis=-1).reshape(n, most, 3)
    means = np.floor(sums / np.maximum(count, 1)[..., None] + 0.5).astype(np.int64)
    return [m[:k][np.argsort(p[:k])] for m, p, k in zip(means, place, number, strict=True)]


def nearest(pixels: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Index of the palette's nearest colour for bytes (..., 3); the first of equals."""
    return ((pixels[..., None, :].astype(np.int64) - palette) ** 2).sum(axis=-1).argmin(axis=-1)


@dataclass
class Triangulation:
    """Delaunay triangles of points with whole coordinates; the first four span a rectangle that holds all others."""

    points: np.ndarray
    triangles: np.ndarray = field(default_factory=lambda: np.array([[0, 1, 2], [1, 3, 2]]))

    def _inside(self, p: np.ndarray) -> np.ndarray:
        """Triangles whose circle holds ``p`` strictly within; exact in 64 bits for coordinates below 2^14."""
        a, b, c = (self.points[self.triangles[:, i]] - p for i in range(3))
        square = [(v * v).sum(axis=1) for v in (a, b, c)]
        cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
        return square[0] * cross(b, c) + square[1] * cross(c, a) + square[2] * cross(a, b) > 0

    def add(self, p: np.ndarray) -> np.ndarray:
        """Puts in a point that isn't there yet; the numbers of the triangles that are new."""
        hit = self._inside(p)
        gone, number = self.triangles[hit], len(self.points)
        edges = np.concatenate((gone[:, [0, 1]], gone[:, [1, 2]], gone[:, [2, 0]]))
        key = np.sort(edges, axis=1) @ np.array([number, 1])
        # edges of one triangle only surround the hole
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        rim = edges[first[times == 1]]
        self.points = np.concatenate((self.points, p[None]))
        new = np.column_stack((rim, np.full(len(rim), number)))
        a, b = self.points[new[:, 0]] - p, self.points[new[:, 1]] - p
        new = new[a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] > 0]  # the point may lie on the rectangle's edge
        self.triangles = np.concatenate((self.triangles[~hit], new))
        return np.arange(len(self.triangles) - len(new), len(self.triangles))


class _Mesh:
    """The mesh of one picture of ``w`` x ``h`` pixels, drawn as it grows."""

    def __init__(self, w: int, h: int, grid: int):
        self.w, self.h, self.grid = w, h, grid
        self.vertices = [(0, 0), (grid - 1, 0), (0, grid - 1), (grid - 1, grid - 1)]
        # pixels and points share a scale of whole numbers
        self.scale = np.array([w - 1, h - 1])
        self.mesh = Triangulation(np.array(self.vertices) * self.scale)
        self.corners = np.zeros((h, w, 3), dtype=np.int64)
        self.shares = np.zeros((h, w, 3))
        self._draw(np.arange(2))

    def pixel(self, gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Column and row of the pixel nearest to grid points."""
        return ((2 * gx * (self.w - 1) + self.grid - 1) // (2 * (self.grid - 1)), (2 * gy * (self.h - 1) + self.grid - 1) // (2 * (self.grid - 1)))

    def _draw(self, which: np.ndarray) -> None:
        """Sets which corners each pixel of the triangles blends, and their shares."""
        for triangle in self.mesh.triangles[which]:
            p = self.mesh.points[triangle]
            x0, y0 = -(-p.min(axis=0) // (self.grid - 1))
            x1, y1 = p.max(axis=0) // (self.grid - 1) + 1
            x, y = np.arange(x0, x1) * (self.grid - 1), np.arange(y0, y1)[:, None] * (self.grid - 1)
            weight = [(p[j, 0] - x) * (p[k, 1] - y) - (p[j, 1] - y) * (p[k, 0] - x) for j, k in ((1, 2), (2, 0), (0, 1))]
            inside = (weight[0] >= 0) & (weight[1] >= 0) & (weight[2] >= 0)
            area = (p[1, 0] - p[0, 0]) * (p[2, 1] - p[0, 1]) - (p[1, 1] - p[0, 1]) * (p[2, 0] - p[0, 0])
            self.corners[y0:y1, x0:x1][inside] = triangle
            self.shares[y0:y1, x0:x1][inside] = np.stack(weight, axis=-1)[inside] / area

    def add(self, gx: int, gy: int) -> None:
        self.vertices.append((gx, gy))
        self._draw(self.mesh.add(np.array((gx, gy)) * self.scale))

    def blended(self, colors: np.ndarray) -> np.ndarray:
        """The picture (h, w, 3) of vertex colours."""
        return (self.shares[..., None] * colors[self.corners]).sum(axis=2)


class _Lattice:
    """The columns and rows of pixels that are drawn on, rising, and how many of them lie before a coordinate."""

    def __init__(self, columns: np.ndarray, rows: np.ndarray, w: int, h: int):
        self.columns, self.rows = columns.astype(float), rows.astype(float)
        self.before = [np.searchsorted(lines, np.arange(edge + 1)) for lines, edge in ((columns, w), (rows, h))]
        self.size = len(columns) * len(rows)


class _Meshes:
    """The meshes of ``n`` pictures of one size while they grow in step; each is what ``_Mesh`` makes of the same vertices."""

    def __init__(self, n: int, w: int, h: int, grid: int, most: int):
        self.n, self.w, self.h, self.grid, self.most = n, w, h, grid, most
        self.scale = np.array([w - 1, h - 1])
        # whole numbers up to 28 times the fourth power of an edge, in doubles where these are exact
        self.points = np.zeros((2, n, most), dtype=float if 28 * (max(w, h) * grid) ** 4 < 1 << 53 else np.int64)
        self.points[:, :, :4] = (np.array([(0, 0), (grid - 1, 0), (0, grid - 1), (grid - 1, grid - 1)]) * self.scale).T[:, None]
        self.number, self.total = 4, 0
        #: corners of the triangles of each picture, how many there are, and the order in which they were made
        self.triangles = np.zeros((3, n, 2 * most), dtype=np.int64)
        self.made = np.zeros((n, 2 * most), dtype=np.int64)
        self.size = np.full(n, 2)
        #: of each triangle the factors of a point's square, x, y and 1, whose sum is positive within its circle
        self.circle = np.zeros((4, n, 2 * most), dtype=self.points.dtype)
        self._put(np.repeat(np.arange(n), 2), np.tile(np.arange(2), n), np.tile(np.array([[0, 1, 2], [1, 3, 2]]).T, n))

    def _put(self, one: np.ndarray, at: np.ndarray, corners: np.ndarray) -> None:
        place = one * (2 * self.most) + at
        for row, values in zip(self.triangles.reshape(3, -1), corners, strict=True):
            row[place] = values
        self.made.reshape(-1)[place] = self.total + np.arange(len(one))
        self.total += len(one)
        (ax, bx, cx), (ay, by, cy) = self.places(one, corners)
        a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        u = a * (by - cy) + b * (cy - ay) + c * (ay - by)
        v = a * (cx - bx) + b * (ax - cx) + c * (bx - ax)
        for row, values in zip(self.circle.reshape(4, -1), (-area, u, v, area * a - u * ax - v * ay), strict=True):
            row[place] = values

    def places(self, one: np.ndarray, corners: np.ndarray) -> list[np.ndarray]:
        """Columns and rows of vertices (..., many) of pictures."""
        number = one * self.most + corners
        return [p.take(number) for p in self.points.reshape(2, -1)]

    def add(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts a new point (n, 2) into each picture; the pictures and corners (3, new) of the triangles that are new."""
        x, y = (p * self.scale).T.astype(self.points.dtype)
        square, by_x, by_y, rest = self.circle[:, :, : self.size.max()]
        turned = square * (x * x + y * y)[:, None]
        turned += by_x * x[:, None]
        turned += by_y * y[:, None]
        turned += rest
        # free places have no circle
        one, at = np.divmod(np.flatnonzero(turned > 0), turned.shape[1])
        gone = self.triangles.reshape(3, -1).take(one * (2 * self.most) + at, axis=1)
        start, end = gone.reshape(-1), gone[[1, 2, 0]].reshape(-1)
        bits = int(self.most).bit_length()
        key = np.sort((((np.tile(one, 3) << bits | np.minimum(start, end)) << bits | np.maximum(start, end)) << 1) | (start > end))
        # edges of one triangle only surround the hole
        same = key[1:] >> 1 == key[:-1] >> 1
        key = key[~(np.append(same, False) | np.append(False, same))]
        back, low, high, of = key & 1 == 1, key >> bits + 1 & (1 << bits) - 1, key >> 1 & (1 << bits) - 1, key >> 2 * bits + 1
        start, end = np.where(back, high, low), np.where(back, low, high)
        self.points[0, :, self.number], self.points[1, :, self.number] = x, y
        (ax, bx), (ay, by) = self.places(of, np.stack((start, end)))
        px, py = x[of], y[of]
        real = (ax - px) * (by - py) - (ay - py) * (bx - px) > 0  # the point may lie on the rectangle's edge
        new, of = np.stack((start, end, np.full(len(of), self.number)))[:, real], of[real]
        self.number += 1
        # the first take the places of those that are gone, of which there are fewer
        left, made = np.bincount(one, minlength=self.n), np.bincount(of, minlength=self.n)
        rank = np.arange(len(of)) - (np.cumsum(made) - made)[of]
        taken = at[np.minimum((np.cumsum(left) - left)[of] + rank, len(at) - 1)]
        self._put(of, np.where(rank < left[of], taken, self.size[of] + rank - left[of]), new)
        self.size += made - left
        return of, new

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """The pictures and corners of all triangles, those of a picture as they were made one after the other."""
        one, at = np.nonzero(np.arange(2 * self.most) < self.size[:, None])
        order = np.argsort(one << 40 | self.made[one, at])
        one, at = one[order], at[order]
        return one, self.triangles[:, one, at]

    def cover(self, one: np.ndarray, corners: np.ndarray, lattice: _Lattice) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Pixels of a lattice that triangles cover: the place of each in its picture's, its triangle, and the shares of the three corners."""
        g = float(self.grid - 1)
        (ax, bx, cx), (ay, by, cy) = (p.astype(float) for p in self.places(one, corners))
        top, bottom = np.minimum(np.minimum(ay, by), cy), np.maximum(np.maximum(ay, by), cy)
        across, down = lattice.before
        first = down[np.ceil(top / g).astype(np.int64)]
        many = down[np.floor(bottom / g).astype(np.int64) + 1] - first
        # a corner's weight is whole and linear in x and y: slope * column + (flat + fall * row)
        slope = [(by - cy) * g, (cy - ay) * g, (ay - by) * g]
        flat = [bx * cy - by * cx, cx * ay - cy * ax, ax * by - ay * bx]
        fall = [(cx - bx) * g, (ax - cx) * g, (bx - ax) * g]
        of = np.repeat(np.arange(len(one)), many)
        line = np.arange(len(of)) + np.repeat(first - (np.cumsum(many) - many), many)
        y = lattice.rows[line]
        low, high, base = np.full(len(of), -np.inf), np.full(len(of), np.inf), []
        for s, t, f in zip(slope, flat, fall, strict=True):
            weight = f.take(of)
            weight *= y
            weight += t.take(of)
            base.append(weight)
            # where the weight is zero: from there on or up to there; a level edge has the whole row
            zero = weight / np.where(s == 0, -1, -s).take(of)
            np.maximum(low, zero + np.where(s > 0, 0, -np.inf).take(of), out=low)
            np.minimum(high, zero + np.where(s < 0, 0, np.inf).take(of), out=high)
        begin = across[np.ceil(low).astype(np.int64)]
        wide = across[np.floor(high).astype(np.int64) + 1] - begin
        begin -= np.cumsum(wide) - wide
        span = np.repeat(np.arange(len(wide)), wide)
        number = np.arange(len(span))
        x = lattice.columns.take(number + begin.take(span))
        place = number + (begin + one[of] * lattice.size + line * len(lattice.columns)).take(span)
        of = of.take(span)
        area = (flat[0] + flat[1] + flat[2]).take(of)
        shares = []
        for s, weight in zip(slope[:2], base, strict=False):
            part = s.take(of)
            part *= x
            part += weight.take(span)
            shares.append(part)
        shares.append(area - shares[0] - shares[1])
        for part in shares:
            part /= area
        return place, of, shares


def _fits(target: np.ndarray, palette: np.ndarray, grid: int, budget: int, passes: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(vertices, colour of each, mean squared error of bytes) of pictures of bytes (n, h, w, 3) with palettes (n, colours, 3)."""
    n, h, w = target.shape[:3]
    one, most = np.arange(n), min(budget, grid * grid)
    meshes = _Meshes(n, w, h, grid, most)
    gy, gx = (a.reshape(-1) for a in np.mgrid[:grid, :grid])
    columns, column = np.unique(_Mesh.pixel(meshes, np.arange(grid), 0)[0], return_inverse=True)
    rows, row = np.unique(_Mesh.pixel(meshes, 0, np.arange(grid))[1], return_inverse=True)
    # while it grows a picture is drawn only where points are
    lattice = _Lattice(columns, rows, w, h)
    shown, size = row[gy] * len(columns) + column[gx], lattice.size
    corner = np.array([0, grid - 1, grid * (grid - 1), grid * grid - 1])
    # the pixel of each point, and the points of each pixel but for the four corners
    points = np.argsort(shown, kind="stable")
    points = points[~np.isin(points, corner)]
    many = np.bincount(shown[points], minlength=size)
    begin = np.cumsum(many) - many
    planes = np.ascontiguousarray(np.moveaxis(target, -1, 0), dtype=float)
    seen = np.ascontiguousarray(planes[:, :, rows][..., columns]).reshape(3, -1)
    tones = np.ascontiguousarray(np.moveaxis(palette, -1, 0), dtype=float)
    vertices, chosen = np.zeros((2, n, most), dtype=np.int64)
    colors = np.zeros((3, n, most))

    def color(v: int, place: np.ndarray) -> None:
        chosen[:, v] = sum((tone - own[one * size + place][:, None]) ** 2 for tone, own in zip(tones, seen, strict=True)).argmin(axis=1)
        colors[:, :, v] = tones[:, one, chosen[:, v]]

    vertices[:, :4] = corner
    for v in range(4):
        color(v, np.full(n, shown[corner[v]]))
    score, used, touched = np.zeros(n * size), np.zeros((n, size), dtype=np.int64), np.zeros((n, size), dtype=bool)
    touched[:, shown[corner]] = True
    free = np.tile(many > 0, n)
    of, new = meshes.all()
    for v in range(4, most):
        place, which, shares = meshes.cover(of, new, lattice)
        error = 0.0
        for tone, own in zip(colors.reshape(3, -1), seen, strict=True):
            off = _blend(shares, tone[of * most + new], which)
            off -= own.take(place)
            off *= off
            error += off
        # of triangles that share a pixel the last one counts
        score[place] = np.where(free.take(place), error, -1)
        each = score.reshape(n, size)
        worst = each.argmax(axis=1)
        # of equal errors the first row of points, then the first column: the first pixel, unless a point of it is used
        again = np.flatnonzero(touched[one, worst])
        if len(again):
            row, tied = np.nonzero(each[again] == each[again, worst[again]][:, None])
            first = points[begin[tied] + used[again[row], tied]] * size + tied
            worst[again] = np.minimum.reduceat(first, np.searchsorted(row, np.arange(len(again)))) % size
        at = points[begin[worst] + used[one, worst]]
        touched[one, worst] = True
        used[one, worst] += 1
        spent = one[used[one, worst] == many[worst]]
        free[spent * size + worst[spent]], each[spent, worst[spent]] = False, -1
        vertices[:, v] = at
        color(v, worst)
        of, new = meshes.add(np.column_stack((gx[at], gy[at])))
    chosen, errors = _descent(meshes, planes.reshape(3, -1), tones, colors, chosen, passes)
    return np.stack((vertices % grid, vertices // grid), axis=-1), chosen, errors


def _blend(shares: list[np.ndarray], tones: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Pixels that blend the tones (3, triangles) of the corners of their triangles ``which``."""
    out = shares[0] * tones[0].take(which)
    out += shares[1] * tones[1].take(which)
    out += shares[2] * tones[2].take(which)
    return out


def _descent(meshes: _Meshes, target: np.ndarray, tones: np.ndarray, colors: np.ndarray, chosen: np.ndarray, passes: int) -> tuple[np.ndarray, list[float]]:
    """Colours that passes over all vertices leave, and mean squared errors, of pictures in planes (3, pixels) with palettes in planes."""
    n, w, h, most = meshes.n, meshes.w, meshes.h, meshes.most
    one, size = np.arange(n), w * h
    of, triangles = meshes.all()
    place, which, shares = meshes.cover(of, triangles, _Lattice(np.arange(w), np.arange(h), w, h))
    # of triangles that share a pixel the last one counts
    last = np.zeros(n * size, dtype=np.int64)
    last[place] = np.arange(len(place))
    which, shares = which.take(last), [s.take(last) for s in shares]
    rest = [_blend(shares, tone[of * most + triangles], which) - own for tone, own in zip(colors.reshape(3, -1), target, strict=True)]
    # the pixels of each vertex, one picture after the other
    share = np.stack(shares, axis=-1).reshape(-1)
    held = np.flatnonzero(share)
    vertex = triangles.T.astype(np.uint16 if most < 1 << 16 else np.int64).take(which, axis=0).reshape(-1)[held]
    order = held[np.argsort(vertex, kind="stable")]
    share, pixel = share[order], order // 3
    mine = pixel // size
    cuts = np.append(0, np.cumsum(np.bincount(vertex, minlength=most)))
    weight = np.bincount(np.repeat(np.arange(most), np.diff(cuts)) * n + mine, share * share, most * n).reshape(most, n)
    for _ in range(passes):
        for v in range(most):
            some = slice(cuts[v], cuts[v + 1])
            pixels, part, own = pixel[some], share[some], mine[some]
            change, steps = 0.0, []
            for tone, r in zip(tones, rest, strict=True):
                step = tone - tone[one, chosen[:, v]][:, None]
                change = change + step * (2 * np.bincount(own, part * r.take(pixels), n)[:, None] + step * weight[v, :, None])
                steps.append(step)
            best = change.argmin(axis=1)
            better = change[one, best] < 0
            for step, r in zip(steps, rest, strict=True):
                r[pixels] += part * np.where(better, step[one, best], 0).take(own)
            chosen[better, v] = best[better]
    return chosen, (sum(r * r for r in rest).reshape(n, size).mean(axis=1) / 3).tolist()


def fitted(df: DataFrame, grid: int, vertices: int, colors: int, passes: int = 1) -> DataFrame:
    """``df`` (w, h and flat byte arrays r, g, b) with ``mesh``, ``mse`` and ``bytes``.

    ``mesh`` has the grid's edge, its vertices with their colours, and the palette as numbers
    0xRRGGBB; ``mse`` is of bytes before they are rounded.  All three are null where arrays don't fit the
    size, hold nulls, or an edge has fewer than two pixels.  Columns of ``df`` by these names give way.
    """
    kept = [c for c in df.columns if c not in ("mesh", "mse", "bytes")]
    out = _searched(df, kept, [(grid, vertices, colors)], passes)
    one = F.col("_meshes")[0]
    return out.select(*(f"`{c}`" for c in kept), one["mesh"].alias("mesh"), one["mse"].alias("mse")).withColumn("bytes", size_of(F.col("mesh"), colors))


def _searched(df: DataFrame, kept: list[str], points: list[tuple[int, int, int]], passes: int) -> DataFrame:
    """Columns of ``df`` with ``_meshes``: an array (mesh, mse) of each picture's meshes at all rate points, both null where there is none."""
    for grid, vertices, colors in points:
        if grid < 2 or vertices < 4 or colors < 1 or grid * 1024 > 1 << 20:
            raise ValueError("a mesh needs a grid of 2 to 1024, four vertices and a colour")
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("_meshes", T.ArrayType(FITTED))])
    size, sizes = len(kept), sorted({c for _, _, c in points})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes, ws, hs = fit.sized(batch, size)
            # of each picture and rate point: vertices with their colours, palette, error
            found: list[tuple[np.ndarray, np.ndarray, float] | None] = [None] * (len(batch) * len(points))
            for (w, h), rows in fit.by_size(planes, ws, hs).items():
                if w < 2 or h < 2:
                    continue
                most = max(w * h, *(2 * min(v, g * g) for g, v, _ in points))
                for at in range(0, len(rows), step := max(1, STEP // most)):
                    some = np.array(rows[at : at + step])
                    target = np.stack([np.stack([planes[k][i] for i in some]) for k in range(3)], axis=-1).astype(np.int64)
                    palettes = dict(zip(sizes, _median_cuts(target, sizes), strict=True))
                    for number, (grid, vertices, colors) in enumerate(points):
                        if max(w, h) * grid > 1 << 14:
                            continue
                        # pictures with as many colours go together
                        many = np.array([len(p) for p in palettes[colors]])
                        for k in np.unique(many):
                            which = np.flatnonzero(many == k)
                            own = np.stack([palettes[colors][i] for i in which])
                            places, chosen, mse = _fits(target[which].reshape(-1, h, w, 3), own, grid, vertices, passes)
                            mesh = np.concatenate((places, chosen[..., None]), axis=-1)
                            for i, *one in zip(some[which] * len(points) + number, mesh, own @ (65536, 256, 1), mse, strict=True):
                                found[i] = one
            yield pa.RecordBatch.from_arrays([*batch.columns[:size], _lists(found, [g for g, _, _ in points])], names=schema.names)

    of = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(kept)]
    given = [F.col(c).cast("int").alias(f"_{c}") for c in "wh"] + [F.col(c).cast("array<int>").alias(f"_{c}") for c in "rgb"]
    return df.select(*of, *given).mapInArrow(run, schema)


def _lists(found: list[tuple[np.ndarray, np.ndarray, float] | None], grids: list[int]) -> pa.Array:
    """Arrow lists of meshes and errors, each of a row's meshes on all grids."""
    none = np.array([f is None for f in found], dtype=bool)
    there = [f for f in found if f is not None]

    def lists(at: int, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([0 if f is None else len(f[at]) for f in found]))), type=pa.int32()), values)

    vertex = np.concatenate([f[0] for f in there]) if there else np.zeros((0, 3))
    vertices = pa.StructArray.from_arrays([pa.array(vertex[:, k].astype(np.int32)) for k in range(3)], names=["gx", "gy", "color"])
    palettes = pa.array((np.concatenate([f[1] for f in there]) if there else np.zeros(0)).astype(np.int32))
    grid = pa.array(np.tile(np.array(grids, dtype=np.int32), len(found) // len(grids)))
    mesh = pa.StructArray.from_arrays([grid, lists(0, vertices), lists(1, palettes)], names=["grid", "vertices", "palette"], mask=pa.array(none))
    mse = pa.array([None if f is None else f[2] for f in found], type=pa.float64())
    ends = pa.array(np.arange(0, len(found) + 1, len(grids)), type=pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([mesh, mse], names=["mesh", "mse"]))


def size_of(mesh: Column, colors: int) -> Column:
    """Bytes of a mesh whose palette has room for ``colors``, its indices by their own entropy."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(colors - 1)), lambda c: F.size(F.filter(mesh["vertices"], lambda v: v["color"] == c)).cast("double"))
    return metrics.mesh_bytes(mesh["grid"] * mesh["grid"], F.size(mesh["vertices"]), F.lit(colors), counts)


def drawn(df: DataFrame, w: int, h: int, mesh: str = "mesh") -> DataFrame:
    """``df`` with w, h, r, g, b: its meshes drawn at a size of 2 pixels or more each way; null for null meshes."""
    if min(w, h) < 2:
        raise ValueError("a mesh is drawn on two pixels or more each way")
    added = [T.StructField(c, T.IntegerType()) for c in "wh"] + [T.StructField(c, T.ArrayType(T.ShortType())) for c in "rgb"]
    kept = [f for f in df.schema if f.name not in ("w", "h", "r", "g", "b")]
    schema = T.StructType([*kept, *added])
    size = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes: list[list] = [[], [], []]
            for one in batch.column(size).to_pylist():
                picture = None if one is None else _drawn(one, w, h)
                for k in range(3):
                    planes[k].append(None if picture is None else picture[..., k].reshape(-1))
            there = [p is not None for p in planes[0]]
            sizes = [pa.array([v if t else None for t in there], type=pa.int32()) for v in (w, h)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:size], *sizes, *(pa.array(p, type=pa.list_(pa.int16())) for p in planes)], names=schema.names)

    return df.select(*(F.col(f"`{f.name}`").alias(f"_in_{i}") for i, f in enumerate(kept)), F.col(f"`{mesh}`").alias("_mesh")).mapInArrow(run, schema)


def _drawn(one: dict, w: int, h: int) -> np.ndarray:
    mesh = _Mesh(w, h, one["grid"])
    for v in one["vertices"][4:]:
        mesh.add(v["gx"], v["gy"])
    rgb = np.array(one["palette"])[[v["color"] for v in one["vertices"]], None] >> np.array((16, 8, 0)) & 255
    return np.clip(np.floor(mesh.blended(rgb.astype(float)) + 0.5), 0, 255).astype(np.int16)


def curve(df: DataFrame, points: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """``df`` once for each rate point: its columns, grid, vertices, colors, bytes and psnr.

    A picture is read once and searched at all points in one step, with palettes that share their cuts.
    """
    points, added = points or RATE_POINTS, ("grid", "vertices", "colors", "bytes", "psnr")
    kept = [c for c in df.columns if c not in added]

    def values(number: int, point: tuple[int, int, int]) -> Column:
        one = F.col("_meshes")[number]
        both = size_of(one["mesh"], point[2]), metrics.psnr(one["mse"])
        return F.struct(*(v.alias(n) for n, v in zip(added, (*map(F.lit, point), *both), strict=True)))

    out = _searched(df, kept, points, 1)
    return out.select(*(f"`{c}`" for c in kept), F.inline(F.array(*(values(i, p) for i, p in enumerate(points)))))
