"""Fitting shapes to pictures: a row a picture, searched inside the task that holds it, without a shuffle.

A picture's shapes follow one another.  For each, forms are drawn in the codes of the hash
itself, so that what is judged is what a decoder will draw.  A candidate's sums are
differences of running sums along the rows it covers.  The best ones climb, by one of three strategies
(see :class:`SearchOptions`); each gets the opacity and the colour, as the wire rounds it, with the least
squared error, and the best of them is painted.  Draws come from one seeded stream for all pictures: a
picture's hash depends on its pixels, the codec, the seed and the options alone.

Pixels may have weights: sums, colours, the ground and the error are then weighted.

Pictures are small (a thumbnail's pixels), and batches of equal size are searched together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codec import Codec
from ..functions.stream import Stream
from . import cues
from .kernel import LINEAR, Colors, Forms, aspect_code, fields, packed, records

KINDS = ("circle", "triangle", "square", "rect", "rotrect")
#: A shape is kept if it lowers the squared error by more than this.
LEAST_GAIN = 1e-3
#: Opacity while forms are compared; all levels are tried for the winner.
TRIAL_ALPHA = 0.5
#: Numbers that a step holds at most: pictures times candidates times rows.
STEP = 1 << 19
#: Steps of a walk that ends by age.
LONGEST = 10_000
#: Spread of a walk's steps and size of small forms, as shares of the long edge; the spread of an angle's steps.
SPREAD, SMALL, TURN = 0.06, 0.12, np.pi / 12
#: Least sine of a triangle's angles, squared (17 degrees), and tries to keep to it.
SINE, TRIES = np.sin(np.deg2rad(17)) ** 2, 16


@dataclass(frozen=True)
class SearchOptions:
    """How forms are searched.

    ``primitive``: ``n_attempts`` times, small forms are drawn (``n_random`` of them, where the error is
    large; triangles anywhere) and the best one walks by normal steps of 6 % of the long edge, in places and extents,
    while a step lowers the error.  Triangles keep angles of 17 degrees.
    ``topk-uniform``: ``n_attempts`` times, forms are drawn anywhere, with an opacity each (circles of a ladder
    of 16 radii); the best ``n_topk`` walk by equally likely steps in one number at a time.
    A walk ends after ``hill_climb_max_age`` steps in a row that gain nothing; if that is None it takes
    ``hill_climb_steps`` steps, and topk-uniform halves its reach every third of them.
    ``neighbours``: ``n_random`` draws, half of them where the error is; the best ``max(n_topk, n_attempts)`` climb
    over all neighbouring codes, ``hill_climb_steps`` rounds at most, until none gains.

    ``refine_passes`` times each shape is taken out and searched again.
    """

    strategy: str = "neighbours"
    n_random: int = 64
    n_topk: int = 1
    hill_climb_steps: int = 40
    hill_climb_max_age: int | None = 30
    n_attempts: int = 4
    refine_passes: int = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "strategy", self.strategy.replace("_", "-"))
        if self.strategy not in ("neighbours", "primitive", "topk-uniform"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.hill_climb_max_age is not None and self.hill_climb_max_age < 1:
            raise ValueError("a walk ends after one step without gain at least")
        if min(self.n_random, self.n_topk, self.n_attempts) < 1 or min(self.hill_climb_steps, self.refine_passes) < 0:
            raise ValueError("a search needs at least one draw, one start and one attempt")


def defaults(kind: str) -> SearchOptions:
    """Options of a kind of shape; triangles are cheap to compare and take fewer draws."""
    return SearchOptions(n_random=50, hill_climb_max_age=50, n_attempts=3) if kind == "triangle" else SearchOptions()


@lru_cache(maxsize=64)
def _draws(seed: int, turns: int, many: int, numbers: int) -> np.ndarray:
    """Numbers in [0, 1) for every turn, draw and field, from one stream."""
    stream = Stream(seed)
    return np.array([stream.unit() for _ in range(turns * many * numbers)]).reshape(turns, many, numbers)


class _Search:
    """The search over a batch of pictures of one size; ``target`` is (pictures, h, w, 3) in linear light, ``weights`` (pictures, h, w)."""

    def __init__(self, target: np.ndarray, codec: Codec, options: SearchOptions, weights: np.ndarray | None = None):
        self.t, self.codec, self.o, self.weights = target, codec, options, weights
        self.n, self.h, self.w = target.shape[:3]
        self.forms, self.colors = Forms(codec, self.w, self.h), Colors(codec)
        self.bits = [b for _, b in fields(codec)]
        self.names = [name for name, _ in fields(codec)]
        self.top = np.array([(1 << b) - 1 for b in self.bits])
        #: adds up the four numbers of all rows
        self.fold = np.tile(np.eye(4, dtype=np.float32), (self.h, 1))
        self.moves = np.array([[k * (f == i) for i in range(len(self.bits))] for f in range(len(self.bits)) for k in (-2, -1, 1, 2)])
        #: running sums of the weights along rows
        self.heavy = None
        if weights is not None:
            heavy = np.zeros((self.n, self.h, self.w + 1))
            np.cumsum(weights, axis=2, out=heavy[:, :, 1:])
            self.heavy = heavy.reshape(-1)

    def _gains(self, running: np.ndarray, codes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Change of squared error by candidates (rows, candidates) of the pictures ``of``, in the best colour at TRIAL_ALPHA."""
        low, high = self.forms.spans(codes)
        base = ((of[:, None, None] * self.h + np.arange(self.h)) * (self.w + 1)).astype(np.int32)
        along = (running[base + high].view(np.float32) - running[base + low].view(np.float32)).reshape(-1, 4 * self.h)
        if self.o.strategy == "primitive":
            # a walk compares single candidates, whose sums must not depend on how many others are beside them
            sums = along.reshape(*low.shape, 4).sum(axis=2, dtype=np.float64)
        else:
            sums = (along @ self.fold).reshape(*low.shape[:2], 4)
        area = TRIAL_ALPHA * ((high - low).sum(axis=2) if self.heavy is None else (self.heavy[base + high] - self.heavy[base + low]).sum(axis=2))
        g = sums[..., :3]
        if self.codec.palette is not None:
            table = self.colors.table
            change = (TRIAL_ALPHA * area[..., None] * (table * table).sum(axis=1) - 2 * TRIAL_ALPHA * np.einsum("...i,ki->...k", g, table)).min(axis=-1) + sums[..., 3]
        else:
            p = np.clip(g / np.maximum(area, 1e-9)[..., None], 0, 1)
            change = (TRIAL_ALPHA * area[..., None] * p * p - 2 * TRIAL_ALPHA * p * g).sum(axis=-1) + sums[..., 3]
        return np.where(area > 0, change, 0.0)

    def _running(self, canvas: np.ndarray) -> np.ndarray:
        """Running sums along rows of what candidates are judged by: four numbers a pixel, as one element each."""
        d = self.t - canvas
        each = np.concatenate((d + TRIAL_ALPHA * canvas, (2 * TRIAL_ALPHA * d * canvas + TRIAL_ALPHA**2 * canvas * canvas).sum(axis=-1, keepdims=True)), axis=-1)
        if self.weights is not None:
            each = each * self.weights[..., None]
        out = np.zeros((self.n, self.h, self.w + 1, 4), dtype=np.float32)
        np.cumsum(each, axis=2, out=out[:, :, 1:])
        return out.view(np.complex128).reshape(-1)

    def _by_error(self, canvas: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Pixels (pictures, draws) where ``u`` falls in the pictures' errors laid end to end."""
        error = np.cumsum(self._error(canvas).reshape(self.n, -1), axis=1)
        one = np.arange(self.n)[:, None]
        share = error / np.maximum(error[:, -1:], 1e-300) + one
        found = np.searchsorted(share.reshape(-1), (one + u).reshape(-1), side="right").reshape(self.n, -1)
        return np.clip(found - one * self.h * self.w, 0, self.h * self.w - 1)

    def _error(self, canvas: np.ndarray) -> np.ndarray:
        """Squared error of each pixel, by its weight."""
        out = ((self.t - canvas) ** 2).sum(axis=-1)
        return out if self.weights is None else out * self.weights

    def _drawn(self, canvas: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Candidates (pictures, draws, fields): a place first, then the other codes."""
        many = len(u)
        place = np.broadcast_to((u[:, 0] * self.h * self.w).astype(np.int64), (self.n, many)).copy()
        place[:, ::2] = self._by_error(canvas, u[::2, 0])
        codes = np.empty((self.n, many, len(self.bits)), dtype=np.int64)
        codes[..., 0] = np.floor(place % self.w / max(self.w - 1, 1) * self.top[0] + 0.5)
        codes[..., 1] = np.floor(place // self.w / max(self.h - 1, 1) * self.top[1] + 0.5)
        for i in range(2, len(self.bits)):
            if self.names[i][0] in "xy":  # other corners lie about the first
                codes[..., i] = codes[..., "xy".index(self.names[i][0])] + np.floor((u[:, i] - 0.5) * self.top[i] + 0.5).astype(np.int64)
            else:
                codes[..., i] = np.floor(u[:, i] * (self.top[i] + 1))
        return np.clip(codes, 0, self.top)

    def best(self, canvas: np.ndarray, u: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
        """(codes, colour, alpha, change) of the best form found for each picture; ``u`` are the draws of the ``turn``."""
        if self.o.strategy == "primitive":
            codes = self._walked(canvas, np.random.Generator(np.random.PCG64([self.seed, turn])))
        elif self.o.strategy == "topk-uniform":
            codes = self._uniform(canvas, turn)
        else:
            codes = self._climbed(canvas, u)
        dressed = self.dressed(canvas, codes)
        win = dressed[3].argmin(axis=1)
        return tuple(part[np.arange(self.n), win] for part in dressed)

    def _climbed(self, canvas: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Forms (pictures, starts, fields) where no neighbour is better."""
        running, all_ = self._running(canvas), np.arange(self.n)
        codes = self._drawn(canvas, u)
        gain = self._gains(running, codes, all_)
        starts = min(max(self.o.n_topk, self.o.n_attempts), codes.shape[1])
        at = np.argsort(gain, axis=1, kind="stable")[:, :starts]
        codes, gain = np.take_along_axis(codes, at[..., None], axis=1).reshape(-1, codes.shape[-1]), np.take_along_axis(gain, at, axis=1).reshape(-1)
        climbing = np.arange(len(codes))
        for _ in range(self.o.hill_climb_steps):
            near = np.clip(codes[climbing, None] + self.moves, 0, self.top)
            change = self._gains(running, near, climbing // starts)
            to = change.argmin(axis=1)
            new = change[np.arange(len(to)), to]
            better = new < gain[climbing] - 1e-7
            codes[climbing[better]] = near[better, to[better]]
            gain[climbing[better]] = new[better]
            climbing = climbing[better]
            if not len(climbing):
                break
        return codes.reshape(self.n, starts, -1)

    def _nearest(self, i: int, value: np.ndarray) -> np.ndarray:
        """Codes of a field whose meaning is nearest to ``value``."""
        table = self.forms.tables[i].astype(float)
        above = np.clip(np.searchsorted(table, value), 1, max(len(table) - 1, 1))
        return np.where(np.abs(table[above - 1] - value) <= np.abs(table[np.minimum(above, len(table) - 1)] - value), above - 1, np.minimum(above, len(table) - 1))

    def _meaning(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([t[codes[..., i]].astype(float) for i, t in enumerate(self.forms.tables)], axis=-1)

    def _sharp(self, codes: np.ndarray) -> np.ndarray:
        """Whether an angle of triangles is below 17 degrees."""
        v = self._meaning(codes)
        p = np.stack((v[..., 0::2], v[..., 1::2]), axis=-1)
        out = np.zeros(codes.shape[:-1], dtype=bool)
        for k in range(3):
            a, b = p[..., (k + 1) % 3, :] - p[..., k, :], p[..., (k + 2) % 3, :] - p[..., k, :]
            cross = a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]
            size = (a * a).sum(axis=-1) * (b * b).sum(axis=-1)
            out |= (size == 0) | (cross * cross < SINE * size)
        return out

    def _small(self, canvas: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Small forms (pictures, draws, fields); every picture of the batch gets the same numbers."""
        long, many = max(self.w, self.h), self.o.n_attempts * self.o.n_random
        if self.codec.shape == "triangle":
            spread = max(2, int(long * SPREAD))
            codes = np.zeros((many, 6), dtype=np.int64)
            open_ = np.arange(many)
            for _ in range(4 * TRIES):
                x, y = rng.integers(0, self.w, len(open_)), rng.integers(0, self.h, len(open_))
                off = rng.integers(-spread, spread + 1, (len(open_), 4))
                for i, (v, edge) in enumerate(((x, self.w), (y, self.h), (x + off[:, 0], self.w), (y + off[:, 1], self.h), (x + off[:, 2], self.w), (y + off[:, 3], self.h))):
                    codes[open_, i] = self._nearest(i, np.clip(v, 0, edge - 1))
                open_ = open_[self._sharp(codes[open_])]
                if not len(open_):
                    break
            return np.broadcast_to(codes, (self.n, *codes.shape))
        place = self._by_error(canvas, rng.random(many))
        out = [self._nearest(0, place % self.w), self._nearest(1, place // self.w)]
        for i in range(2, len(self.bits)):
            if self.names[i] == "t":
                v = rng.integers(0, self.top[i] + 1, many)
            else:
                v = self._nearest(i, rng.integers(1, max(2, int(long * SMALL)) + 1, many))
            out.append(np.broadcast_to(v, place.shape))
        return np.stack(out, axis=-1)

    def _walked(self, canvas: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The best small form of each attempt after its walk, (pictures, attempts, fields)."""
        running, tries = self._running(canvas), self.o.n_attempts
        drawn = self._small(canvas, rng)
        gain = self._gains(running, drawn, np.arange(self.n)).reshape(self.n, tries, -1)
        first = gain.argmin(axis=2)
        codes = np.take_along_axis(drawn.reshape(self.n, tries, -1, len(self.bits)), first[..., None, None], axis=2).reshape(self.n * tries, -1).copy()
        gain = np.take_along_axis(gain, first[..., None], axis=2).reshape(-1)
        spread = max(2.0, SPREAD * max(self.w, self.h))
        age, walking = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
        for _ in range(LONGEST if self.o.hill_climb_max_age else self.o.hill_climb_steps):
            # one set of numbers for each attempt, the same for every picture
            mine = walking % tries
            near = self._stepped(codes[walking], mine, rng, tries, spread)
            change = self._gains(running, near[:, None], walking // tries)[:, 0]
            better = change < gain[walking]
            codes[walking[better]], gain[walking[better]] = near[better], change[better]
            age[walking] = np.where(better, 0, age[walking] + 1)
            if self.o.hill_climb_max_age:
                walking = walking[age[walking] < self.o.hill_climb_max_age]
                if not len(walking):
                    break
        return codes.reshape(self.n, tries, -1)

    def _stepped(self, codes: np.ndarray, mine: np.ndarray, rng: np.random.Generator, tries: int, spread: float) -> np.ndarray:
        """Each form with one number moved by a normal step (triangles: one corner), at least to the next code."""
        out = codes.copy()
        if self.codec.shape == "triangle":
            corner = rng.integers(0, 3, tries)[mine]
            step = rng.normal(size=(TRIES, tries, 2)) * spread
            open_ = np.arange(len(codes))
            for k in range(TRIES):
                for c, edge in ((0, self.w), (1, self.h)):
                    field = 2 * corner[open_] + c
                    at = self.forms.tables[c][codes[open_, field]]
                    out[open_, field] = self._nearest(c, np.clip(at + step[k, mine[open_], c], 0, edge - 1))
                open_ = open_[self._sharp(out[open_])]
                if not len(open_):
                    break
            out[open_] = codes[open_]
            return out
        field, step = rng.integers(0, len(self.bits), tries)[mine], rng.normal(size=tries)[mine]
        for i in range(len(self.bits)):
            rows = np.flatnonzero(field == i)
            if self.names[i] == "t":
                width = np.pi / (self.top[i] + 1)
                by = np.rint(step[rows] * TURN / width).astype(np.int64)
                out[rows, i] = (codes[rows, i] + np.where(by == 0, np.sign(step[rows]).astype(np.int64), by)) % (self.top[i] + 1)
                continue
            to = self._nearest(i, self.forms.tables[i][codes[rows, i]] + step[rows] * spread)
            same = to == codes[rows, i]
            out[rows, i] = np.clip(np.where(same, to + np.sign(step[rows]).astype(np.int64), to), 0, self.top[i])
        return out

    def _wide(self, canvas: np.ndarray) -> np.ndarray:
        """Running sums along rows of error, canvas, their product and the canvas' square: what any opacity is judged by."""
        d = self.t - canvas
        each = np.concatenate((d, canvas, (d * canvas).sum(axis=-1, keepdims=True), (canvas * canvas).sum(axis=-1, keepdims=True)), axis=-1)
        if self.weights is not None:
            each = each * self.weights[..., None]
        out = np.zeros((self.n, self.h, self.w + 1, 8))
        np.cumsum(each, axis=2, out=out[:, :, 1:])
        return out.reshape(-1, 8)

    def _changes(self, wide: np.ndarray, codes: np.ndarray, level: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Change of squared error by candidates (rows, candidates) with an opacity each, in its best colour."""
        low, high = self.forms.spans(codes)
        base = (of[:, None, None] * self.h + np.arange(self.h)) * (self.w + 1)
        sums = (wide[base + high] - wide[base + low]).sum(axis=2)
        area = ((high - low) if self.heavy is None else self.heavy[base + high] - self.heavy[base + low]).sum(axis=2)
        a = np.array(self.codec.levels)[level]
        g = sums[..., :3] + a[..., None] * sums[..., 3:6]
        rest = 2 * a * sums[..., 6] + a * a * sums[..., 7]
        if self.codec.palette is not None:
            table = self.colors.table
            change = ((a * a * area)[..., None] * (table * table).sum(axis=1) - 2 * a[..., None] * np.einsum("...i,ki->...k", g, table)).min(axis=-1) + rest
        else:
            p = np.clip(g / np.maximum(a * area, 1e-9)[..., None], 0, 1)
            change = ((a * a * area)[..., None] * p * p - 2 * a[..., None] * p * g).sum(axis=-1) + rest
        return np.where((area > 0) & (a > 0), change, 0.0)

    def _ladder(self) -> np.ndarray:
        """Codes of 16 radii between an eighth of the short edge (4 at least) and the long edge, by equal factors."""
        least = max(4, min(self.w, self.h) // 8)
        most = max(least + 1, max(self.w, self.h))
        return np.unique(self._nearest(2, np.rint(least * (most / least) ** (np.arange(16) / 15))))

    def _uniform(self, canvas: np.ndarray, turn: int) -> np.ndarray:
        """The best forms of every attempt after walks by equally likely steps, (pictures, forms, fields)."""
        wide, one, levels = self._wide(canvas), np.arange(self.n), len(self.codec.levels)
        margin, long, circle = max(self.w, self.h) // 4, max(self.w, self.h), self.codec.shape in ("circle", "square")
        ladder = self._ladder() if circle else None
        edges = [self.w if n[0] == "x" else self.h for n in self.names]
        places = [i for i, n in enumerate(self.names) if n[0] in "xy"]
        over = margin if self.codec.shape == "triangle" else 0
        steps = LONGEST if self.o.hill_climb_max_age else self.o.hill_climb_steps
        found = []
        for attempt in range(self.o.n_attempts):
            # a stream of its own, as other pictures may have walked longer
            rng, many = np.random.Generator(np.random.PCG64([self.seed, turn, attempt])), self.o.n_random
            drawn = np.empty((many, len(self.bits)), dtype=np.int64)
            for i in range(len(self.bits)):
                if i in places:
                    drawn[:, i] = self._nearest(i, np.clip(rng.integers(-over, edges[i] + over, many), 0, edges[i] - 1))
                else:
                    drawn[:, i] = ladder[rng.integers(0, len(ladder), many)] if circle else rng.integers(0, self.top[i] + 1, many)
            opacity = rng.integers(0, levels, many)
            change = self._changes(wide, np.broadcast_to(drawn, (self.n, *drawn.shape)), np.broadcast_to(opacity, (self.n, many)), one)
            top = np.argsort(change, axis=1, kind="stable")[:, : self.o.n_topk]
            k = top.shape[1]
            codes, level, gain = drawn[top].reshape(self.n * k, -1), opacity[top].reshape(-1), np.take_along_axis(change, top, axis=1).reshape(-1)
            reach = max(2, long // (10 if self.codec.shape == "triangle" else 12))
            age, walking = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
            # steps that gained nothing from where a form stands; they needn't be judged again
            vain = np.zeros((len(codes), len(self.bits) + 1, 2 * reach + 1), dtype=bool)
            for s in range(steps):
                mine = walking % k
                field, by, way = rng.integers(0, len(self.bits) + 1, k)[mine], rng.integers(-reach, reach + 1, k)[mine], (2 * rng.integers(0, 2, k) - 1)[mine]
                step = np.where(np.isin(field, places), by, way) + reach
                open_ = ~vain[walking, field, step]
                vain[walking, field, step] = True
                all_, walking, field, by, way = walking, walking[open_], field[open_], by[open_], way[open_]
                near, shade = codes[walking].copy(), level[walking].copy()
                for i in range(len(self.bits)):
                    rows = np.flatnonzero(field == i)
                    if i in places:
                        near[rows, i] = self._nearest(i, np.clip(self.forms.tables[i][near[rows, i]] + by[rows], 0, edges[i] - 1))
                    elif circle:
                        near[rows, i] = ladder[np.clip(np.searchsorted(ladder, near[rows, i]) + way[rows], 0, len(ladder) - 1)]
                    else:
                        near[rows, i] = np.clip(near[rows, i] + way[rows], 0, self.top[i])
                rows = np.flatnonzero(field == len(self.bits))
                shade[rows] = (shade[rows] + way[rows]) % levels
                new = self._changes(wide, near[:, None], shade[:, None], walking // k)[:, 0]
                better = new < gain[walking]
                to = walking[better]
                codes[to], level[to], gain[to] = near[better], shade[better], new[better]
                vain[to] = False
                walking = all_
                age[walking] += 1
                age[to] = 0
                if self.o.hill_climb_max_age:
                    walking = walking[age[walking] < self.o.hill_climb_max_age]
                    if not len(walking):
                        break
                elif s and s % max(1, steps // 3) == 0:
                    reach = max(1, reach // 2)
                    vain = np.zeros((len(codes), len(self.bits) + 1, 2 * reach + 1), dtype=bool)
            found.append(codes.reshape(self.n, k, -1))
        return np.concatenate(found, axis=1)

    def dressed(self, canvas: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes (pictures, candidates, fields) with the colour and the opacity, both as the wire has them, of the least error, and its change."""
        n, many = codes.shape[:2]
        mask = self.forms.mask(codes).astype(np.float64)
        if self.weights is not None:
            mask = mask * self.weights[:, None]
        mask = mask.reshape(n, many, -1)
        d = self.t - canvas
        parts = np.concatenate((d, canvas, (d * canvas), canvas * canvas, np.ones((*d.shape[:3], 1))), axis=-1).reshape(n, -1, 13)
        sums = np.matmul(mask, parts).reshape(n * many, 13)
        (sd, sc, sdc, scc), area = np.split(sums[:, :12], 4, axis=-1), sums[:, 12:]
        levels = np.array(self.codec.levels)[:, None, None, None]
        if self.codec.palette is not None:
            color = np.broadcast_to(np.arange(self.codec.colors), (len(levels), n * many, self.codec.colors))
        else:
            color = self.colors.code(np.clip((sd + levels[..., 0] * sc) / np.maximum(levels[..., 0] * area, 1e-9), 0, 1))[..., None]
        p = self.colors.light(color)
        change = (-2 * levels * (p * sd[:, None] - sdc[:, None]) + levels**2 * (p * p * area[:, None] - 2 * p * sc[:, None] + scc[:, None])).sum(axis=-1)
        change = np.where((area > 0) & (levels[..., 0] > 0), change, 0.0).transpose(1, 0, 2).reshape(n * many, -1)
        best, one = change.argmin(axis=1), np.arange(n * many)
        level, which = np.divmod(best, color.shape[-1])
        return codes, *(x.reshape(n, many) for x in (color[level, one, which], level, change[one, best]))

    def paint(self, canvas: np.ndarray, codes: np.ndarray, color: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        a = np.array(self.codec.levels)[alpha][:, None, None, None] * self.forms.mask(codes)[..., None]
        return canvas + a * (self.colors.light(color)[:, None, None] - canvas)

    def run(self, seed: int) -> tuple[list[str], np.ndarray]:
        """Hashes and squared errors, by weight, of all pictures."""
        n, shapes, self.seed = self.n, self.codec.n_shapes, seed & (1 << 64) - 1
        mean = self.t.mean(axis=(1, 2)) if self.weights is None else (self.t * self.weights[..., None]).sum(axis=(1, 2)) / self.weights.sum(axis=(1, 2))[:, None]
        ground = self.colors.code(mean)
        blank = np.broadcast_to(self.colors.light(ground)[:, None, None], self.t.shape)
        u = _draws(seed, shapes * (1 + self.o.refine_passes), self.o.n_random, len(self.bits))
        codes = np.zeros((n, shapes, len(self.bits)), dtype=np.int64)
        color, alpha = np.zeros((n, shapes), dtype=np.int64), np.zeros((n, shapes), dtype=np.int64)
        canvas = blank
        for k in range(shapes):
            found = self.best(canvas, u[k], k)
            good = found[3] < -LEAST_GAIN
            # where nothing helps the shape is the smallest one, in the colour below it
            codes[:, k] = np.where(good[:, None], found[0], 0)
            color[:, k] = np.where(good, found[1], self.colors.code(canvas[:, 0, 0]))
            alpha[:, k] = np.where(good, found[2], 0)
            canvas = self.paint(canvas, codes[:, k], color[:, k], alpha[:, k])
        for turn in range(self.o.refine_passes):
            if not self._refined(blank, codes, color, alpha, u[(turn + 1) * shapes :], (turn + 1) * shapes):
                break
        canvas = blank
        for k in range(shapes):
            canvas = self.paint(canvas, codes[:, k], color[:, k], alpha[:, k])
        stream = records(codes, color, alpha, self.codec).reshape(n, -1)
        head = [(np.full(n, aspect_code(self.w, self.h)), 8), (ground, self.codec.color_field)]
        bits = [(stream[:, i], 1) for i in range(stream.shape[1])]
        return packed(head + bits, n), self._error(canvas).sum(axis=(1, 2))

    def _refined(self, blank: np.ndarray, codes: np.ndarray, color: np.ndarray, alpha: np.ndarray, u: np.ndarray, turn: int) -> bool:
        """One pass over the shapes, each taken out and searched again; what is accepted moves last.  Whether any was."""
        shapes, one, some = codes.shape[1], np.arange(self.n), False
        at = np.zeros(self.n, dtype=np.int64)  # the shape of each picture that is next
        for k in range(shapes):
            full, rest = blank, blank
            for j in range(shapes):
                shape = codes[:, j], color[:, j], alpha[:, j]
                full = self.paint(full, *shape)
                rest = np.where((at == j)[:, None, None, None], rest, self.paint(rest, *shape))
            found = self.best(rest, u[k], turn + k)
            before, after = (self._error(c).sum(axis=(1, 2)) for c in (full, rest))
            good = after + found[3] < before - 1e-9
            for i in one[good]:
                for values, new in ((codes, found[0]), (color, found[1]), (alpha, found[2])):
                    values[i] = np.concatenate((np.delete(values[i], at[i], axis=0), new[i : i + 1]))
            some |= bool(good.any())
            # behind one that moved stands the next one in its place
            at = np.where(good, at, at + 1)
        return some


def fitted(df: DataFrame, codec: Codec, seed: int = 0, options: SearchOptions | None = None, w: str = "w", h: str = "h", r: str = "r", g: str = "g", b: str = "b", cue: str = "uniform", strength: float = 0.0) -> DataFrame:
    """``df`` with ``hash`` and ``sse`` of the pictures in its flat byte arrays.

    With a ``cue`` (see ``cues``) pixels weigh 1 + ``strength`` times the cue, in the search, its colours, the
    ground and ``sse``.  Arrays that don't fit the size, or hold nulls, give null.  Columns of ``df``
    by these two names give way to them.
    """
    if cue not in cues.CUES or strength < 0:
        raise ValueError(f"a cue is one of {cues.CUES}, and none takes weight away")
    if codec.shape not in KINDS:
        raise ValueError(f"{codec.shape} hashes aren't fitted")
    options = options or defaults(codec.shape)
    kept = [f for f in df.schema if f.name not in ("hash", "sse")]
    schema = T.StructType([*kept, T.StructField("hash", T.StringType()), T.StructField("sse", T.DoubleType())])
    names = [f.name for f in kept]
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes, ws, hs = sized(batch, size)
            hashes: list[str | None] = [None] * len(batch)
            errors: list[float | None] = [None] * len(batch)
            many = options.n_random * (1 if options.strategy == "neighbours" else options.n_attempts)
            for (wide, tall), rows in by_size(planes, ws, hs).items():
                step = max(1, STEP // (many * tall))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    target = np.stack([np.stack([planes[k][i] for k in range(3)], axis=-1) for i in some]).reshape(len(some), tall, wide, 3)
                    light = LINEAR[target]
                    weights = None if cue == "uniform" or strength == 0 else cues.planes(light, cue, strength)
                    found, sse = _Search(light, codec, options, weights).run(seed)
                    for i, text, e in zip(some, found, sse.tolist(), strict=True):
                        hashes[i], errors[i] = text, e
            yield pa.RecordBatch.from_arrays([*batch.columns[:size], pa.array(hashes, type=pa.string()), pa.array(errors, type=pa.float64())], names=schema.names)

    of = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(names)]
    given = [F.col(f"`{w}`").cast("int").alias("_w"), F.col(f"`{h}`").cast("int").alias("_h"), *(F.col(f"`{c}`").cast("array<int>").alias(f"_{k}") for c, k in zip((r, g, b), "rgb", strict=True))]
    return df.select(*of, *given).mapInArrow(run, schema)


def sized(batch: pa.RecordBatch, at: int, planes: int = 3) -> tuple[list[list[np.ndarray | None]], list, list]:
    """The planes, widths and heights that stand from column ``at`` on; a plane is None where it is null or holds nulls."""
    ws, hs = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()

    def rows(column: pa.Array) -> list[np.ndarray | None]:
        values, bounds = column.values, np.asarray(column.offsets)
        there = np.asarray(column.is_valid())
        if values.null_count:
            holes = np.concatenate(([0], np.cumsum(np.asarray(values.is_null()))))
            there &= holes[bounds[1:]] == holes[bounds[:-1]]
            values = values.fill_null(0)
        flat = np.asarray(values)
        return [flat[a:b] if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], there, strict=True)]

    return [rows(batch.column(at + 2 + k)) for k in range(planes)], ws, hs


def by_size(planes: list[list[np.ndarray | None]], ws: list, hs: list) -> dict[tuple[int, int], list[int]]:
    """The rows of each size whose planes fit it and hold bytes."""
    out: dict[tuple[int, int], list[int]] = {}
    for i, (wide, tall) in enumerate(zip(ws, hs, strict=True)):
        if not wide or not tall or wide < 0 or tall < 0:
            continue
        if all(p[i] is not None and len(p[i]) == wide * tall and p[i].min() >= 0 and p[i].max() <= 255 for p in planes):
            out.setdefault((wide, tall), []).append(i)
    return out


def pictures(pixels: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, w, h, r, g, b) of pixel rows (key, y, x, r, g, b): a picture's pixels meet in one row.

    A pixel that occurs more than once counts by its smallest colours; one that is missing makes the arrays not fit.
    """
    row = F.struct("y", "x", "r", "g", "b")
    one = pixels.groupBy(key, "y", "x").agg(*(F.min(c).alias(c) for c in "rgb"))
    d = one.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.array_sort(F.collect_list(row)).alias("all"))
    return d.select(key, "w", "h", *(F.col(f"all.{c}").alias(c) for c in "rgb"))


def fit(pixels: DataFrame, codec: Codec, key: str = "vec_id", seed: int = 0, options: SearchOptions | None = None) -> DataFrame:
    """(key, hash, sse) of pictures given as pixel rows (key, y, x, r, g, b of bytes)."""
    return fitted(pictures(pixels, key), codec, seed, options).select(key, "hash", "sse")
