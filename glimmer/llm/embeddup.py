"""Near-duplicate embeddings: int8 tiles with rigorous error bounds, exact recomputation.

Equal vectors form one class first.  Unit vectors have a home cell, that of the pivot with
the largest inner product; pivots come from a bounded sample and decide nothing but the
work.  A pair of cosine at least t is at most sqrt(2 - 2t) apart, so across a bisecting
plane it can lie only if both are that close to it: such vectors are copied to the cell on
the other side, once for each pair of cells.  Vectors without clusters lie close to most
such planes; so pivots are halved in number until vectors that didn't make them have
``COPIES`` copies at most on average, in the end to a single cell, all of whose blocks meet.
Blocks grow with their cell, to ``IN_BLOCK`` numbers: a vector is sent once for each block
that its own block meets.  Within a cell all blocks are multiplied with each other as int8
codes.  A code's inner product differs from the true one by no more than
e_u + (1 + e_u) e_v, with e the length of a vector's rounding error; only pairs that may
reach t by that bound are computed again in double precision.

A tile returns, for each of its vectors, how many vectors it is linked with and one member
of its group inside the tile, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, node
from .vectors import BLOCK, keyed, kmeans, matrix, sample
from .workspace import Workspace

#: Vectors from which pivots are made, numbers in them at most, and vectors of the sample for each pivot.
SAMPLE, NUMBERS, PER_PIVOT = 65_536, 1 << 24, 4
#: Copies of a vector in other cells, on average over the sample's other half.
COPIES = 3.0
#: Numbers in a block of vectors at most, and blocks of a cell wanted before blocks grow beyond ``BLOCK`` vectors.
IN_BLOCK, BLOCKS = 1 << 20, 16
#: Components whose products of codes are summed in single precision: 127 * 127 * EXACT < 2^24.
EXACT = 1024
_SLACK = 1e-9
_NODE = "struct<no_id: boolean, least: bigint, of: binary>"
_ROWS = f"key {_NODE}, cell int, home boolean, size long, code binary, scale double, error double, vector array<double>"


def _quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(u - q * scale[:, None], axis=1)


def _margins(u: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home cell of each of ``u``, and rows with the later cells that they are copied to."""
    square = (c * c).sum(axis=1)
    home, rows, to = np.zeros(len(u), dtype=np.int64), [], []
    for at in range(0, len(u), step := max(1, (1 << 22) // len(c))):
        near = u[at : at + step] @ c.T
        mine = near.argmax(axis=1)
        apart = np.sqrt(np.maximum(square[mine][:, None] + square[None] - 2 * c[mine] @ c.T, 1e-12))
        margin = near[np.arange(len(near)), mine][:, None] - near
        r, cell = np.nonzero((margin <= reach * apart) & (np.arange(len(c)) > mine[:, None]))
        home[at : at + step] = mine
        rows.append(at + r)
        to.append(cell)
    return home, np.concatenate(rows), np.concatenate(to)


def _reach(threshold: float) -> float:
    return (2 - 2 * threshold) ** 0.5 + 1e-6


def pivots_of(unit: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Pivots for ``n`` vectors, made from one half of a sample of unit vectors and held against the other; none for one cell."""
    fit, other = unit[::2], unit[1::2]
    k = min(len(unit) // PER_PIVOT, n // (2 * BLOCK))
    while k > 1:
        pivots = kmeans(fit, k)
        if len(pivots) > 1 and len(_margins(other, pivots, _reach(threshold))[1]) <= COPIES * len(other):
            return pivots
        k //= 2
    return np.zeros((0, 0))


def _cells(classes: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    reach = _reach(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column(3), int(dim))
                u = x / np.linalg.norm(x, axis=1)[:, None]
                code, scale, error = _quantised(u)
                n = len(u)
                row, cell, home = np.arange(n), np.full(n, -int(dim)), np.ones(n, dtype=bool)
                if len(c) and c.shape[1] == dim:
                    cell, r, to = _margins(u, c, reach)
                    row, cell, home = np.concatenate((row, r)), np.concatenate((cell, to)), np.concatenate((home, np.zeros(len(r), dtype=bool)))
                for at in range(0, len(row), 4096):
                    take = row[at : at + 4096]
                    index = pa.array(take)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(index),
                            pa.array(cell[at : at + 4096].astype(np.int32)),
                            pa.array(home[at : at + 4096]),
                            part.column(2).take(index),
                            pa.array([code[i].tobytes() for i in take], type=pa.binary()),
                            pa.array(scale[take]),
                            pa.array(error[take]),
                            part.column(3).take(index),
                        ],
                        names=["key", "cell", "home", "size", "code", "scale", "error", "vector"],
                    )

    return classes.select("key", "dim", "size", "vector").mapInArrow(run, _ROWS)


class _Block:
    """A block's arrays, from its Arrow list of structs."""

    def __init__(self, items: pa.StructArray):
        field = items.field
        self.keys = field("key")
        self.size = np.asarray(field("size"))
        self.scale, self.error = np.asarray(field("scale")), np.asarray(field("error"))
        self.code = np.frombuffer(b"".join(field("code").to_pylist()), dtype=np.int8).reshape(len(items), -1).astype(np.float32)
        self.x = matrix(field("vector"), self.code.shape[1])
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of codes held as float32, in pieces whose sums stay below 2^24."""
    out = (a[:, :EXACT] @ b[:, :EXACT].T).astype(np.float64)
    for at in range(EXACT, a.shape[1], EXACT):
        out += a[:, at : at + EXACT] @ b[:, at : at + EXACT].T
    return out


def links(a: _Block, b: _Block, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of two blocks (or of one, each once) with cosine at least ``threshold``."""
    left, right = [], []
    for at in range(0, len(a.x), 256):
        rows = slice(at, at + 256)
        ea = a.error[rows, None]
        near = products(a.code[rows], b.code) * (a.scale[rows, None] * b.scale[None])
        near += ea + (1 + ea) * b.error[None]
        maybe = near >= threshold - _SLACK
        if same:
            maybe &= np.arange(len(b.x))[None] > np.arange(at, at + len(maybe))[:, None]
        i, j = np.nonzero(maybe)
        cosine = np.concatenate([np.einsum("ij,ij->i", a.x[at + i[k : k + 65536]], b.x[j[k : k + 65536]]) for k in range(0, max(len(i), 1), 65536)])
        true = cosine / (a.norm[at + i] * b.norm[j]) >= threshold
        left.append(at + i[true])
        right.append(j[true])
    return np.concatenate(left), np.concatenate(right)


def _groups(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tiles(pairs: DataFrame, threshold: float) -> DataFrame:
    """(key, links, other) of blocks ``x`` and ``y`` (``same`` block twice: y is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                a = _Block(one.column(0).flatten())
                same = one.column(1).null_count == 1
                b = a if same else _Block(one.column(1).flatten())
                i, j = links(a, b, same, threshold)
                if not len(i):
                    continue
                shift = 0 if same else len(a.x)
                keys = a.keys if same else pa.concat_arrays([a.keys, b.keys])
                size = a.size if same else np.concatenate((a.size, b.size))
                j = j + shift
                count = (np.bincount(i, weights=size[j], minlength=len(keys)) + np.bincount(j, weights=size[i], minlength=len(keys))).astype(np.int64)
                group = _groups(len(keys), i, j)
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(count[at]), keys.take(pa.array(group[at]))], names=["key", "links", "other"])

    return pairs.select("x", "y").mapInArrow(run, f"key {_NODE}, links long, other {_NODE}")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows of cosine at least ``threshold``; ``component_id`` is
    the smallest id that links reach.  Vectors that take no part (see ``keyed``) and those
    of another length have no links with them.  Rows may repeat: each is a vector of its
    own.  A row without an id takes part; a component without any id is null.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    ws = Workspace(df.sparkSession, "embeddings")
    rows = ws.keep(keyed(df, vec_id, vector), "rows")
    # a class goes by a node that orders by its smallest id, which its component's label then holds
    classes = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    classes = ws.keep(classes.select(node(F.col("least"), F.col("key")).alias("key"), "size", "dim", "vector"), "classes")
    n = classes.count()
    some = sample(classes, SAMPLE, NUMBERS)
    unit = some / np.linalg.norm(some, axis=1)[:, None] if len(some) else some
    pivots = pivots_of(unit, n, threshold)
    cells = ws.keep(_cells(classes, pivots, threshold), "cells")

    sizes = cells.groupBy("cell", "home").count()
    fits = F.greatest(F.lit(1), F.floor(IN_BLOCK / F.when(F.col("cell") < 0, -F.col("cell")).otherwise(max(pivots.shape[1], 1))))
    block = F.least(fits, F.greatest(F.lit(BLOCK), F.floor(F.col("count") / BLOCKS)))
    slots = ws.keep(sizes.select("cell", "home", F.ceil(F.col("count") / block).cast("int").alias("slots")), "slots")  # at most two rows a pivot, or one a length
    item = F.struct("key", "size", "code", "scale", "error", "vector")
    slot = F.pmod(F.xxhash64("key"), F.col("slots")).cast("int")
    blocks = ws.keep(cells.join(F.broadcast(slots), ["cell", "home"]).withColumn("slot", slot).groupBy("cell", "home", "slot").agg(F.collect_list(item).alias("items")), "blocks")
    homes = slots.where("home").select("cell", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("i"))
    others = slots.select("cell", F.col("home").alias("home_j"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("j"))
    pairs = homes.join(others, "cell").where("not home_j or i <= j")
    x = blocks.where("home").select("cell", F.col("slot").alias("i"), F.col("items").alias("x"))
    y = blocks.select("cell", F.col("home").alias("home_j"), F.col("slot").alias("j"), F.col("items").alias("y"))
    twice = pairs.where("home_j and i = j").join(x, ["cell", "i"]).select("cell", "i", F.lit(-1).alias("j"), "x", F.lit(None).cast(x.schema["x"].dataType).alias("y"))
    once = pairs.where("not home_j or i <> j").join(x, ["cell", "i"]).join(y, ["cell", "home_j", "j"]).select("cell", "i", F.when(F.col("home_j"), F.col("j")).otherwise(-2 - F.col("j")).alias("j"), "x", "y")
    found = ws.keep(_tiles(twice.unionByName(once).repartition("cell", "i", "j"), threshold), "found")

    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    labels = connected_components(ws, found.select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = classes.select("key", "size").join(counts, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = named.select(F.col("key.of").alias("key"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "key")["least"].alias("component_id"))
    out = rows.select("vec_id", "key").join(named, "key", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
