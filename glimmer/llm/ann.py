"""Approximate nearest neighbours by balanced posting lists.

Fit: k-means centroids on a bounded sample; then every list that all rows make longer than
MOST times the mean is split by k-means on a bounded sample of its own rows, until none is.
So the number of lists grows with the rows, and so does nothing else.  Of the centroids a
graph is made that links each with its nearest ones, and the distance ratio is fitted at
which pruning keeps the recall asked for.

Index, over every row: a vector goes to the list of its nearest centroid and, where it
lies on a boundary (another centroid is less than BOUNDARY times as far), to the lists of
up to COPIES - 1 further ones.

Search: a query walks the graph of centroids held in memory, best first, and searches the
lists whose centroid is at most ``ratio`` times as far as the nearest one.  Neighbouring lists
share a cell, half the square root of their number; a query is sent once to each cell, with the numbers of the lists
it searches there, so that its copies don't grow with the lists.

Inner products are searched as distances by one more coordinate, sqrt(M^2 - |x|^2).  Equal
vectors share a class that keeps the ids needed for any answer, so copies cost nothing.
Vectors are candidates of queries of their own length only: each length has an index of its
own, unless its vectors fill less than two of the shortest lists.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import BLOCK, keyed, kmeans, matrix, sample
from .workspace import Workspace

#: Vectors the first centroids are fitted on (and numbers in them at most), of which the last TRIALS are queries; their recall sets the ratio.
SAMPLE, NUMBERS, TRIALS = 16_384, 1 << 24, 256
#: Share of the sample's true neighbours whose lists must be searched.
RECALL = 0.98
#: Vectors of a list on average: twice the square root of their number within these bounds.
SHORT, LONG = 32, 512
#: A list of MOST times as many is split, in PARTS at most, by SPLIT of its vectors; in so many rounds.
MOST, PARTS, SPLIT, ROUNDS = 4, 64, 4096, 10
#: Sample vectors of each of the first centroids at least.
PER_CENTROID = 8
#: Memory for the centroids of all lengths; where more of them were needed, lists are longer instead.
CENTROID_BYTES = 1 << 28
#: Neighbours of a centroid in the graph.
DEGREE = 16
COPIES, BOUNDARY = 3, 1.05
#: Groups of centroids that an assignment looks into.
PROBES = 8
#: Blocks of queries of one list that one task searches.
TOGETHER = 8
#: Cells whose numbers of blocks are broadcast; with more of them Spark chooses the join.
BROADCAST_CELLS = 1_000_000
#: Numbers of vectors that a task hands on at once.
PIECE = 1 << 20


def stored(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that makes them all as long as the longest."""
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate((x, rest[:, None]), axis=1)


class Centroids:
    """Centroids in groups of about the square root of their number, for assigning vectors to them."""

    def __init__(self, c: np.ndarray):
        tops = kmeans(c if len(c) <= SAMPLE else c[np.random.Generator(np.random.PCG64(2)).choice(len(c), SAMPLE, replace=False)], max(1, int(len(c) ** 0.5)))
        home = _closest(c, tops, 1)[1][:, 0]
        order = np.argsort(home, kind="stable")
        self.tops, self.c = tops, c[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(home, minlength=len(tops)))))

    def near(self, y: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and numbers of the ``take`` nearest centroids in the PROBES nearest groups; infinite where there are fewer."""
        probed = _closest(y, self.tops, PROBES)[1]
        dist, at = np.full((len(y), take), np.inf), np.zeros((len(y), take), dtype=np.int64)
        square = (y * y).sum(axis=1)
        for t in np.unique(probed):
            c = self.c[self.start[t] : self.start[t + 1]]
            if not len(c):
                continue
            rows = np.flatnonzero((probed == t).any(axis=1))
            d = np.sqrt(np.maximum(square[rows, None] + (c * c).sum(axis=1)[None] - 2 * y[rows] @ c.T, 0))
            both = np.concatenate((dist[rows], d), axis=1)
            number = np.concatenate((at[rows], np.broadcast_to(np.arange(self.start[t], self.start[t + 1]), d.shape)), axis=1)
            best = np.argpartition(both, take - 1, axis=1)[:, :take]
            dist[rows], at[rows] = np.take_along_axis(both, best, axis=1), np.take_along_axis(number, best, axis=1)
        return dist, at

    def lists_of(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list of each row and its copies beyond a boundary."""
        dist, at = self.near(y, COPIES)
        row, col = np.nonzero((dist <= np.maximum(dist.min(axis=1, keepdims=True) * BOUNDARY, 1e-12)) & np.isfinite(dist))
        return row, at[row, col]


def _closest(x: np.ndarray, c: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and numbers of the ``take`` nearest of ``c`` (all, if fewer), in pieces that fit in memory."""
    take, out = min(take, len(c)), []
    for at in range(0, len(x), step := max(1, (1 << 22) // len(c))):
        part = x[at : at + step]
        d = (part * part).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * part @ c.T
        best = np.argpartition(d, take - 1, axis=1)[:, :take]
        out.append((np.take_along_axis(d, best, axis=1), best))
    return tuple(np.concatenate(o) for o in zip(*out, strict=True))


class Index:
    """Centroids, their graph, and the pruning ratio."""

    def __init__(self, groups: Centroids, near: np.ndarray, x: np.ndarray, longest: float, k: int, sizes: np.ndarray):
        self.groups, self.longest = groups, longest
        #: vectors whose nearest list each is, and how many of them a query must meet to find ``k`` beside itself
        self.sizes, self.needed = sizes, k + 1
        self.centroids = c = groups.c
        #: lists of a cell; lists that follow one another are near, as the groups of centroids do
        self.width = max(1, int(len(c) ** 0.5 / 2))
        # each centroid's nearest ones, both ways, and a chain that keeps the graph in one piece
        chain = np.arange(len(c) - 1)
        a = np.concatenate((np.repeat(np.arange(len(c)), near.shape[1]), chain))
        b = np.concatenate((near.reshape(-1), chain + 1))
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        order = np.lexsort((b, a))
        self.edges = b[order].astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=len(c)))))
        trials = min(TRIALS, len(x) // 4)
        self.ratio = self._fitted(x, trials, k) if trials else 10.0

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries scaled to the longest vector; their direction alone decides the order."""
        unit = q / np.linalg.norm(q, axis=1)[:, None] * self.longest
        return np.concatenate((unit, np.zeros((len(q), 1))), axis=1)

    def _fitted(self, x: np.ndarray, trials: int, k: int) -> float:
        """The ratio at which the lists searched hold RECALL of the trials' neighbours in the sample."""
        row, list_ = self.groups.lists_of(stored(x, self.longest))
        lists: list[list[int]] = [[] for _ in range(len(x))]
        for r, t in zip(row, list_, strict=True):
            lists[r].append(int(t))
        needed = []
        q = self.asked(x[-trials:])
        scores = x[-trials:] @ x.T
        for i in range(trials):
            d = np.linalg.norm(self.centroids - q[i], axis=1)
            scores[i, len(x) - trials + i] = -np.inf
            top = np.argpartition(-scores[i], min(k, len(x) - 1) - 1)[:k]
            needed += [min(d[t] for t in lists[j]) / max(d.min(), 1e-12) for j in top]
        return float(np.quantile(needed, RECALL)) * (1 + 1e-9)

    def search(self, q: np.ndarray) -> list[int]:
        """Lists within the ratio of the nearest centroid, found by walking the graph; the nearest first.

        More of them, if those hold fewer vectors than a query asks for.
        """
        c, seen = self.centroids, np.zeros(len(self.centroids), dtype=bool)
        tops = self.groups.tops
        sizes = np.diff(self.groups.start)
        top = int(np.argmin(np.where(sizes > 0, ((tops - q) ** 2).sum(axis=1), np.inf)))
        new = np.arange(self.groups.start[top], self.groups.start[top + 1])
        heap: list[tuple[float, int]] = []
        found: list[tuple[float, int]] = []
        best, patience, held = np.inf, 0, 0
        while True:
            seen[new] = True
            dist = np.sqrt(((c[new] - q) ** 2).sum(axis=1))
            best, held = min(best, float(dist.min(initial=np.inf))), held + int(self.sizes[new].sum())
            for e, j in zip(dist.tolist(), new.tolist(), strict=True):
                heapq.heappush(heap, (e, j))
                found.append((e, j))
            if not heap:
                break
            d, i = heapq.heappop(heap)
            # go on a little beyond the ratio: the way to a list may lead over farther ones
            patience = patience + 1 if d > best * self.ratio * 1.02 else 0
            if patience > DEGREE and held >= self.needed:
                break
            new = np.unique(self.edges[self.first[i] : self.first[i + 1]])
            new = new[~seen[new]]
        found.sort()
        before = np.cumsum([0, *(self.sizes[j] for _, j in found)])
        return [j for (e, j), n in zip(found, before.tolist(), strict=False) if e <= best * self.ratio or n < self.needed]


def _sizes(classes: DataFrame, groups: Centroids, longest: float) -> np.ndarray:
    """How many rows have each centroid as their nearest."""
    shared = classes.sparkSession.sparkContext.broadcast((groups, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, high = shared.value
        total = np.zeros(len(g.c), dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column(0), g.c.shape[1] - 1)
            for at in range(0, len(x), 4096):
                total += np.bincount(g.near(stored(x[at : at + 4096], high), 1)[1][:, 0], minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["list", "n"])

    rows = classes.select("vector").mapInArrow(run, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(groups.c), dtype=np.int64)
    for r in rows:
        out[r["list"]] = r["n"]
    return out


def _split(classes: DataFrame, groups: Centroids, longest: float, sizes: np.ndarray, most: int, per_list: int) -> np.ndarray:
    """The centroids, with those of lists longer than ``most`` replaced by some of their own."""
    large = np.flatnonzero(sizes > most)
    share = np.ones(len(sizes))
    share[large] = 2.0 * SPLIT / sizes[large]
    shared = classes.sparkSession.sparkContext.broadcast((groups, longest, set(large.tolist()), share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, high, wanted, part = shared.value
        wanted = np.array(sorted(wanted))
        for batch in batches:
            x, draw = matrix(batch.column(0), g.c.shape[1] - 1), np.asarray(batch.column(1))
            for at in range(0, len(x), 4096):
                home = g.near(stored(x[at : at + 4096], high), 1)[1][:, 0]
                keep = np.flatnonzero(np.isin(home, wanted) & (draw[at : at + 4096] < part[home]))
                yield pa.RecordBatch.from_arrays([pa.array(home[keep]), batch.column(0).take(pa.array(at + keep)), pa.array(draw[at + keep])], names=["list", "vector", "draw"])

    draw = F.shiftrightunsigned(F.xxhash64("key"), 11) / float(1 << 53)
    some = classes.select("vector", draw.alias("draw")).mapInArrow(run, "list long, vector array<double>, draw double")
    # a bounded number of each list's rows, the same ones each time
    few = some.withColumn("r", F.row_number().over(Window.partitionBy("list").orderBy("draw", "vector"))).where(F.col("r") <= SPLIT).select("list", "vector")

    def parts(frame: pd.DataFrame) -> pd.DataFrame:
        _, high, _, _ = shared.value
        n = int(sizes[frame["list"].iloc[0]])
        c = kmeans(stored(np.stack(frame["vector"].to_numpy()), high), max(2, min(PARTS, -(-n // per_list))))
        return pd.DataFrame({"centroid": list(c)})

    made = few.groupBy("list").applyInPandas(parts, "centroid array<double>").toArrow()
    new = matrix(made.column("centroid").combine_chunks(), groups.c.shape[1])
    return np.unique(np.concatenate((np.delete(groups.c, large, axis=0), new)), axis=0)


def _graph(classes: DataFrame, groups: Centroids) -> np.ndarray:
    """The nearest other centroids of each, as a job over pieces of them."""
    n, take = len(groups.c), min(DEGREE + 1, len(groups.c))
    shared = classes.sparkSession.sparkContext.broadcast(groups.c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for start in batch.column(0).to_pylist():
                mine = np.arange(start, min(start + 1024, n))
                dist, at = _closest(c[mine], c, take)
                dist[at == mine[:, None]] = -1.0  # itself comes first
                near = np.take_along_axis(at, np.argsort(dist, axis=1), axis=1)[:, 1:]
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(list(near.astype(np.int32)), type=pa.list_(pa.int32()))], names=["i", "near"])

    pieces = -(-n // 1024)
    rows = classes.sparkSession.range(0, n, 1024, min(pieces, 1024)).mapInArrow(run, "i long, near array<int>").toArrow().sort_by("i")
    return np.asarray(rows.column("near").combine_chunks().flatten(), dtype=np.int64).reshape(n, take - 1)


def fit(classes: DataFrame, k: int) -> dict[int, Index]:
    """An index for each length that ``classes`` (key, dim, vector) need two lists or more for."""
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    lengths = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("longest")).where(F.col("n") >= 2 * SHORT).collect()
    numbers = sum(n * (dim + 1) for dim, n, _ in lengths)
    found = {}
    for dim, n, longest in sorted(map(tuple, lengths)):
        mine = classes.where(F.col("dim") == dim)
        x = sample(mine, SAMPLE, NUMBERS)
        # each length has the share of the memory that it has of all numbers
        per_list = max(min(max(SHORT, int(2 * n**0.5)), LONG), -(-8 * numbers // CENTROID_BYTES))
        groups = Centroids(kmeans(stored(x, longest), max(1, min(n // per_list, len(x) // PER_CENTROID))))
        sizes = _sizes(mine, groups, longest)
        for _ in range(ROUNDS):
            if sizes.max() <= MOST * per_list:
                break
            groups = Centroids(_split(mine, groups, longest, sizes, MOST * per_list, per_list))
            sizes = _sizes(mine, groups, longest)
        found[dim] = Index(groups, _graph(mine, groups), x, longest, k, sizes)
    return found


def _by_cell(row: np.ndarray, list_: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row once for each cell of its lists: rows, cells, all lists in that order, and where those of each begin and end."""
    order = np.lexsort((list_, row))
    row, list_ = row[order], list_[order]
    cell = list_ // width
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
    first = np.flatnonzero(new)
    return row[first], cell[first], list_, np.append(first, len(row))


def _placed(classes: DataFrame, shared, searching: bool) -> DataFrame:
    """(dim, cell, lists, key, vector, least, nearest): classes in the cells of their lists, or queries in those of the lists they search.

    ``nearest`` marks the cell that a query searches first, which has its nearest list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: dict[int, Index] = shared.value
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for dim in np.unique(dims).tolist():
                of_dim = batch.filter(pa.array(dims == dim))
                x, ix = matrix(of_dim.column(2), dim), indexes.get(dim)
                piece = max(1, PIECE // dim)
                for at in range(0, len(x), 256):
                    part = x[at : at + 256]
                    home = np.zeros(len(part), dtype=np.int64)
                    if ix is None:
                        row, list_, width = np.arange(len(part)), np.zeros(len(part), dtype=np.int64), 1
                    elif searching:
                        found = [ix.search(q) for q in ix.asked(part)]
                        row, width = np.repeat(np.arange(len(part)), [len(f) for f in found]), ix.width
                        list_ = np.concatenate([np.array(f, dtype=np.int64) for f in found])
                        home = np.array([f[0] // width for f in found])
                    else:
                        row, list_ = ix.groups.lists_of(stored(part, ix.longest))
                        width = ix.width
                    row, cell, list_, bounds = _by_cell(row, list_, width)
                    for a in range(0, len(row), piece):
                        rows, cells, cuts = row[a : a + piece], cell[a : a + piece], bounds[a : a + piece + 1]
                        lists = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), pa.array(list_[cuts[0] : cuts[-1]].astype(np.int32)))
                        dim_, key, vector, least = (c.take(pa.array(at + rows)) for c in of_dim.columns)
                        yield pa.RecordBatch.from_arrays([dim_, pa.array(cells.astype(np.int32)), lists, key, vector, least, pa.array(searching & (home[rows] == cells))], names=["dim", "cell", "lists", "key", "vector", "least", "nearest"])

    return classes.select("dim", "key", "vector", "least").mapInArrow(run, "dim int, cell int, lists array<int>, key binary, vector array<double>, least long, nearest boolean")


def _blocks(ws: Workspace, placed: DataFrame, name: str) -> DataFrame:
    """(dim, cell, slot, items): cells cut into blocks of about BLOCK rows; items have key, vector, least, bound and lists."""
    long = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("slots")).where("slots > 1")
    # few cells are longer than a block; their number is looked at before they are broadcast
    if long.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        long = F.broadcast(long)
    slot = F.pmod(F.xxhash64("key"), F.coalesce("slots", F.lit(1))).cast("int")
    cut = placed.join(long, ["dim", "cell"], "left").withColumn("slot", slot)
    return ws.keep(cut.groupBy("dim", "cell", "slot").agg(F.collect_list(F.struct("key", "vector", "least", "bound", "lists")).alias("items")), name)


def _members(lists: pa.ListArray, low: int, n: int) -> np.ndarray:
    """Which of ``n`` lists from ``low`` on each row has."""
    out = np.zeros((len(lists), n), dtype=np.float32)
    out[np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten()) - low] = 1
    return out


def _sums(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the components."""
    out = q[:, 0] * x[:, 0]
    for d in range(1, q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """(query, key, score, least): the best ``k`` + 1 classes of each block for each query, none below its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                one = batch.slice(r, 1)
                asked, held = one.column(0).flatten(), one.column(1).flatten()
                dim = len(asked.field("vector").flatten()) // len(asked)
                q, x = matrix(asked.field("vector"), dim), matrix(held.field("vector"), dim)
                least = np.asarray(held.field("least"))
                numbers = np.concatenate([np.asarray(side.field("lists").flatten()) for side in (asked, held)])
                low, n = int(numbers.min()), int(np.ptp(numbers)) + 1
                # only what is in a list that the query searches
                rough = np.where(_members(asked.field("lists"), low, n) @ _members(held.field("lists"), low, n).T > 0, q @ x.T, -np.inf)
                take = min(k + 1, len(x))
                floor = np.maximum(np.partition(rough, len(x) - take, axis=1)[:, len(x) - take], np.asarray(asked.field("bound")))
                most = np.abs(rough[np.isfinite(rough)]).max(initial=0)
                i, j = np.nonzero((rough >= (floor - 1e-9 * (1 + most))[:, None]) & (rough > -np.inf))
                score = np.concatenate([_sums(q[i[at : at + 65536]], x[j[at : at + 65536]]) for at in range(0, max(len(i), 1), 65536)])
                order = np.lexsort((least[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                best = rank < take
                i, j = pa.array(i[best]), pa.array(j[best])
                yield pa.RecordBatch.from_arrays([asked.field("key").take(i), held.field("key").take(j), pa.array(score[best]), held.field("least").take(j)], names=["query", "key", "score", "least"])

    return pairs.select("asked", "held").mapInArrow(run, "query binary, key binary, score double, least long")


def search(df: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its ``k`` nearest found in ``df`` by inner product.

    A query's own id is no candidate.  Ties go to the smaller id; fewer candidates than ``k``
    give fewer rows.  Vectors that take no part (see ``keyed``) and rows without an id are
    neither queries nor candidates; vectors of another length than the query's are no
    candidates of it.  Rows that repeat id and vector count once.
    """
    ws = Workspace(df.sparkSession, "ann")
    usable = F.col("key").isNotNull() & F.col("vec_id").isNotNull()
    rows = ws.keep(keyed(df, vec_id, vector).where(usable).dropDuplicates(["vec_id", "key"]), "rows")
    asked = keyed(queries, vec_id, vector).where(usable).select("vec_id", "key", "vector").dropDuplicates(["vec_id", "key"])
    few = rows.select("key", "vec_id", F.row_number().over(Window.partitionBy("key").orderBy("vec_id")).alias("r")).where(F.col("r") <= k + 1)
    ids = few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    # a number given keeps Spark from merging small partitions of much work
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = rows.repartition(n, "key").groupBy("key").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.min("vec_id").alias("least"))
    classes = ws.keep(one, "classes")
    shared = df.sparkSession.sparkContext.broadcast(fit(classes, k))

    asked = ws.keep(asked.withColumn("dim", F.size("vector")), "asked")
    query_classes = asked.repartition(n, "key").groupBy("key").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.min("vec_id").alias("least"))
    lowest = F.lit(float("-inf"))
    held = _blocks(ws, _placed(classes, shared, False).withColumn("bound", lowest), "lists").select("dim", "cell", F.col("slot").alias("of"), F.col("items").alias("held"))
    wanted = ws.keep(_placed(query_classes, shared, True), "wanted")

    def searched(queries: DataFrame, name: str) -> DataFrame:
        blocks = _blocks(ws, queries, f"{name}-blocks").select("dim", "cell", "slot", F.col("items").alias("asked"))
        # many queries may search a cell: each TOGETHER of their blocks meet a copy of it
        blocks = blocks.withColumn("part", F.floor(F.col("slot") / TOGETHER).cast("int")).drop("slot")
        parts = blocks.groupBy("dim", "cell").agg(F.max("part").alias("last")).where("last > 0")
        copies = held.join(parts, ["dim", "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0))))).drop("last")
        by = ["dim", "cell", "part"]
        return ws.keep(_nearest(blocks.repartition(n, *by).join(copies.repartition(n, *by), by), k), name)

    # the nearest cell first: what it holds bounds what the others need to return
    first = searched(wanted.where("nearest").withColumn("bound", lowest), "first")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    bounds = first.select("query", "score", rank.alias("r")).where(F.col("r") == k + 1).select(F.col("query").alias("key"), F.col("score").alias("bound"))
    rest = wanted.where("not nearest").join(bounds, "key", "left").withColumn("bound", F.coalesce("bound", lowest))
    found = first.unionByName(searched(rest, "rest")).dropDuplicates(["query", "key"])
    best = found.select("query", "key", "score", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least")).alias("r")).where(F.col("r") <= k + 1).drop("r")
    flat = best.join(ids, "key").select("query", "score", F.explode("ids").alias("id")).select("query", F.struct((-F.col("score")).alias("minus"), "id").alias("hit"))
    top = flat.select("query", "hit", F.row_number().over(Window.partitionBy("query").orderBy("hit")).alias("r")).where(F.col("r") <= k + 1)
    top = ws.keep(top.groupBy("query").agg(F.sort_array(F.collect_list("hit")).alias("hits")), "top")
    mine = asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")).join(top, "query")
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("r", "h")).select("query_id", (F.col("r") + 1).alias("rank"), F.col("h.id").alias("vec_id"), (-F.col("h.minus")).alias("score"))
