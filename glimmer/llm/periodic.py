"""Periodic runs of words, by a harmonic grid of longest common extensions.

A run of period q and length at least 2q compares equal to itself q words on at some
multiple of q: so for each q only the pairs (g, g + q) at multiples g of q are looked at,
n/1 + n/2 + ... of them.  For all (q, g) of many documents at once the words at both places
are compared, and where they agree the longest common extensions to both sides are found
by bisection over prefix hashes, in NumPy.  What is long enough is verified word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import free, named, numbered, slices
from .texthash import mix

#: Pairs (period, grid point) looked at together.
PAIRS = 1 << 19
#: Words of documents looked at together.
WORDS = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n + 1, _BASE, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Words:
    """Words of several documents as numbers, equal for equal words, with prefix hashes over all of them."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        self.ids, self.first = ids, first
        self.power = _powers(len(ids))
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(ids.astype(np.uint64) + _BASE) * self.power[:-1], dtype=np.uint64)))

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from each ``a`` and from each ``b`` >= a hash alike."""
        return (self.sums[a + n] - self.sums[a]) * self.power[b - a] == self.sums[b + n] - self.sums[b]

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on, ``most`` at most."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) >> 1
            fit = self.same(a[open_], b[open_], middle)
            low[open_[fit]] = middle[fit]
            high[open_[~fit]] = middle[~fit] - 1

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b, ``most`` at most."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) >> 1
            fit = self.same(a[open_] - middle, b[open_] - middle, middle)
            low[open_[fit]] = middle[fit]
            high[open_[~fit]] = middle[~fit] - 1


def _grid(first: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, grid point from the document's start) of all pairs, in pieces of about PAIRS."""
    size = np.diff(first)
    size = np.where(size >= least, size, 0)
    doc = np.repeat(np.arange(len(size)), size // 2)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(size // 2) - size // 2, size // 2) + 1
    points = (size[doc] - 1) // q if len(doc) else np.zeros(0, dtype=np.int64)
    end = np.cumsum(points)
    at = 0
    while at < len(q):
        done = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, done + PAIRS, side="right")))
        rows = np.repeat(np.arange(at, to), points[at:to])
        k = np.arange(len(rows)) - np.repeat(end[at:to] - points[at:to] - done, points[at:to])
        yield doc[rows], q[rows], k * q[rows]
        at = to


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, ordered; document i has the words first[i] to first[i + 1].

    A run is a stretch with smallest period q of max(``least``, 2q) words or more that no
    neighbouring word extends.
    """
    words = Words(ids, first)
    found = [np.zeros((0, 4), dtype=np.int64)]
    for doc, q, k in _grid(first, least):
        a = first[doc] + k
        equal = np.flatnonzero(ids[a] == ids[a + q])
        doc, q, k, a = doc[equal], q[equal], k[equal], a[equal]
        end = first[doc + 1]
        back = words.behind(a, a + q, np.minimum(k, q))
        # a run that reaches the grid point before belongs to that one
        here = np.flatnonzero(back < q)
        doc, q, a, back, end = doc[here], q[here], a[here], back[here], end[here]
        ahead = words.ahead(a, a + q, end - a - q)
        length = back + ahead + q
        long = np.flatnonzero(length >= np.maximum(least, 2 * q))
        found.append(np.stack((doc[long], (a - back)[long], length[long], q[long]), axis=1))
    rows = np.concatenate(found)
    # the smallest period of each stretch
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    rows = rows[np.concatenate(([True], (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1)))[: len(rows)]]
    bad = [i for i, (_, s, n, q) in enumerate(rows.tolist()) if not _holds(ids, first, rows[i, 0], s, n, q)]
    if bad:  # two different stretches hashed alike: these documents are compared word by word
        docs = np.unique(rows[bad, 0])
        rows = np.concatenate([rows[~np.isin(rows[:, 0], docs)], *(_plain(ids, first, d, least) for d in docs.tolist())])
    rows[:, 1] -= first[rows[:, 0]]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _holds(ids: np.ndarray, first: np.ndarray, doc: int, start: int, length: int, q: int) -> bool:
    """Whether the words bear a run out."""
    end = start + length
    left = start > first[doc] and ids[start - 1] == ids[start - 1 + q]
    right = end < first[doc + 1] and ids[end] == ids[end - q]
    return not left and not right and bool((ids[start : end - q] == ids[start + q : end]).all())


def _plain(ids: np.ndarray, first: np.ndarray, doc: int, least: int) -> np.ndarray:
    """The runs of one document without hashes, a period after the other."""
    lo, hi = int(first[doc]), int(first[doc + 1])
    found: dict[tuple[int, int], int] = {}
    for q in range(1, (hi - lo) // 2 + 1):
        same = np.concatenate(([False], ids[lo : hi - q] == ids[lo + q : hi], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s + q >= max(least, 2 * q):
                found.setdefault((lo + s, e - s + q), q)
    return np.array([(doc, s, n, q) for (s, n), q in found.items()], dtype=np.int64).reshape(-1, 4)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 1] + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _examined(texts: pa.Array, least: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text its runs (start, length, period) and its words without repetitions."""
    group: list[list[bytes]] = []
    ids: list[np.ndarray] = []
    known: defaultdict[bytes, int] = defaultdict(count().__next__)

    def flush() -> Iterator[tuple[np.ndarray, bytes]]:
        first = np.concatenate(([0], np.cumsum([len(w) for w in group], dtype=np.int64))).astype(np.int64)
        rows = runs_of(np.concatenate(ids), first, least)
        cut = np.searchsorted(rows[:, 0], np.arange(len(group) + 1))
        for i, words in enumerate(group):
            mine = rows[cut[i] : cut[i + 1]]
            yield mine[:, 1:], _collapsed(words, mine) if len(mine) else b" ".join(words)
        group.clear()
        ids.clear()
        known.clear()

    size = 0
    for text in texts.cast(pa.binary()):
        words = (text.as_py() or b"").split()  # at ASCII white space
        group.append(words)
        ids.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
        size += len(words)
        if size >= WORDS:
            yield from flush()
            size = 0
    if group:
        yield from flush()


def find_runs(df: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``df`` with ``runs`` (array of start, length, period, by start and period) and ``collapsed``.

    Words are what stands between the white space of ASCII, numbered from 0.  A run is a stretch of
    words with smallest period q (words q apart are equal), at least ``least`` and 2q long, that
    can't be extended.  ``collapsed`` has the words joined by one space, without those that some
    run holds after its first q words.

    A null or wordless text has no runs and an empty ``collapsed``; rows are independent, so
    repeated rows repeat and an empty table stays empty.  Where ``df`` has columns of these names,
    the new ones get underscores behind theirs.
    """
    names = df.columns
    runs, collapsed = free(df, "runs"), free(df, "collapsed")
    inner = numbered(df)
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in slices(batch, batch.column(place)):
                rows, left = zip(*_examined(part.column(place), least), strict=True)
                flat = np.concatenate(rows)
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                arrays = [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), struct).cast(kind), pa.array(left, type=pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "_runs", "_collapsed"])

    spans = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    schema = T.StructType([*inner.schema, T.StructField("_runs", spans), T.StructField("_collapsed", T.StringType())])
    out = inner.mapInArrow(run, schema)
    return named(out, names, F.col("_runs").alias(runs), F.col("_collapsed").alias(collapsed))


def digests(found: DataFrame) -> DataFrame:
    """doc_id and what the runs and collapsed texts of :func:`find_runs` amount to, in numbers and digests."""
    # the longest run, then the first, then the one of smallest period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    one = found.select("doc_id", "runs", "collapsed", best.alias("best"), listed.alias("listed"))
    length, period = -F.col("best.minus"), F.col("best.period")
    return one.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(-best.minus * 1000) div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
