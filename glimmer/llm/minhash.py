"""MinHash near-duplicates: b-bit sketches after band candidates, exact confirmation.

A document's set is its distinct shingles of ``width`` words.  Rows with equal sets form
one class, so that copies cost one row from then on.  Classes that agree in all minima
of a band are candidates.  Each bucket of a band is a star first: every member is
compared with one class only, the one that shares most buckets with others (the original
among its copies).  What remains in another component than that class is then compared
with the rest of its bucket: in buckets of at most SMALL classes one by one, in larger ones
by an exact search for shared rare shingles, in which the smaller set of a pair shows so
few of its shingles that documents which only share a passage don't meet.  No bucket is
capped.  A pair from a band or a small bucket is dropped early only where the low bits kept
of its (mixed) minima estimate a similarity five standard deviations below the threshold;
the search by rare shingles needs no estimate.  All others are confirmed on their full sets.

Probability of missing a pair of similarity 0.8 by bands of 5 x 30: 7e-6.

A class goes by a node that orders by its smallest id, so that a component's label is its
smallest id already and no join on the component is needed, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import add_columns, named, numbered
from .components import connected_components, node
from .texthash import mix, shingles, word_hashes
from .workspace import Workspace

ROWS, BANDS, LOW_BITS = 5, 30, 2
MINIMA = ROWS * BANDS
_PER_LONG = 64 // LOW_BITS
_LONGS = -(-MINIMA // _PER_LONG)
_RNG = np.random.Generator(np.random.PCG64(6))
_FACTORS = (_RNG.integers(1, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_OFFSETS = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32)
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0xD6E8FEB86659FD93)
#: Buckets of more classes are searched by rare shingles after their star.
SMALL = 16
#: Bits of a shingle by which its frequency is counted, and tasks that add counts up.
COUNTED, CUPS = 17, 8
#: Shingles whose minima are taken together.
_CHUNK = 1 << 18


def distinct_shingles(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    for words in word_hashes(texts):
        s = shingles(words, width)
        s = np.sort(s)
        yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def _minima(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The minima (sets x MINIMA) of sets that lie one after another in ``flat``; none is empty."""
    low = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), MINIMA), dtype=np.uint32)
    h = np.empty_like(low)
    for k in range(MINIMA):
        np.multiply(low, _FACTORS[k], out=h)
        np.add(h, _OFFSETS[k], out=h)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def _sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (n x 2), band hashes (n x BANDS) and packed low bits (n x longs) of sets that aren't empty."""
    keys, minima = [], []
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= _CHUNK):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64)))
        keys.append(np.stack([np.add.reduceat(mix(flat), starts), np.add.reduceat(mix(flat * _SECOND), starts)], axis=1))
        minima.append(_minima(flat, starts))
        at = end
    m = np.concatenate(minima)
    wide = mix(m.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)).reshape(len(m), BANDS, ROWS)
    bands = mix((wide * _BAND).sum(axis=2, dtype=np.uint64))
    low = np.zeros((len(m), _LONGS * _PER_LONG), dtype=np.uint64)
    low[:, :MINIMA] = wide.reshape(len(m), MINIMA) & np.uint64((1 << LOW_BITS) - 1)
    shifts = np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(LOW_BITS)
    packed = np.bitwise_or.reduce(low.reshape(len(m), _LONGS, _PER_LONG) << shifts, axis=2)
    return np.concatenate(keys), bands, packed


def signatures(df: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, copy, n_shingles, key, bands, bits); ``copy`` is a hash of the text, ``key`` of the set."""
    added = T.StructType(
        [
            T.StructField("n_shingles", T.LongType()),
            T.StructField("key", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("bits", T.ArrayType(T.LongType())),
        ]
    )

    def lists(values: np.ndarray, at: list[int], n: int) -> pa.Array:
        """Rows of ``values`` at the positions ``at`` of ``n``, the others null."""
        sizes = np.zeros(n + 1, dtype=np.int32)
        sizes[np.asarray(at, dtype=np.int64) + 1] = values.shape[1] if len(at) else 0
        mask = np.ones(n, dtype=bool)
        mask[at] = False
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(values.reshape(-1).view(np.int64)), mask=pa.array(mask))

    def compute(texts: list[str | None]):
        sets = list(distinct_shingles(texts, width))
        n = [len(s) for s in sets]
        at = [i for i, k in enumerate(n) if k]
        if not at:
            return [n, *[[None] * len(n)] * 3]
        keys, bands, bits = _sketches([sets[i] for i in at])
        raw, key = keys.astype(">u8").tobytes(), [None] * len(n)
        for j, i in enumerate(at):
            key[i] = raw[16 * j : 16 * j + 16]
        return [n, key, lists(bands, at, len(n)), lists(bits, at, len(n))]

    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("copy"), F.col(f"`{text}`").alias("text"))
    return add_columns(rows, "text", added, compute, keep=["doc_id", "copy"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from packed low bits, corrected for low bits that agree by chance."""
    odd = sum((1 << LOW_BITS * i) for i in range(_PER_LONG))
    odd -= (1 << 64) if odd >= 1 << 63 else 0
    differ = F.lit(0)
    for i in range(_LONGS):
        x = a[i].bitwiseXOR(b[i])
        for j in range(1, LOW_BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(a[i].bitwiseXOR(b[i]), j))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(odd)))
    by_chance = 1 / (1 << LOW_BITS)
    return ((1 - differ / MINIMA) - by_chance) / (1 - by_chance)


def _floor(threshold: float) -> float:
    """The estimate below which a pair is dropped: five standard deviations under the threshold."""
    by_chance = 1 / (1 << LOW_BITS)
    p = threshold + (1 - threshold) * by_chance
    return threshold - 5 * (p * (1 - p) / MINIMA) ** 0.5 / (1 - by_chance)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 * intersection >= percent * union of their full sets."""
    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                all_ = np.sort(np.concatenate((u, v)), kind="stable")
                shared = int((all_[1:] == all_[:-1]).sum())
                keep.append(100 * shared >= percent * (len(all_) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    both = both.select("a", "b", "sa", "sb")
    return both.mapInArrow(run, T.StructType([both.schema["a"], both.schema["b"]]))


def _frequencies(classes: DataFrame) -> np.ndarray:
    """How many of all shingles of ``classes`` fall into each of 2^COUNTED buckets by their first bits.

    A partition gives one row, and CUPS tasks add these up.  The counts only order shingles
    by rarity; results are the same for any order.
    """
    top = np.uint64(64 - COUNTED)

    def packed(total: np.ndarray) -> bytes:
        at = np.flatnonzero(total)
        return np.stack((at, total[at])).astype(np.int64).tobytes()

    def unpacked(rows: Iterable[bytes]) -> np.ndarray:
        total = np.zeros(1 << COUNTED, dtype=np.int64)
        for row in rows:
            at, n = np.frombuffer(row, dtype=np.int64).reshape(2, -1)
            total[at] += n
        return total

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(1 << COUNTED, dtype=np.int64), False
        for batch in batches:
            for s in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(s, dtype=np.uint64) >> top).astype(np.int64), 1)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([packed(total)])], names=["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(1 << COUNTED, dtype=np.int64), False
        for batch in batches:
            total += unpacked(batch.column(0).to_pylist())
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([packed(total)])], names=["counts"])

    each = classes.select("shingles").mapInArrow(count, "counts binary")
    return unpacked(r["counts"] for r in each.repartition(CUPS).mapInArrow(add, "counts binary").collect())


def _by_prefix(classes: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of ``classes`` (key, component, n, shingles) in two components that may be links.

    Exact: with each set's shingles in one order, rare ones first, the first shingle that two
    linked sets share is followed by so many others of both that it stands among the first
    n - ceil(percent% n) + 1 of the larger set and among the first n - ceil(2 p / (1 + p) n) + 1
    (p = percent%) of the smaller one.  The smaller set of a pair shows the latter only:
    documents of about one size that share a frequent passage but too little else begin
    with more of their own than that, so they never meet.
    """
    shared = classes.sparkSession.sparkContext.broadcast(_frequencies(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            rows, found, places, few = [], [], [], []
            for i, (n, data) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                s = np.frombuffer(data, dtype=np.uint64)
                first = np.lexsort((s, counts[(s >> np.uint64(64 - COUNTED)).astype(np.int64)]))[: n - -(-percent * n // 100) + 1]
                rows.append(np.full(len(first), i))
                found.append(s[first].view(np.int64))
                places.append(np.arange(len(first), dtype=np.int32))
                few.append(places[-1] <= n - -(-2 * percent * n // (100 + percent)))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), *(pa.array(np.concatenate(x)) for x in (found, places, few))], names=["key", "component", "n", "shingle", "place", "few"])

    of = classes.select("key", "component", "n", "shingles")
    prefixes = of.mapInArrow(run, T.StructType([*of.schema.fields[:3], T.StructField("shingle", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("few", T.BooleanType())]))
    a, b = (rows.select("shingle", *(F.col(c).alias(c + x) for c in ("key", "component", "n", "place"))) for x, rows in (("a", prefixes.where("few")), ("b", prefixes)))
    behind = F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb"))
    enough = behind * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("keya") < F.col("keyb")))
    pairs = a.join(b, "shingle").where(smaller & (F.col("componenta") != F.col("componentb")) & enough)
    return pairs.select(F.least("keya", "keyb").alias("a"), F.greatest("keya", "keyb").alias("b")).distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: doc_id, copy, n_shingles, component_id, kept, group.

    ``copy`` is a hash of the text, ``group`` the component's own key (null without words).
    ``component_id`` is the smallest id that links reach.  Rows without words are linked
    with nothing.  Rows may repeat: equal texts share a class.  A row without an id takes
    part; its component is null, and it is kept, only where no member has an id.  Other
    columns of ``df`` are not looked at.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "minhash")
    sig = ws.keep(signatures(df, doc_id, text, width), "signatures")
    member = F.col("key").isNotNull()
    classes = sig.where(member).groupBy("key").agg(F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n"), F.min("copy").alias("copy"), F.min("doc_id").alias("doc_id"))
    classes = ws.keep(classes.withColumn("key", node(F.col("doc_id"), F.col("key"))), "classes")
    rows = classes.select("key", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = ws.keep(rows.join(sizes, "bucket"), "shared")
    # the class that shares most buckets with others stands in a bucket's middle, as the original among its copies
    middle = shared.join(shared.groupBy("key").agg(F.sum("size").alias("weight")), "key")
    stars = middle.groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("m")).select("bucket", F.col("m.key").alias("rep"))
    crowded = ws.keep(shared.select("bucket", "key").join(stars, "bucket"), "crowded")

    sketch = classes.select("key", "bits", "n")
    possible = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (estimate(F.col("ba"), F.col("bb")) >= _floor(percent / 100))

    def sketched(pairs: DataFrame) -> DataFrame:
        a, b = (sketch.select(F.col("key").alias(x), F.col("bits").alias(f"b{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        return pairs.join(b, "b").join(a, "a").where(possible).select("a", "b")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """(key, shingles) of every class in ``pairs``, from one text of each."""
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        wanted = classes.join(keys, "key", "left_semi").select("copy", "key")
        texts = df.select(F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("copy")).join(wanted, "copy")
        added = T.StructType([T.StructField("shingles", T.BinaryType())])
        # texts of one class, or of one hash, may come more than once
        return add_columns(texts, "text", added, lambda t: [[s.tobytes() for s in distinct_shingles(t, width)]], keep=["key"]).groupBy("key").agg(F.first("shingles").alias("shingles"))

    first = ws.keep(sketched(crowded.select(F.col("rep").alias("a"), F.col("key").alias("b")).where("a <> b").distinct()), "pairs-1")
    links = ws.keep(_confirm(first, ws.keep(sets_of(first), "sets-1"), percent), "links-1")
    labels = connected_components(ws, links, "cc-1")
    ws.drop("sets-1")

    # buckets in which something isn't connected with the star's middle
    named = crowded.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    of_rep = labels.select(F.col("node").alias("rep"), F.col("component").alias("main"))
    named = named.join(of_rep, "rep", "left").withColumn("rest", F.col("component") != F.coalesce("main", "rep"))
    left_over = named.groupBy("bucket").agg(F.sum(F.col("rest").cast("int")).alias("rests"), F.count(F.lit(1)).alias("size")).where("rests > 0 and size > 2")
    named = ws.keep(named.join(left_over.select("bucket", "size"), "bucket").join(sketch, "key").select("bucket", "size", "key", "component", "rest", "bits", "n"), "open")
    small, large = named.where(F.col("size") <= SMALL), named.where(F.col("size") > SMALL)
    r = small.where("rest").select("bucket", F.col("key").alias("a"), F.col("component").alias("ca"), F.col("bits").alias("ba"), F.col("n").alias("na"))
    m = small.select("bucket", F.col("key").alias("b"), F.col("component").alias("cb"), F.col("bits").alias("bb"), F.col("n").alias("nb"), F.col("rest").alias("restb"))
    second = r.join(m, "bucket").where((F.col("ca") != F.col("cb")) & (~F.col("restb") | (F.col("a") < F.col("b"))) & possible).select("a", "b")
    open_ = ws.keep(large.groupBy("key").agg(F.first("component").alias("component"), F.first("n").alias("n")), "large")
    if open_.limit(1).count():
        sets = ws.keep(sets_of(open_.select(F.col("key").alias("a"), F.col("key").alias("b"))), "sets-large")
        second = second.unionByName(_by_prefix(open_.join(sets, "key"), percent))
    second = second.distinct().join(first, ["a", "b"], "left_anti").join(first.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    second = ws.keep(second, "pairs-2")
    if second.limit(1).count():
        more = _confirm(second, ws.keep(sets_of(second), "sets-2"), percent)
        links = ws.keep(links.unionByName(more), "links-2")
        labels = connected_components(ws, links, "cc-2")

    # a class without links is its own component
    component = F.coalesce("component", "key")
    named = classes.select("key").join(labels.withColumnRenamed("node", "key"), "key", "left").select(F.col("key.of").alias("key"), component["least"].alias("component_id"), component["of"].alias("group"))
    out = sig.select("doc_id", "copy", "n_shingles", "key").join(named, "key", "left")
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "copy", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "group")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay: one of each group of near copies, and all without words.

    Rows that repeat id and text are copies too; one of them stays.
    """
    ws = Workspace(df.sparkSession, "minhash-kept")
    found = near_duplicates(df, doc_id, text, width, percent).where("kept")
    # one text of the kept id: a repeated id may have several
    alone = F.coalesce("group", F.col("copy").cast("string").cast("binary"))
    kept = found.groupBy("doc_id", alone.alias("group")).agg(F.min("copy").alias("copy"), F.count(F.lit(1)).alias("rows"))
    kept = ws.keep(kept.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_of"), "rows"), "kept")
    mine, words = (f"_in_{df.columns.index(c)}" for c in (doc_id, text))
    rows = numbered(df).withColumn("_copy", F.xxhash64(words))
    out = rows.join(kept.select("_id", "_of"), F.col(mine).eqNullSafe(F.col("_id")) & (F.col("_copy") == F.col("_of")), "left_semi")
    if kept.where("rows > 1").limit(1).count():
        out = out.dropDuplicates([mine, "_copy"])
    return named(out, df.columns)
